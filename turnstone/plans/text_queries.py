"""Queries over texts and terms, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import alignment, terms
from turnstone.plans.edit_queries import edits_sql
from turnstone.plans.normal_sql import wer_sql
from turnstone.sources.tables import TURNS_SQL, conversation_turns, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A glossary on words of the test texts: form, canonical.
FORMS = (("the ea", "THE EA"), ("on the", "ON THE"), ("de la", "DE LA"), ("er die", "ER DIE"), ("of and", "OF AND"), ("tion", "TION"), ("erheit", "ERHEIT"), ("is the of", "IS THE OF"))
FORMS_SQL = "forms as (select * from (values " + ", ".join(f"('{form}', '{canonical}')" for form, canonical in FORMS) + ") f(form, canonical))"
#: Normal words of neighbouring turns.
_WER_WORDS = f"list_filter(string_split({wer_sql('coalesce(text, ' + chr(39) * 2 + ')')}, ' '), lambda w: w <> '')"
PAIRS_SQL = TURNS_SQL + f""", tokens as (select clip_id, idx, {_WER_WORDS} as ts from turns),
  pairs as (select a.clip_id, a.idx, a.ts as ref, b.ts as hyp from tokens a join tokens b on a.clip_id = b.clip_id and b.idx = a.idx + 1)"""


def _distance_sql(a: str, b: str) -> str:
    """DuckDB's levenshtein counts bytes, so tokens that both sides have become ASCII letters, all others one of each side."""
    spell = lambda x, alone: f"coalesce(array_to_string(list_transform({x}, lambda w: coalesce(chr((36 + list_position(list_intersect({a}, {b}), w))::int), '{alone}')), ''), '')"
    return f"levenshtein({spell(a, '!')}, {spell(b, '#')})"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation_turns(spark, sf_dir).select("clip_id", "idx", T.wer_words(F.coalesce("text", F.lit(""))).alias("ts"))
    after = own.select("clip_id", (F.col("idx") - 1).alias("idx"), F.col("ts").alias("hyp"))
    return own.withColumnRenamed("ts", "ref").join(after, ["clip_id", "idx"])


def forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMS, "form string, canonical string")


@query(f"with {PAIRS_SQL} select clip_id, idx, len(ref) as n_ref, {_distance_sql('ref', 'hyp')} as distance, case when len(ref) > 0 then round({_distance_sql('ref', 'hyp')} / len(ref), 6) when len(hyp) > 0 then 1.0 else 0.0 end as wer, case when len(ref) > 0 then round(least({_distance_sql('ref', 'hyp')} / len(ref), 1), 6) else 0.0 end as clipped_wer from pairs")
def token_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = token_pairs(spark, sf_dir).withColumn("distance", T.token_distance(F.col("ref"), F.col("hyp")))
    return pairs.select("clip_id", "idx", F.size("ref").alias("n_ref"), "distance", T.error_rate(F.col("distance"), F.size("ref")).alias("wer"), T.clipped_rate(F.col("distance"), F.size("ref")).alias("clipped_wer"))


_CLEAN = "list_filter({x}, lambda w: not list_contains(['um', 'uh', 'mm-hmm', 'mm', 'hmm', 'mhm', 'mmhmm'], w))"
_ONCE = "list_transform(list_filter(list_zip({x}, list_concat([null], {x}[1:len({x}) - 1])), lambda p: p[1] is distinct from p[2]), lambda p: p[1])"
#: Fillers before some words of the transcript, and other words said twice.
_STUTTER = "flatten(list_transform({x}, lambda w, i: case when i % 5 = 1 then [['um', 'mm-hmm', 'uh'][i % 3 + 1], w] when i % 7 = 2 then [w, w] else [w] end))"
_CLEANED_SQL = PAIRS_SQL + f", said as (select clip_id, idx, ref, {_STUTTER.format(x='list_concat(ref, hyp[1:3])')} as hyp from pairs), clean as (select clip_id, idx, {_CLEAN.format(x='ref')} as r, {_CLEAN.format(x='hyp')} as h from said), once as (select clip_id, idx, {_ONCE.format(x='r')} as ref, {_ONCE.format(x='h')} as hyp from clean)"


# What only goes on needs no distance, which has letters for some ninety shared tokens alone.
@query(f"with {_CLEANED_SQL} select clip_id, idx, len(ref) as n_ref, case when hyp[1:len(ref)] = ref then len(hyp) - len(ref) else {_distance_sql('ref', 'hyp')} end as distance from once")
def cleaned_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without fillers and words said twice: what is left differs in the words added at the end alone."""
    filler = lambda i: F.get(F.array(*map(F.lit, ("um", "mm-hmm", "uh"))), ((i + 1) % 3).cast("int"))
    stutter = lambda words: F.flatten(F.transform(words, lambda w, i: F.when((i + 1) % 5 == 1, F.array(filler(i), w)).when((i + 1) % 7 == 2, F.array(w, w)).otherwise(F.array(w))))
    pairs = token_pairs(spark, sf_dir).select("clip_id", "idx", T.drop_fillers(F.col("ref")).alias("r"), T.drop_fillers(stutter(F.concat("ref", F.slice("hyp", 1, 3)))).alias("h"))
    pairs = pairs.select("clip_id", "idx", T.collapse_repeats(F.col("r")).alias("ref"), T.collapse_repeats(F.col("h")).alias("hyp"))
    return pairs.select("clip_id", "idx", F.size("ref").alias("n_ref"), T.token_distance(F.col("ref"), F.col("hyp")).alias("distance"))


@query(f"with {PAIRS_SQL}, chars as (select clip_id, idx, coalesce(regexp_replace(array_to_string(ref, ''), '[^a-z0-9]', '', 'g'), '') as a, coalesce(regexp_replace(array_to_string(hyp, ''), '[^a-z0-9]', '', 'g'), '') as b from pairs) select clip_id, idx, levenshtein(a, b) as distance, case when len(a) > 0 then round(levenshtein(a, b) / len(a), 6) when len(b) > 0 then 1.0 else 0.0 end as cer from chars")
def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = lambda name: F.regexp_replace(F.array_join(name, ""), "[^a-z0-9]", "")  # noqa: E731 - DuckDB's distance counts bytes
    pairs = token_pairs(spark, sf_dir).select("clip_id", "idx", letters("ref").alias("a"), letters("hyp").alias("b")).withColumn("distance", F.levenshtein("a", "b"))
    return pairs.select("clip_id", "idx", "distance", T.error_rate(F.col("distance"), F.length("a")).alias("cer"))


@query("select distinct w as word, regexp_replace(w, '[aeiouy]', '', 'g') as bare from (select unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as w from part)")
def phonetic_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(T.tokens(F.col("p_name"))).alias("word")).distinct()
    return words.select("word", F.regexp_replace("word", "[aeiouy]", "").alias("bare"))


def _key_sql(word: str) -> str:
    """Without vowels and with each letter once in a row; DuckDB's patterns have no back references, so letter by letter."""
    bare = f"regexp_replace({word}, '[aeiouy]', '', 'g')"
    for letter in "bcdfghjklmnpqrstvwxz0123456789":
        bare = f"regexp_replace({bare}, '{letter}{letter}+', '{letter}', 'g')"
    return bare


@query(f"select distinct w as word, {_key_sql('w')} as key from (select unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as w from part)")
def phonetic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(T.tokens(F.col("p_name"))).alias("word")).distinct()
    return words.select("word", T.phonetic_key(F.col("word")).alias("key"))


@query(f"with {FORMS_SQL}, texts as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' as t from documents) select doc_id as id, canonical, form from texts join forms on contains(t, ' ' || form || ' ')")
def phrase_term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    return terms.phrase_matches(texts, forms(spark))


@query()
def fuzzy_term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """difflib's similarity, which SQL lacks; tests/test_terms.py looks at every window instead."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    return terms.fuzzy_matches(texts, forms(spark))


@query()
def phonetic_term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by phonetic keys."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    return terms.phonetic_matches(texts, forms(spark))


@query(f"with recursive {PAIRS_SQL.replace('pairs as (', 'turn_pairs as (', 1)}, pairs as (select clip_id * 100000 + idx as id, ref as a, hyp as b from turn_pairs), {edits_sql(leave_out_common=True)} select id // 100000 as clip_id, id % 100000 as idx, op, a0 as a_start, a1 as a_end, b0 as b_start, b1 as b_end from edits")
def edit_opcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits between neighbouring turns, one a row; very common words of long turns begin no block."""
    pairs = token_pairs(spark, sf_dir).select("clip_id", "idx", alignment.edits(F.col("ref"), F.col("hyp"), leave_out_common=True).alias("edited"))
    return pairs.select("clip_id", "idx", F.inline("edited"))


@query(r"""with chunks as (select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from documents), size as (select count(*) as n from chunks),
  tf as (select id, token, count(*) as c, any_value(total) as total from (select id, len(ts) as total, unnest(ts) as token from chunks) group by 1, 2), df as (select token, count(*) as d from tf group by 1),
  weights as (select id, token, c / total * (ln((1 + n) / (1 + d)) + 1) as w from tf join df using (token), size), norms as (select id, sqrt(sum(w * w)) as norm from weights group by 1),
  qtf as (select id, token, count(*) as c, any_value(total) as total from (select item_id as id, len(ts) as total, unnest(ts) as token from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from benchmark)) group by 1, 2),
  q as (select id as query_id, token, c / total * (ln((1 + n) / (1 + coalesce(d, 0))) + 1) as q from qtf left join df using (token), size), lengths as (select query_id, sqrt(sum(q * q)) as q_norm from q group by 1),
  scored as (select query_id, id, round(dot / (norm * q_norm), 6) as score from (select query_id, id, sum(q * w) as dot from q join weights using (token) group by 1, 2) join norms using (id) join lengths using (query_id))
  select query_id, row_number() over (partition by query_id order by score desc, id) as rank, id, score from scored where score > 0 qualify rank <= 4""")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("id"), T.tokens(F.col("text")).alias("tokens"))
    return terms.tfidf_top(cut("benchmark", "item_id"), cut("documents", "doc_id"))


_RULES_SQL = "replace(replace(text, 'The ', 'the rack '), ' and ', ' whisper ')"
for _source, _new in terms.CORRECTIONS:
    if _new.lower() in ("rag", "whisper", "faster-whisper", "der"):
        _RULES_SQL = f"regexp_replace({_RULES_SQL}, '(?i)\\b{_source}\\b', '{_new}', 'g')"


@query(f"with {TURNS_SQL}, done as (select clip_id, idx, {_RULES_SQL} as corrected, replace(replace(text, 'The ', 'the rack '), ' and ', ' whisper ') as raw from turns) select clip_id, idx, md5(corrected) as corrected_md5, corrected <> raw as changed from done")
def rule_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with planted spoken forms, corrected for a glossary of three terms."""
    raw = F.replace(F.replace(F.col("text"), F.lit("The "), F.lit("the rack ")), F.lit(" and "), F.lit(" whisper "))
    rows = conversation_turns(spark, sf_dir).select("clip_id", "idx", raw.alias("raw"))
    rows = rows.withColumn("corrected", terms.rule_correction(F.col("raw"), F.array(F.lit("RAG"), F.lit("faster-whisper"), F.lit("DER"))))
    return rows.select("clip_id", "idx", F.md5("corrected").alias("corrected_md5"), (F.col("corrected") != F.col("raw")).alias("changed"))


@query(f"with {TURNS_SQL}, found as (select clip_id, idx, unnest(regexp_extract_all(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}])(?:on|the)\\s+([a-z]+)(?:[.,]|$)', 1)) as action from turns) select clip_id, idx, upper(action[1:1]) || action[2:] as action, count(*) as n from found group by all")
def action_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a cue word up to a stop, with a capital; the cues are words of the test texts."""
    found = conversation_turns(spark, sf_dir).select("clip_id", "idx", F.explode(F.regexp_extract_all("text", F.lit("(?i)(?:^|[^\\p{L}\\p{N}])(?:on|the)\\s+([a-z]+)(?:[.,]|$)"), 1)).alias("action"))
    action = F.concat(F.upper(F.substring("action", 1, 1)), F.expr("substring(action, 2)"))
    return found.select("clip_id", "idx", action.alias("action")).groupBy("clip_id", "idx", "action").agg(F.count("*").alias("n"))


@query(f"with {TURNS_SQL} select clip_id, a.text is null as only_right, b.text is null as only_left, coalesce(a.idx, b.idx) as idx from (select * from turns where idx % 3 <> 0) a full join (select * from turns where idx % 2 = 0) b using (clip_id, idx)")
def full_outer_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    a = turns.where("idx % 3 <> 0").select("clip_id", "idx", F.col("text").alias("raw"))
    b = turns.where("idx % 2 = 0").select("clip_id", "idx", F.col("text").alias("corrected"))
    return a.join(b, ["clip_id", "idx"], "outer").select("clip_id", "idx", F.col("raw").isNull().alias("only_right"), F.col("corrected").isNull().alias("only_left"))
