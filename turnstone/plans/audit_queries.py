"""Queries of audits, reviews, gate features, labels and confidences, with their SQL. Odd inputs are planted by row numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import audits, gate_features, meetings, review
from turnstone.operators.edit_errors import DISFLUENCIES
from turnstone.plans.edit_queries import edits_sql
from turnstone.plans.gate_queries import PROPOSALS_SQL, proposals
from turnstone.plans.interval_queries import SHIFTED_SQL, shifted
from turnstone.plans.normal_sql import wer_sql
from turnstone.sources.tables import TURNS_SQL, WORDS_SQL, conversation_turns, conversation_words, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def pick(number, *values):
    """The value at a column's remainder."""
    return F.get(F.array(*(F.lit(v) for v in values)), (number % len(values)).cast("int"))


def _pick_sql(number: str, *values) -> str:
    shown = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"([{shown}]::varchar[])[({number}) % {len(values)} + 1]"


_sql_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


# ---- languages


_CODES = ("", "_AA", "-x")
_CODE_SQL = f"case doc_id % 6 when 4 then {_pick_sql('doc_id // 6', ' ZH_CN ', 'cmn', 'zh-TW', 'Mandarin', 'zho')} when 5 then null else upper(lang) || {_pick_sql('doc_id % 6', *_CODES)} end"


@query(f"with c as (select doc_id, replace(lower(trim(coalesce({_CODE_SQL}, ''))), '_', '-') as language from documents) select doc_id, language, case when language in {tuple(T.MANDARIN)} or language like 'zh-%' then 'CER' else 'WER' end as metric from c")
def language_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    code = F.when(d % 6 == 4, pick(F.floor(d / 6), " ZH_CN ", "cmn", "zh-TW", "Mandarin", "zho")).when(d % 6 != 5, F.concat(F.upper("lang"), pick(d % 6, *_CODES)))
    docs = table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))
    return docs.select("doc_id", T.canonical_language(F.col("code")).alias("language"), T.metric_of(F.col("code")).alias("metric"))


# ---- audits of transcripts

#: What the reference and the transcript begin with, the language, the data set.
PLANTED = (
    ("Then, Lakkha Singh took the lead.", "Then lock a sink to the lid.", "en", "FLEURS"), ("Um this is the kick-off meeting for twenty five minutes.", "This is the kickoff meeting.", "en", "AMI Meeting Corpus"),
    ("We use pyannote.audio and WER.", "We use piano note and where.", "en", "x"), ("The NASA/ESA deal of 12.5 and 3 million, Ok Il.", "The NASA deal of 12.5 and three million.", "fr", "x"), ("会议 RAG 开始 三点", "会议 开始", "zh-CN", "x"),
    ("plain words", "plain words", "en", "x"), ("I said DER and cross-speech in Vienna New York", "i said der and cross speech in vienna", "de", "Family"), ("", "nothing was said", "en", "x"),
)
_N = len(PLANTED)
AUDITED_SQL = f"""{TURNS_SQL}, planted(p, a, b, language, dataset_name) as (values {", ".join(f"({i}, '{a}', '{b}', '{language}', '{name}')" for i, (a, b, language, name) in enumerate(PLANTED))}),
  results as (select clip_id, idx, 'clip' || clip_id || '-' || idx as clip, 'm' || idx % 2 as model_name, language, dataset_name, case when idx % 13 = 5 then null else a || ' ' || coalesce(text, '') end as reference_text,
    case when idx % 11 = 7 then null when idx % 3 = 0 then b || ' ' || coalesce(text, '') else b || ' ' || left(coalesce(text, ''), (length(coalesce(text, '')) // 2)::bigint) end as hypothesis_text, (idx % 10) / 20.0 as error_rate, case when idx % 3 <> 0 then (idx % 8) / 20.0 end as cleaned_error_rate
    from turns join planted on p = (clip_id * 5 + idx) % {_N})"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of transcripts: whole turns after planted words, some halves, some null."""
    i, clip = F.col("idx"), F.col("clip_id")
    planted = spark.createDataFrame([(k, *row) for k, row in enumerate(PLANTED)], "p int, a string, b string, language string, dataset_name string")
    turns = conversation_turns(spark, sf_dir).select("clip_id", "idx", F.coalesce("text", F.lit("")).alias("text"), ((clip * 5 + i) % _N).cast("int").alias("p"))
    half = F.substring(F.col("text"), F.lit(1), F.expr("cast(length(text) div 2 as int)"))
    return turns.join(F.broadcast(planted), "p").select(
        "clip_id", "idx", F.concat(F.lit("clip"), clip.cast("string"), F.lit("-"), i.cast("string")).alias("clip"), F.concat(F.lit("m"), (i % 2).cast("string")).alias("model_name"), "language", "dataset_name",
        F.when(i % 13 != 5, F.concat_ws(" ", "a", "text")).alias("reference_text"), F.when(i % 11 == 7, None).when(i % 3 == 0, F.concat_ws(" ", "b", "text")).otherwise(F.concat_ws(" ", F.col("b"), half)).alias("hypothesis_text"),
        ((i % 10) / 20).alias("error_rate"), F.when(i % 3 != 0, (i % 8) / 20).alias("cleaned_error_rate"),
    )


# DuckDB's patterns have neither look-arounds nor word borders beyond ASCII: signs between words are doubled, so that each match may take one on both sides.
_W = r"\p{L}\p{N}_"
_double = lambda x: rf"' ' || regexp_replace({x}, '([^{_W}])', '\1\1', 'g') || ' '"
_between = lambda x, inner: rf"list_transform(regexp_extract_all({_double(x)}, '[^{_W}]({inner})[^{_W}]', 1), lambda m: trim(regexp_replace(replace(replace(replace(replace(replace(m, '--', '-'), '..', '.'), '//', '/'), '''''', ''''), ',,', ','), '\s+', ' ', 'g')))"
_NAME_SQL = "(?:[A-ZÀ-ÖØ-Þ](?:[a-zÀ-ÖØ-öø-ÿ''’-]*[a-zÀ-ÖØ-öø-ÿ])|[A-Z]{2,})"
_once = lambda x: f"list_filter({x}, lambda w, k: list_position({x}, w) = k)"
_bounded_sql = lambda normal, phrase: f"(trim({phrase}) <> '' and regexp_matches({normal}, '(^|[^a-z0-9])' || regexp_escape({phrase}) || '($|[^a-z0-9])'))"
_holds = lambda text, normal, p: f"case when mandarin or regexp_matches({p}, '[一-鿿]') then contains({text}, {p}) else {_bounded_sql(normal, wer_sql(p))} end"
_AUDIT_SQL = f"""{AUDITED_SQL}, r as (select * replace (coalesce(reference_text, '') as reference_text, coalesce(hypothesis_text, '') as hypothesis_text), replace(lower(language), '_', '-') in {tuple(T.MANDARIN)} or lower(language) like 'zh-%' as mandarin from results),
  n as (select *, {wer_sql('reference_text')} as ref, {wer_sql('hypothesis_text')} as hyp from r), t as (select *, list_filter(string_split(ref, ' '), lambda w: w <> '') as rt, list_filter(string_split(hyp, ' '), lambda w: w <> '') as ht from n),
  f as (select *, list_filter({_sql_list(audits.DOMAIN_TERMS)}, lambda p: {_holds('reference_text', 'ref', 'p')}) as known, {_between('reference_text', '[A-Z]{2,}(?:[./-]+[A-Z0-9]+)*')} as acronyms, {_between('reference_text', _NAME_SQL + '(?:[ \\s]+' + _NAME_SQL + ')*')} as names,
    list_concat({_between('ref', '[0-9]+(?:[.,]+[0-9]+)?')}, list_filter(rt, lambda w: w in {tuple(audits.NUMBER_WORDS)})) as n1, list_concat({_between('hyp', '[0-9]+(?:[.,]+[0-9]+)?')}, list_filter(ht, lambda w: w in {tuple(audits.NUMBER_WORDS)})) as n2 from t),
  g as (select *, list_filter(known, lambda p: not {_holds('hypothesis_text', 'hyp', 'p')}) as lost_terms, list_filter(acronyms, lambda p: not {_holds('hypothesis_text', 'hyp', 'p')}) as lost_acronyms,
    list_filter(names, lambda p: {wer_sql('p')} not in {DISFLUENCIES} and not (not contains(p, ' ') and (lower(p) in {tuple(audits.SENTENCE_STARTS)} or length(p) <= 2)) and not {_holds('hypothesis_text', 'hyp', 'p')}) as lost_names,
    case when mandarin then list_filter(regexp_extract_all(reference_text, '[一-鿿]'), lambda w: not contains(hypothesis_text, w)) else list_filter(rt, lambda w: not list_contains(ht, w) and w not in {tuple(audits.STOP_WORDS)} and length(w) > 2) end as gone,
    case when mandarin then len(regexp_extract_all(hypothesis_text, '[一-鿿]')) / greatest(len(regexp_extract_all(reference_text, '[一-鿿]')), 1) else len(ht) / greatest(len(rt), 1) end as ratio from f),
  h as (select *, list_filter([case when len(lost_terms) > 0 then 'professional_term_or_glossary' end, case when len(lost_acronyms) > 0 then 'acronym_or_short_code' end, case when len(lost_names) > 0 then 'proper_noun_or_named_entity' end, case when {_once('n1')} <> {_once('n2')} then 'number_or_quantity' end,
      case when mandarin and error_rate >= 0.2 then 'mandarin_low_frequency_or_script' end, case when contains(lower(dataset_name), 'ami') or len(list_intersect(rt, {_sql_list(DISFLUENCIES)})) > 0 then 'meeting_disfluency_or_truncation' end, case when ratio < 0.72 and error_rate >= 0.2 then 'truncation_or_omission' end], lambda x: x is not null) as types,
    list_concat(list_concat(lost_terms, lost_acronyms), lost_names) as lost from g)
  select clip_id, idx, case when len(types) = 0 then 'general_asr_error' else array_to_string(types, ',') end as types, array_to_string({_once('lost')}, '|') as candidates, array_to_string({_once('gone')}[1:20], ' ') as missing, len(lost) > 0 as term_candidate,
    array_to_string(list_filter([case when ratio < 0.72 and error_rate >= 0.2 then 'hypothesis/reference length ratio=' || printf('%.2f', ratio) end, case when cleaned_error_rate < error_rate then 'cleaned meeting metric is lower after disfluency removal' end], lambda x: x is not null), '; ') as notes from h"""


@query(f"with {_AUDIT_SQL}")
def error_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What probably went wrong in every transcript."""
    audited = audits.audit_transcripts(results(spark, sf_dir))
    return audited.select("clip_id", "idx", F.array_join("error_types", ",").alias("types"), F.array_join("candidates", "|").alias("candidates"), F.array_join("missing", " ").alias("missing"), "term_candidate", "notes")


@query(f"with {AUDITED_SQL} select clip, model_name, error_rate, row_number() over (order by error_rate desc, clip desc, model_name desc) as place from results where error_rate >= 0.3 qualify place <= 50")
def worst_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty worst transcripts, as the audit's report lists them."""
    from pyspark.sql import Window

    worst = audits.worst_transcripts(results(spark, sf_dir).drop("clip_id").withColumnRenamed("clip", "clip_id"), 0.3, 50)
    place = F.row_number().over(Window.orderBy(F.desc("error_rate"), F.desc("clip_id"), F.desc("model_name")))  # fifty rows
    return worst.select(F.col("clip_id").alias("clip"), "model_name", "error_rate", place.alias("place"))


# ---- audits of corrections

_CUT = lambda x: f"list_transform(regexp_extract_all(coalesce({x}, ''), '{audits.TOKEN}'), lambda w: lower(w))"
_CORRECTED_SQL = f"""{TURNS_SQL}, c as (select a.clip_id, a.idx, a.clip_id * 100000 + a.idx as id, a.text as raw_text, case a.idx % 4 when 0 then a.text when 1 then concat_ws(' ', a.text, array_to_string({_CUT('b.text')}[1:2], ' ')) when 2 then concat_ws(' ', array_to_string({_CUT('b.text')}[1:4], ' '), a.text) else array_to_string({_CUT('a.text')}[2:6], ' ') end as corrected_text,
    case when a.idx % 5 = 0 then b.text else '' end as neighbours, {_CUT('b.text')}[1:1] as evidence, a.idx % 2 = 0 as overlap from turns a join turns b on a.clip_id = b.clip_id and a.idx = b.idx + 1),
  cut as (select *, {_CUT('raw_text')} as raw, {_CUT('corrected_text')} as new, list_concat({_CUT('neighbours')}, evidence) as more from c), pairs as (select id, raw as a, new as b from cut), {edits_sql(leave_out_common=True)},
  e as (select id, string_agg(op || ': ' || coalesce(nullif(array_to_string(a[a0 + 1:a1], ' '), ''), '∅') || ' -> ' || coalesce(nullif(array_to_string(b[b0 + 1:b1], ' '), ''), '∅'), '|' order by place) as changed, flatten(list(b[b0 + 1:b1] order by place)) as inserted, sum(a1 - a0) as lost from edits join pairs using (id) group by 1),
  x as (select cut.*, coalesce(changed, '') as changed, coalesce(inserted, []) as inserted, case when len(raw) + len(new) = 0 then 0.0 else 1.0 - 2.0 * (len(raw) - coalesce(lost, 0)) / (len(raw) + len(new)) end as edit_ratio from cut left join e using (id)),
  y as (select *, list_sort(list_distinct(list_filter(inserted, lambda w: list_contains(raw, w) or list_contains(more, w)))) as supported, list_sort(list_distinct(list_filter(inserted, lambda w: not (list_contains(raw, w) or list_contains(more, w))))) as unsupported, len(new) / greatest(len(raw), 1) > 1.5 and len(new) > len(raw) + 2 as longer, overlap and edit_ratio > 0.35 as overlapping from x)"""


@query(f"with recursive {_CORRECTED_SQL} select clip_id, idx, changed, array_to_string(supported, ' ') as supported, array_to_string(unsupported, ' ') as unsupported, case when len(unsupported) > 0 or longer then 'high' when overlapping or edit_ratio > 0.4 then 'medium' else 'low' end as risk, len(unsupported) > 0 or overlapping or longer as needs_review from y")
def correction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every correction's inserted tokens with and without evidence, its risk, and whether it needs review."""
    cut = lambda name: F.transform(F.regexp_extract_all(F.coalesce(F.col(name), F.lit("")), F.lit(f"({audits.TOKEN})"), 1), F.lower)
    part = lambda tokens, start, n: F.array_join(F.slice(tokens, start, n), " ")
    turns = conversation_turns(spark, sf_dir).select("clip_id", "idx", F.col("text").alias("raw_text"))
    other = turns.select("clip_id", (F.col("idx") + 1).alias("idx"), F.col("raw_text").alias("other"))
    i = F.col("idx")
    new = F.when(i % 4 == 0, F.col("raw_text")).when(i % 4 == 1, F.concat_ws(" ", F.col("raw_text"), part(cut("other"), 1, 2))).when(i % 4 == 2, F.concat_ws(" ", part(cut("other"), 1, 4), F.col("raw_text"))).otherwise(part(cut("raw_text"), 2, 5))
    rows = turns.join(other, ["clip_id", "idx"]).select("clip_id", "idx", "raw_text", new.alias("corrected_text"), F.when(i % 5 == 0, F.col("other")).otherwise("").alias("neighbours"), F.slice(cut("other"), 1, 1).alias("evidence"), (i % 2 == 0).alias("overlap"))
    audited = audits.audit_corrections(rows)
    return audited.select("clip_id", "idx", F.array_join("changed_tokens", "|").alias("changed"), F.array_join("supported", " ").alias("supported"), F.array_join("unsupported", " ").alias("unsupported"), "risk", "needs_review")


# ---- terms in context

_TAILS = (" server rack", " asr benchmark", " letter", " speaker", "", "")
_TERMS, _FORMS = ("RAG", "WER", "DER", "Qwen", "TagSpeech"), ("rack", "where", "the ear", "q when", "tag speech")
_SAID = ("", "dear team", "ask where is it", "word error rate", "rack on the table")
_CASES_SQL = f"cases as (select doc_id, lower(coalesce(text, '') || {_pick_sql('doc_id', *_TAILS)}) as whole, {_pick_sql('doc_id', *_TERMS)} as canonical, {_pick_sql('doc_id', *_FORMS)} as form, {_pick_sql('doc_id // 5', *_SAID)} as raw_text, case when doc_id % 3 = 0 then 'fuzzy' else 'exact_error_form' end as method, doc_id % 7 <> 0 as safe, doc_id % 11 = 0 as oracle from documents)"


def _cue_sql(cues: dict, text: str) -> str:
    found = " ".join(f"when '{name}' then " + " or ".join(f"contains({text}, '{w}')" for w in words) for name, words in cues.items())
    return f"case canonical {found} else false end"


_VERIFIED = "case when doc_id % 2 = 0 then raw_text || ' ' || whole else raw_text || ' ' end"


@query(f"""with {_CASES_SQL}, k as (select *, {_cue_sql(review.NEGATIVE_CUES, 'whole')} as denied, form not in {review.AMBIGUOUS_FORMS} and method like 'exact%' as specific, contains(whole, 'benchmark') or contains(whole, 'speaker') as helped, {_VERIFIED} as said from cases),
  v as (select *, {_cue_sql(review.VERIFIER_NEGATIVE, 'said')} as against, canonical in {review.AMBIGUOUS_TERMS} and not {_cue_sql(review.VERIFIER_POSITIVE, 'said')} as unclear, case when denied then 'common_word' when specific then 'specific_form' when helped then 'domain_context' else 'no_context' end as reason from k)
  select doc_id, not denied and (specific or helped) as supported, reason, case when against then 'reject' when not safe or unclear then 'needs_review' else 'accept' end as verdict,
    case when against then 'Negative context indicates common-word meaning for ' || canonical || '.' when not safe then reason when unclear then canonical || ' is ambiguous and lacks domain context.' when oracle then 'Accepted as oracle/custom-vocabulary diagnostic candidate.' else 'Candidate is supported by glossary match and context checks.' end as why from v""")  # fmt: skip
def term_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context support and verdict of made-up term matches in whole texts."""
    c, d = F.col, F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.lower(F.concat(F.coalesce("text", F.lit("")), pick(d, *_TAILS))).alias("whole"), pick(d, *_TERMS).alias("canonical"), pick(d, *_FORMS).alias("form"), pick(F.floor(d / 5), *_SAID).alias("raw_text"),
        F.when(d % 3 == 0, "fuzzy").otherwise("exact_error_form").alias("method"), (d % 7 != 0).alias("safe"), (d % 11 == 0).alias("oracle"),
    )
    rows = rows.withColumn("s", review.context_support(c("canonical"), c("form"), c("method"), c("whole"), F.array(F.lit("benchmark"), F.lit("speaker"))))
    rows = rows.withColumn("v", review.verify_term(c("canonical"), c("safe"), c("raw_text"), F.when(d % 2 == 0, c("whole")).otherwise(""), c("s.reason"), c("oracle")))
    return rows.select("doc_id", "s.supported", "s.reason", F.col("v.decision").alias("verdict"), F.col("v.reason").alias("why"))


# ---- overlaps

_LEVELS, _TEXTS = ("high", "Medium", "LOW", "unknown", "low"), ("it was ...", "[inaudible] yes", "and then [cut off]", "we -- no", "plain", "plain words", "more")


@query(f"""with e as (select event_id, event_id % 3 = 0 as ov, {_pick_sql('event_id', *_LEVELS)} as level, {_pick_sql('event_id', *_TEXTS)} as t, event_id % 2 + event_id % 3 as n_speakers, event_id % 13 = 0 as audited from events),
  r as (select *, lower(level) = 'high' or (ov and (contains(t, '...') or contains(t, '[inaudible]') or contains(t, '[cut off]') or contains(t, '--'))) as reject from e)
  select event_id, reject, audited or reject or ov or lower(level) <> 'low' or n_speakers <> 1 or contains(t, '...') or contains(t, '[inaudible]') or contains(t, '[cut off]') as review, audited or reject as unaware_review, case lower(level) when 'low' then 0.92 when 'medium' then 0.62 when 'high' then 0.35 else 0.5 end as confidence from r""")  # fmt: skip
def overlap_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, c = F.col("event_id"), F.col
    rows = table(spark, sf_dir, "events").select("event_id", (i % 3 == 0).alias("ov"), pick(i, *_LEVELS).alias("level"), pick(i, *_TEXTS).alias("t"), F.array_repeat(F.lit("s"), (i % 2 + i % 3).cast("int")).alias("speakers"), (i % 13 == 0).alias("audited"))
    rows = rows.withColumn("reject", review.rejects_before_correction(c("ov"), c("level"), c("t")))
    look = lambda aware: review.needs_review(c("ov"), c("level"), c("speakers"), c("t"), c("reject"), c("audited"), aware)
    return rows.select("event_id", "reject", look(True).alias("review"), look(False).alias("unaware_review"), review.uncertainty_confidence(c("level")).alias("confidence"))


# ---- labels, features, baselines

_HUMAN, _SUGGESTED = (" ", "ACCEPT", "reject ", None), ("Needs_Review", "accept", "REJECT")


@query(f"with o as (select o_orderkey, nullif(lower(trim({_pick_sql('o_orderkey', *_HUMAN)})), '') as h, lower({_pick_sql('o_custkey', *_SUGGESTED)}) as s from orders) select o_orderkey, coalesce(h, s) as label, case when h is null then 'pilot_auto_labeled' else 'human_checked' end as label_source from o")
def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, source = review.gold_label(pick(F.col("o_orderkey"), *_HUMAN), pick(F.col("o_custkey"), *_SUGGESTED))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), source.alias("label_source"))


_FIELDS = tuple(sorted({*gate_features.AUDIT_AWARE, *gate_features.OTHER_FIELDS}))
_class_sql = lambda at: "case " + " ".join(f"when feature = '{field}' then '{texts[at]}'" for field, texts in gate_features.OTHER_FIELDS.items()) + " " + " ".join(f"when feature in {members} then '{(name, why)[at]}'" for name, (members, why) in gate_features.CLASSES.items()) + f" else '{gate_features.ALLOWED[at]}' end"


@query(f"""with named as (select {_pick_sql('doc_id', *_FIELDS)} as feature from documents) select feature, count(*) as n, {_class_sql(0)} as category, feature in {gate_features.AUDIT_AWARE} as audit_aware, feature in {gate_features.EVIDENCE_ONLY} as evidence_only, feature in {gate_features.RISK_ONLY} as risk_only,
  feature not in {gate_features.EVIDENCE_ONLY} and feature not in {gate_features.RISK_ONLY} as excluded, {_class_sql(1)} as rationale from named group by feature""")  # fmt: skip
def leakage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which features that rows name leak, and why."""
    named = table(spark, sf_dir, "documents").select(pick(F.col("doc_id"), *_FIELDS).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    return named.join(gate_features.audit_features(named), "feature").select("feature", "n", "category", "audit_aware", "evidence_only", "risk_only", "excluded", "rationale")


_PLANTED_DECISIONS = {
    "uncertainty_level": ("low", "Medium", "high", None, "0.4", "none"), "difficulty": ("mild", "Heavy overlap", None), "variant": ("llm_full", "rule_only", "asr_only", None), "language": ("en", "en_US", "fr-CA", "zh", "cmn-x", "de", None, "Mandarin"),
    "source_experiment": ("term_rescue", "overlap_safety_v2", "independent", None), "retrieved_candidates": ('["a", "b"]', "a, b, ,c", "", None, '"one"', "[]"), "applied_corrections": ("[1]", None, "x"), "expected_terms": ('["t"]', None, '["t"]', "t,u", "[]"),
    "missed_terms": ("[]", '["t"]', None), "text_error_before": ("0.5", None, "x", "0.2"), "text_error_after": ("0.6", None, "0.1", "0.2", "nan"), "unsupported_change_count": (None, "2", None, "0", None, None, ""), "unsupported_changes": ("[]", "[]", '["w"]', None, "[]", "[]", "[]"),
    "invented_content": ("false", "0", None, "true", "False", "no", "False", "false", None, "0", "0"), "speaker_attribution_changed": (None,) * 12 + ("yes",), "needs_review": ("false", "True", None, "0", "no"), "correction_rejected": ("0",) * 16 + ("1",), "safety_pass": (None, "true", "1", None, None, None, "false"),
    "correction_error": (None,) * 18 + (" bad ",), "expected_safe_behavior": ("keep", "a negative control", None, "Normal word"), "api_used": ("true", None, "2"), "term_f1": ("0.5", None, "y"),
}
_DECISIONS_SQL = PROPOSALS_SQL + ", decisions as (select clip_id, idx, id, regexp_replace(raw_text, '[^\\x00-\\x7F]', '', 'g') as raw_text, regexp_replace(corrected_text, '[^\\x00-\\x7F]', '', 'g') as corrected_text, overlap, context, " + ", ".join(f"{_pick_sql(f'clip_id * {3 + k} + idx', *values)} as {name}" for k, (name, values) in enumerate(_PLANTED_DECISIONS.items())) + " from proposals)"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on the proposals, of ASCII letters (DuckDB's Levenshtein counts bytes), with planted fields."""
    ascii_only = lambda name: F.regexp_replace(name, "[^\\x00-\\x7F]", "").alias(name)
    rows = proposals(spark, sf_dir)
    number = lambda k: F.col("clip_id") * (3 + k) + F.col("idx")
    return rows.select("clip_id", "idx", ascii_only("raw_text"), ascii_only("corrected_text"), "overlap", "context", *(pick(number(k), *values).alias(name) for k, (name, values) in enumerate(_PLANTED_DECISIONS.items())))


_true_sql = lambda x: f"coalesce(lower(trim({x})) in ('1', 'true', 'yes', 'y') or try_cast({x} as double) <> 0, false)"
_number_sql = lambda x: f"case when isnan(try_cast({x} as double)) then null else try_cast({x} as double) end"
_size_sql = lambda x: f"(case when {x} is null or trim({x}) = '' then 0 when json_valid({x}) then case when json_type({x}) = 'ARRAY' then json_array_length({x}) else 1 end else len(list_filter(string_split({x}, ','), lambda w: trim(w) <> '')) end)"
_FEATURES_SQL = f"""{_DECISIONS_SQL}, dt as (select *, regexp_extract_all(lower(raw_text), '{gate_features.TOKEN}') as rt, regexp_extract_all(lower(corrected_text), '{gate_features.TOKEN}') as nt from decisions), pairs as (select id, rt as a, nt as b from dt), {edits_sql(leave_out_common=True)},
  changes as (select id, sum(greatest(a1 - a0, b1 - b0)) as changed from edits group by 1),
  d1 as (select dt.*, coalesce(changed, 0) as changed, levenshtein(raw_text, corrected_text) / greatest(length(raw_text), length(corrected_text), 1) as distance, coalesce(case lower(trim(uncertainty_level)) when 'none' then 0.0 when 'low' then 0.25 when 'medium' then 0.6 when 'high' then 1.0 else {_number_sql('uncertainty_level')} end, 0)::double as uncertainty, replace(lower(trim(coalesce(language, 'unknown'))), '_', '-') as lang from dt left join changes using (id)),
  d2 as (select *, changed / greatest(len(rt), len(nt), 1) as ratio, overlap and (uncertainty >= 0.9 or contains(lower(coalesce(difficulty, '')), 'heavy')) as heavy, lang = 'en' or lang like 'en-%' or contains(lang, 'english') as en, lang = 'fr' or lang like 'fr-%' or contains(lang, 'french') as fr, lang in ('zh', 'cmn') or lang like 'zh-%' or lang like 'cmn-%' or contains(lang, 'chinese') or contains(lang, 'mandarin') as zh from d1),
  featured as (select clip_id, idx, raw_text, corrected_text, safety_pass, correction_error, {_size_sql('retrieved_candidates')}::double as retrieval_candidate_count, {_size_sql('applied_corrections')}::double as applied_correction_count, changed::double as num_changed_tokens, ratio as changed_token_ratio, distance as edit_distance_ratio, overlap::int::double as overlap_flag, heavy::int::double as heavy_overlap_flag, uncertainty as uncertainty_score,
    least(1.0, 0.18 * overlap::int + 0.27 * heavy::int + 0.25 * uncertainty + 0.18 * ratio + 0.12 * distance)::double as context_risk_score, {_true_sql('api_used')}::int::double as api_used_flag, contains(coalesce(variant, ''), 'llm')::int::double as llm_variant_flag, contains(coalesce(variant, ''), 'rule')::int::double as rule_variant_flag, en::int::double as language_en_flag, fr::int::double as language_fr_flag, zh::int::double as language_zh_flag, (not (en or fr or zh))::int::double as language_other_flag,
    {", ".join(f"contains(coalesce(source_experiment, ''), '{name}')::int::double as source_{name}_flag" for name in ("term_rescue", "overlap_safety", "independent"))}, {_size_sql('expected_terms')}::double as expected_term_count, coalesce({_number_sql('text_error_before')}, 0.0) as text_error_before,
    ({_size_sql('expected_terms')} = 0 or contains(lower(coalesce(expected_safe_behavior, '')), 'negative control') or contains(lower(context), 'physical rack') or contains(lower(coalesce(expected_safe_behavior, '')), 'normal word'))::int::double as negative_control_flag, {_true_sql('needs_review')}::int::double as needs_review_input_flag, {_true_sql('correction_rejected')}::int::double as correction_rejected_input_flag,
    0.0 as true_positive_term_count, 0.0 as false_positive_term_count, {_size_sql('missed_terms')}::double as missed_term_count, 0.0 as term_precision, 0.0 as term_recall, coalesce({_number_sql('term_f1')}, 0.0) as term_f1, coalesce({_number_sql('text_error_after')}, {_number_sql('text_error_before')}, 0.0) as text_error_after,
    coalesce({_number_sql('text_error_before')}, 0.0) - coalesce({_number_sql('text_error_after')}, {_number_sql('text_error_before')}, 0.0) as error_delta, coalesce(try_cast(unsupported_change_count as double), {_size_sql('unsupported_changes')})::double as unsupported_change_count, 0.0 as forbidden_change_count, {_true_sql('invented_content')}::int::double as invented_content_flag, {_true_sql('speaker_attribution_changed')}::int::double as speaker_attribution_changed_flag from d2)"""
_rounded = ", ".join(f"round({name}::double, 9) as {name}" for name in gate_features.AUDIT_AWARE)
_LABELED_SQL = f"""{_FEATURES_SQL}, told as (select *, list_filter([case when correction_rejected_input_flag > 0 then 'explicitly rejected' end, case when invented_content_flag > 0 then 'invented content' end, case when speaker_attribution_changed_flag > 0 then 'speaker attribution changed' end, case when forbidden_change_count > 0 then 'forbidden change' end, case when unsupported_change_count > 0 then 'unsupported change' end,
    case when trim(coalesce(correction_error, '')) <> '' then 'strict correction validation failed' end, case when safety_pass is not null and not {_true_sql('safety_pass')} then 'safety policy failed' end], lambda x: x is not null) as told, trim(raw_text) = trim(corrected_text) as same from featured),
  labeled as (select *, case when len(told) > 0 then 'reject' when needs_review_input_flag > 0 then 'needs_review' when same and expected_term_count > 0 and missed_term_count > 0 then 'needs_review' when error_delta < -1e-9 then 'reject' else 'accept' end as label,
    case when len(told) > 0 then array_to_string(told, '; ') when needs_review_input_flag > 0 then 'source audit requested human review' when same and expected_term_count > 0 and missed_term_count > 0 then 'supported target remains unresolved' when error_delta < -1e-9 then 'correction increased reference text error' when same and negative_control_flag > 0 then 'negative-control text safely preserved' else 'supported correction or safe preservation' end as label_reason,
    len(told) = 0 and needs_review_input_flag = 0 and same and expected_term_count > 0 and missed_term_count > 0 as ambiguous from told)"""


@query(f"with recursive {_FEATURES_SQL} select clip_id, idx, {_rounded} from featured")
def gate_features_of_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = gate_features.features(decisions(spark, sf_dir))
    return featured.select("clip_id", "idx", *(F.round(name, 9).alias(name) for name in gate_features.AUDIT_AWARE))


@query(f"with recursive {_LABELED_SQL} select clip_id, idx, label, label_reason, ambiguous from labeled")
def gate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_features.labels(gate_features.features(decisions(spark, sf_dir))).select("clip_id", "idx", "label", "label_reason", "ambiguous")


@query(f"""with recursive {_FEATURES_SQL} select clip_id, idx, case when correction_rejected_input_flag > 0 or unsupported_change_count > 0 or forbidden_change_count > 0 or invented_content_flag > 0 or speaker_attribution_changed_flag > 0 then 'reject' when needs_review_input_flag > 0 or heavy_overlap_flag > 0 then 'needs_review' else 'accept' end as policy,
  case when changed_token_ratio >= 0.75 and retrieval_candidate_count = 0 and overlap_flag = 0 then 'reject' when heavy_overlap_flag > 0 or uncertainty_score >= 0.9 or (overlap_flag > 0 and (changed_token_ratio >= 0.25 or edit_distance_ratio >= 0.2)) then 'needs_review' else 'accept' end as predecision,
  case when llm_variant_flag <= 0 then 'accept' when correction_rejected_input_flag > 0 then 'reject' when needs_review_input_flag > 0 then 'needs_review' else 'accept' end as llm from featured""")  # fmt: skip
def rule_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = gate_features.features(decisions(spark, sf_dir))
    return featured.select("clip_id", "idx", gate_features.policy_baseline().alias("policy"), gate_features.predecision_baseline().alias("predecision"), gate_features.llm_baseline().alias("llm"))


# ---- confidences of anchors


@query(f"with {SHIFTED_SQL}, conf as (select clip_id, speaker, min(case when idx % 4 = 1 then 0.9 else (idx % 10) / 10.0 + 0.0004 end) as least from hyp group by 1, 2) select t.clip_id, t.idx as id, coalesce(round(least, 3), 0.5)::double as confidence from turns t left join conf on t.clip_id = conf.clip_id and t.speaker = conf.speaker and t.idx % 6 <> 5")
def least_turn_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    i = F.col("idx")
    said = shifted(turns).withColumn("confidence", F.when(i % 4 != 1, (i % 10) / 10 + F.lit(0.0004)))
    speakers = F.when(i % 6 != 5, F.array("speaker")).otherwise(F.array().cast("array<string>"))
    return meetings.least_turn_confidence(turns.select("clip_id", i.alias("id"), speakers.alias("speakers")), said)


@query(f"""with {WORDS_SQL}, a as (select clip_id, idx as id, start_ms + 100 as start_ms, least(end_ms, start_ms + 900) as end_ms from turns), s as (select clip_id, idx as seg, start_ms, end_ms, case when idx % 3 <> 0 then -(idx % 5) / 4.0 end as log_p from turns where idx % 7 <> 6),
  w as (select clip_id, idx as seg, start_ms, end_ms, (pos % 10) / 10.0 as p from words where idx % 4 <> 1 and pos % 5 <> 3), first_of as (select a.clip_id, a.id, min(seg) as seg from a left join s on a.clip_id = s.clip_id and least(a.end_ms, s.end_ms) > greatest(a.start_ms, s.start_ms) group by 1, 2),
  means as (select a.clip_id, a.id, avg(p) as mean from a join first_of f using (clip_id, id) join w on w.clip_id = a.clip_id and w.seg = f.seg and least(a.end_ms, w.end_ms) > greatest(a.start_ms, w.start_ms) group by 1, 2)
  select f.clip_id, f.id, coalesce(round(mean, 3), round(least(greatest(1 + log_p, 0), 1), 3), 0.75)::double as probability from first_of f left join s on s.clip_id = f.clip_id and s.seg = f.seg left join means m on m.clip_id = f.clip_id and m.id = f.id""")  # fmt: skip
def anchor_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    i = F.col("idx")
    own = turns.select("clip_id", i.alias("id"), (F.col("start_ms") + 100).alias("start_ms"), F.least("end_ms", F.col("start_ms") + 900).alias("end_ms"))
    segments = turns.where("idx % 7 <> 6").select("clip_id", i.alias("id"), "start_ms", "end_ms", F.when(i % 3 != 0, -(i % 5) / 4).alias("avg_logprob"))
    p = F.col("pos") % 10 / 10
    words = conversation_words(turns).where("idx % 4 <> 1").select("clip_id", i.alias("segment"), "start_ms", "end_ms", F.when(F.col("pos") % 5 != 3, p).alias("probability"))
    return meetings.anchor_probability(own, segments, words)
