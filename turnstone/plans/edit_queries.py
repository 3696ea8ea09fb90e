"""Queries over the edits between transcripts and references, with their SQL: blocks are found by a recursive query there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import alignment, edit_errors
from turnstone.plans.normal_sql import wer_sql
from turnstone.sources.tables import TURNS_SQL, conversation_turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def edits_sql(leave_out_common: bool = False) -> str:
    """SQL tables from pairs (id, a, b: lists) to edits (id, place, op, a0, a1, b0, b1: from 0, the ends outside)."""
    seeds = "places"
    if leave_out_common:
        seeds = f"(select places.* from places join sizes using (id) left join often using (id, w) where n_b < {alignment.COMMON_FROM} or coalesce(often.n, 0) <= n_b // {alignment.COMMON_SHARE} + 1)"
    return f"""sizes as (select id, len(a) as n_a, len(b) as n_b from pairs),
  a_words as (select id, unnest(a) as w, generate_subscripts(a, 1) - 1 as i from pairs), b_words as (select id, unnest(b) as w, generate_subscripts(b, 1) - 1 as j from pairs),
  often as (select id, w, count(*) as n from b_words group by 1, 2), places as (select id, w, i, j from a_words join b_words using (id, w)),
  seed_places as (select * from {seeds}),
  runs as materialized (select id, i, j, count(*) over all_of - row_number() over in_order + 1 as run, row_number() over in_order as back from (select id, i, j, i - row_number() over (partition by id, j - i order by i) as g from places) window all_of as (partition by id, j - i, g), in_order as (partition by id, j - i, g order by i)),
  seeded as materialized (select id, i, j, count(*) over all_of - row_number() over in_order + 1 as run from (select id, i, j, i - row_number() over (partition by id, j - i order by i) as g from seed_places) window all_of as (partition by id, j - i, g), in_order as (partition by id, j - i, g order by i)),
  parts as (select id, 0::bigint as al, n_a::bigint as ah, 0::bigint as bl, n_b::bigint as bh, -1::bigint as i, -1::bigint as j, 0::bigint as k from sizes union all
    select id, case side when 0 then al else i + k end, case side when 0 then i else ah end, case side when 0 then bl else j + k end, case side when 0 then j else bh end, i, j, k from (
      select f.id, al, ah, bl, bh, f.i - case when x.id is null then 0 else least(x.back, f.i - al, f.j - bl) end as i, f.j - case when x.id is null then 0 else least(x.back, f.i - al, f.j - bl) end as j,
        f.k + case when x.id is null then 0 else least(x.back, f.i - al, f.j - bl) end + case when y.id is null then 0 else least(y.run, ah - f.i - f.k, bh - f.j - f.k) end as k from (
        select id, al, ah, bl, bh, coalesce(best.i, al) as i, coalesce(best.j, bl) as j, coalesce(-best.k, 0) as k from (
          select p.id, al, ah, bl, bh, min(struct_pack(k := -least(s.run, ah - s.i, bh - s.j), i := s.i, j := s.j)) filter (s.id is not null) as best
          from parts p left join seeded s on s.id = p.id and s.i >= al and s.i < ah and s.j >= bl and s.j < bh where al < ah and bl < bh group by all)) f
      left join runs x on x.id = f.id and x.i = f.i - 1 and x.j = f.j - 1 left join runs y on y.id = f.id and y.i = f.i + f.k and y.j = f.j + f.k), (select unnest([0, 1]) as side) where k > 0),
  blocks as (select distinct id, i, j, k from parts where k > 0 union all select id, n_a, n_b, 0 from sizes),
  gaps as (select id, coalesce(lag(i + k) over w, 0) as a0, i as a1, coalesce(lag(j + k) over w, 0) as b0, j as b1 from blocks window w as (partition by id order by i, k desc)),
  edits as (select id, row_number() over (partition by id order by a0, b0) - 1 as place, case when a0 < a1 and b0 < b1 then 'replace' when a0 < a1 then 'delete' else 'insert' end as op, a0, a1, b0, b1 from gaps where a0 < a1 or b0 < b1)"""


#: What the reference says and the transcript has instead, put into turns in turn, so that every rule has its cases.
PLANTED = (
    ("262 cents a share", "262 seems to share"), ("gonna", "going to"), ("march 2021", "march twenty"), ("dividend", "divided"), ("um", ""), ("the the the", ""), ("year on year", "year-on-year"), ("he", "she"),
    ("one percent", "won percent"), ("", "uh"), ("strong quarter", "long water"), ("may five", "may"), ("revenue growth", "avenue growth"), ("of", ""),
)
_list = lambda at: "[" + ", ".join("[" + ", ".join(f"'{w}'" for w in pair[at].split()) + "]::varchar[]" for pair in PLANTED) + "]"
_WORDS_SQL = f"list_filter(string_split({wer_sql('coalesce(text, ' + chr(39) * 2 + ')')}, ' '), lambda w: w <> '')"
TRANSCRIPTS_SQL = f"""{TURNS_SQL}, cut as (select clip_id, idx, speaker, {_WORDS_SQL} as ws, ((clip_id * 31 + idx) % {len(PLANTED)})::int + 1 as p from turns),
  transcripts as (select clip_id, idx, 'd' || clip_id % 3 as dataset_name, speaker as language, 'm' || idx % 2 as model_name, (idx % 10) / 20.0 as error_rate, case when idx % 3 <> 0 then (idx % 10) / 25.0 end as cleaned_error_rate,
    list_concat(list_concat(ws[1:3], {_list(0)}[p]), ws[4:]) as reference, list_concat(list_concat(ws[1:3], {_list(1)}[p]), list_filter(list_transform(ws[4:], lambda w, i: case when i % 11 = 7 then w || 's' else w end), lambda w, i: i % 9 <> 4)) as hypothesis from cut)"""
_ERRORS_SQL = f"""{TRANSCRIPTS_SQL}, pairs as (select clip_id * 100000 + idx as id, reference as a, hypothesis as b from transcripts), {edits_sql()},
  spans as (select t.*, place, op, a[a0 + 1:a1] as removed, b[b0 + 1:b1] as added, a[greatest(a0 - 1, 1):a1 + 2] as ca, b[greatest(b0 - 1, 1):b1 + 2] as cb from edits join pairs using (id) join transcripts t on id = t.clip_id * 100000 + t.idx),
  flags as (select *, list_concat(removed, added) as actual, list_concat(ca, cb) as context from spans)"""


def _in(words) -> str:
    return "w in (" + ", ".join(f"'{word}'" for word in words) + ")"


_has = lambda which, test: f"len(list_filter({which}, lambda w: {test})) > 0"
_NUMBER = f"(regexp_full_match(w, '\\p{{Nd}}+') or {_in(edit_errors.NUMBER_WORDS)})"
_STYLE = " or ".join(f"(l = '{a}' and r = '{b}') or (l = '{b}' and r = '{a}')" for a, b in edit_errors.SAME_MEANING)
_CATEGORY = f"""case when {_has("context", _in(edit_errors.MONTHS) + " or regexp_full_match(w, '\\p{Nd}{4}')")} and {_has("context", _NUMBER)} then 'date_time_error'
  when {_has("context", _NUMBER)} and {_has("context", _in(edit_errors.UNITS))} then 'number_unit_error' when {_has("actual", _in(edit_errors.FINANCE_WORDS))} then 'domain_term_error'
  when {_has("actual", _in(edit_errors.DISFLUENCIES))} or (len(added) = 0 and len(removed) > 1 and len(list_distinct(removed)) = 1) or {_STYLE} then 'disfluency_or_style_error'
  when len(actual) > 0 and not {_has("actual", "not " + _in(edit_errors.FUNCTION_WORDS))} then 'function_word_error' when op in ('delete', 'insert') then 'omission_or_insertion' else 'semantic_word_error' end"""
_CLASSIFIED_SQL = f"{_ERRORS_SQL}, named as (select *, coalesce(array_to_string(removed, ' '), '') as l, coalesce(array_to_string(added, ' '), '') as r from flags), classified as (select *, {_CATEGORY} as category from named)"
_about_sql = lambda at: "case category " + " ".join(f"when '{name}' then '{texts[at]}'" for name, texts in edit_errors.CATEGORIES.items()) + " end"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as references, and transcripts that lack words, have wrong ones and a planted error each."""
    i = F.col("idx")
    words = F.filter(F.split(T.wer_normal(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")
    listed = lambda at: F.array(*(F.array(*map(F.lit, pair[at].split())).cast("array<string>") for pair in PLANTED))
    cut = conversation_turns(spark, sf_dir).select("clip_id", "idx", "speaker", words.alias("ws"), ((F.col("clip_id") * 31 + i) % len(PLANTED)).cast("int").alias("p"))
    head, tail = F.slice("ws", 1, 3), F.slice("ws", F.lit(4), F.greatest(F.size("ws") - 3, F.lit(0)))
    heard = F.filter(F.transform(tail, lambda w, k: F.when((k + 1) % 11 == 7, F.concat(w, F.lit("s"))).otherwise(w)), lambda w, k: (k + 1) % 9 != 4)
    return cut.select(
        "clip_id", "idx", F.concat(F.lit("d"), (F.col("clip_id") % 3).cast("string")).alias("dataset_name"), F.col("speaker").alias("language"), F.concat(F.lit("m"), (i % 2).cast("string")).alias("model_name"),
        ((i % 10) / 20).alias("error_rate"), F.when(i % 3 != 0, (i % 10) / 25).alias("cleaned_error_rate"),
        F.concat(head, F.get(listed(0), F.col("p")), tail).alias("reference"), F.concat(head, F.get(listed(1), F.col("p")), heard).alias("hypothesis"),
    )


_MODEL = ["dataset_name", "language", "model_name"]
_ORDER = ["clip_id", "idx", "place"]


@query(f"with recursive {_CLASSIFIED_SQL} select clip_id, idx, place, op, category, {_about_sql(0)} as impact, l as removed, r as added from classified")
def edit_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of every transcript with its category."""
    errors = edit_errors.classify(transcripts(spark, sf_dir), ["clip_id", "idx"])
    return errors.select("clip_id", "idx", "place", "op", "category", "impact", F.array_join("removed", " ").alias("removed"), F.array_join("added", " ").alias("added"))


_RATES_SQL = "rates as (select dataset_name, language, model_name, count(*) as n_rows, avg(error_rate) as wer, avg(coalesce(cleaned_error_rate, error_rate)) as cleaned from transcripts group by all)"


@query(f"""with recursive {_CLASSIFIED_SQL}, {_RATES_SQL}, counts as (select dataset_name, language, model_name, category, count(*) as n, first(l order by clip_id, idx, place) as example_reference, first(r order by clip_id, idx, place) as example_hypothesis from classified group by all)
  select dataset_name, language, model_name, category, n, round(n / sum(n) over (partition by dataset_name, language, model_name), 6) as share, round(wer, 6) as mean_wer, round(cleaned, 6) as mean_cleaned_wer, example_reference, example_hypothesis, {_about_sql(2)} as recommendation from counts join rates using (dataset_name, language, model_name)""")  # fmt: skip
def edit_category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts(spark, sf_dir)
    return edit_errors.category_summary(rows, edit_errors.classify(rows, [*_MODEL, "clip_id", "idx"]), _MODEL, _ORDER)


@query(f"""with recursive {_CLASSIFIED_SQL}, {_RATES_SQL}, counts as (select dataset_name, language, model_name, category, count(*) as n, min(struct_pack(a := clip_id, b := idx, c := place)) as seen from classified group by all),
  top as (select *, row_number() over (partition by dataset_name, language, model_name order by n desc, seen) as rank from counts qualify rank <= 5), joined as (select dataset_name, language, model_name, '[' || string_agg('["' || category || '", ' || n || ']', ', ' order by rank) || ']' as top_categories from top group by all)
  select dataset_name, language, model_name, n_rows, round(wer, 6) as mean_wer, round(cleaned, 6) as mean_cleaned_wer, round(wer - cleaned, 6) as gap, coalesce(top_categories, '[]') as top_categories from rates left join joined using (dataset_name, language, model_name)""")  # fmt: skip
def edit_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts(spark, sf_dir)
    return edit_errors.model_summary(rows, edit_errors.classify(rows, [*_MODEL, "clip_id", "idx"]), _MODEL, _ORDER)
