"""Queries of reviews, safety, views and joins of meetings, with their SQL.

Corrections are made up from the test texts: a turn's raw text, a changed one by its number, and flags by its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import evidence, intervals, meetings, review
from turnstone.plans.normal_sql import wer_sql
from turnstone.plans.interval_queries import OVERLAPS_SQL, SHIFTED_SQL, shifted
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


@query(f"select doc_id, md5({wer_sql('text')}) as wer_md5, md5(regexp_replace(lower(nfc_normalize(text)), '[\\p{{P}}\\s]', '', 'g')) as cer_md5 from documents")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as word and character error rates see them; the test texts need no compatibility composition."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.wer_normal(F.col("text"))).alias("wer_md5"), F.md5(T.cer_normal(F.col("text"))).alias("cer_md5"))


_TOKENS = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
#: raw, corrected and flags of each turn but the first of its clip; corrections take words of the turn before.
_CORRECTIONS_SQL = TURNS_SQL + f""", c0 as (select a.clip_id, a.idx, {_TOKENS.format(x='a.text')} as raw, {_TOKENS.format(x='b.text')} as other from turns a join turns b on a.clip_id = b.clip_id and a.idx = b.idx + 1),
  c as (select clip_id, idx, raw, case idx % 3 when 0 then raw when 1 then list_concat(raw, other[1:2]) else list_concat(other[1:4], raw) end as corrected, other[1:1] as supported from c0)"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir).select("clip_id", "idx", T.tokens(F.col("text")).alias("raw"))
    other = turns.select("clip_id", (F.col("idx") + 1).alias("idx"), F.col("raw").alias("other"))
    part = lambda n: F.slice("other", 1, n)
    new = F.when(F.col("idx") % 3 == 0, F.col("raw")).when(F.col("idx") % 3 == 1, F.concat("raw", part(2))).otherwise(F.concat(part(4), F.col("raw")))
    return turns.join(other, ["clip_id", "idx"]).select("clip_id", "idx", "raw", new.alias("corrected"), part(1).alias("supported"))


_ADDED = "list_filter(list_distinct(corrected), lambda w: not list_contains(raw, w))"


@query(f"with {_CORRECTIONS_SQL}, u as (select *, list_sort(list_filter({_ADDED}, lambda w: not list_contains(supported, w))) as un from c) select clip_id, idx, array_to_string(un, ' ') as unsupported, len(un) > 0 or len(corrected) > len(raw) + 2 as invented, raw = corrected and len(un) = 0 as valid from u")
def correction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsupported tokens, invented content, and whether the output is what the (empty) rules give."""
    raw, new, known = F.col("raw"), F.col("corrected"), F.col("supported")
    return corrections(spark, sf_dir).select(
        "clip_id", "idx", F.array_join(review.unsupported_tokens(raw, new, known), " ").alias("unsupported"), review.invented_content(raw, new, known).alias("invented"), review.rule_output_valid(raw, new, raw, known).alias("valid"),
    )


_FLAGS_SQL = _CORRECTIONS_SQL + f""", f as (select *, case idx % 4 when 0 then 'retain' when 1 then 'reject' else 'correct_supported' end as expected, idx % 5 = 0 as rejected, idx % 2 = 0 as review, idx % 6 <> 1 as expected_review, idx % 7 = 3 as moved, list_sort(list_filter({_ADDED}, lambda w: not list_contains(supported, w))) as un from c),
  g as (select *, len(un) > 0 or len(corrected) > len(raw) + 2 as invented, (contains(array_to_string(corrected, ' '), ' the ') and not contains(array_to_string(raw, ' '), ' the '))::int as n_forbidden, expected in ('retain', 'reject') and raw <> corrected as overcorrected from f)"""


@query(f"with {_FLAGS_SQL} select clip_id, idx, len(un) as n_unsupported, invented, n_forbidden, moved as speaker_changed, overcorrected, expected = 'correct_supported' and rejected as too_careful, not (len(un) > 0 or invented or n_forbidden > 0 or moved or review <> expected_review or overcorrected) and (expected <> 'reject' or rejected) as safe from g")
def safety_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corrections(spark, sf_dir)
    i = F.col("idx")
    rows = rows.select(
        "clip_id", "idx", F.array_join("raw", " ").alias("raw"), F.array_join("corrected", " ").alias("corrected"), "supported", F.array(F.lit(" the ")).alias("forbidden"), F.array(F.lit("a")).alias("speakers"),
        F.when(i % 7 == 3, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("new_speakers"), F.when(i % 4 == 0, "retain").when(i % 4 == 1, "reject").otherwise("correct_supported").alias("expected"),
        (i % 5 == 0).alias("rejected"), (i % 2 == 0).alias("review"), (i % 6 != 1).alias("expected_review"),
    )
    return review.safety_flags(rows).select("clip_id", "idx", F.size("unsupported").alias("n_unsupported"), "invented", "n_forbidden", "speaker_changed", "overcorrected", "too_careful", "safe")


# ---- views and joins of meetings


def turn_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as anchors, with flags by their number."""
    i = F.col("idx")
    return conversation_turns(spark, sf_dir).select("clip_id", i.alias("id"), "speaker", F.array("speaker").alias("speakers"), "text", "start_ms", "end_ms", (i % 3 == 0).alias("overlap"), (i % 4 == 0).alias("needs_review"))


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shifted(conversation_turns(spark, sf_dir)).withColumnRenamed("idx", "id")


@query(f"with {SHIFTED_SQL} select t.clip_id, t.idx as id, min(h.idx) as segment from turns t left join hyp h on t.clip_id = h.clip_id and least(t.end_ms, h.end_ms) > greatest(t.start_ms, h.start_ms) group by 1, 2")
def first_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meetings.first_segment(turn_anchors(spark, sf_dir), moved(spark, sf_dir))


@query(f"with {TURNS_SQL}, e as (select clip_id, idx as id, start_ms + 300 as start_ms, start_ms + 700 as end_ms, case when idx % 3 = 0 then [0, 1, 900] when idx % 3 = 1 then [901] else [] end as ids from turns), named as (select distinct e.clip_id, e.id, t.idx as anchor from (select clip_id, id, unnest(ids) as x from e) e join turns t on t.clip_id = e.clip_id and t.idx = e.x), met as (select e.clip_id, e.id, t.idx as anchor from e anti join named using (clip_id, id) join turns t on t.clip_id = e.clip_id and least(e.end_ms, t.end_ms) > greatest(e.start_ms, t.start_ms)) select e.clip_id, e.id, coalesce(array_to_string(list_sort(list(anchor) filter (anchor is not null)), ','), '') as anchors from e left join (from named union all from met) using (clip_id, id) group by 1, 2")
def event_anchor_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("idx")
    ids = F.when(i % 3 == 0, F.array(F.lit(0), F.lit(1), F.lit(900))).when(i % 3 == 1, F.array(F.lit(901))).otherwise(F.array().cast("array<int>"))
    events = conversation_turns(spark, sf_dir).select("clip_id", i.alias("id"), (F.col("start_ms") + 300).alias("start_ms"), (F.col("start_ms") + 700).alias("end_ms"), ids.alias("anchor_ids"))
    found = meetings.events_with_anchors(events, turn_anchors(spark, sf_dir))
    return found.select("clip_id", "id", F.array_join("anchors", ",").alias("anchors"))


@query(f"with {WORDS_SQL}, win as (select clip_id, idx as w, start_ms + 150 as ws, start_ms + 1050 as we from turns where idx % 5 = 0) select w.clip_id, win.w as window, w.idx * 100000 + w.pos as id, greatest(start_ms, ws) as start_ms, least(end_ms, we) as end_ms from words w join win on w.clip_id = win.clip_id and least(end_ms, we) > greatest(start_ms, ws)")
def words_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    windows = turns.where("idx % 5 = 0").select("clip_id", F.col("idx").alias("id"), (F.col("start_ms") + 150).alias("start_ms"), (F.col("start_ms") + 1050).alias("end_ms"))
    words = conversation_words(turns).select("clip_id", (F.col("idx") * 100000 + F.col("pos")).alias("id"), "start_ms", "end_ms")
    return meetings.words_in_windows(words, windows)


@query(f"with {TURNS_SQL} select a.clip_id, a.idx, bool_or(b.idx is not null) as overlap from turns a left join turns b on a.clip_id = b.clip_id and a.idx <> b.idx and least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= 50 group by 1, 2")
def overlap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that overlap another one of their clip, on both sides of each pair."""
    return intervals.flagged_by_overlap(conversation_turns(spark, sf_dir)).select("clip_id", "idx", "overlap")


@query(f"with {TURNS_SQL}, l as (select clip_id, max(end_ms) as len from turns group by 1) select clip_id, idx, greatest(0, start_ms - 2000) as low_ms, greatest(greatest(0, start_ms - 2000), least(end_ms + 2000, len)) as high_ms from turns join l using (clip_id)")
def padded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.max("end_ms").over(Window.partitionBy("clip_id"))
    low, high = meetings.padded_window(F.col("start_ms"), F.col("end_ms"), 2000, F.col("length"))
    return conversation_turns(spark, sf_dir).withColumn("length", length).select("clip_id", "idx", low.alias("low_ms"), high.alias("high_ms"))


@query(f"with {TURNS_SQL} select clip_id, variant, count(*) as n, sum(case when variant = 'asr_only' then 0 else end_ms - start_ms end)::bigint as ms from turns, (select unnest(['asr_only', 'diarized', 'full']) as variant) group by 1, 2")
def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = meetings.variants(conversation_turns(spark, sf_dir), ("asr_only", "diarized", "full"))
    ms = F.when(F.col("variant") == "asr_only", 0).otherwise(F.col("end_ms") - F.col("start_ms"))
    return rows.groupBy("clip_id", "variant").agg(F.count("*").alias("n"), F.sum(ms).alias("ms"))


@query(f"with {OVERLAPS_SQL} select clip_id, speaker as lane, start_ms, end_ms from turns union all select clip_id, 'OVERLAP', start_ms, end_ms from regions")
def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    return meetings.timeline(turns, intervals.overlap_regions(turns))


@query(f"with {TURNS_SQL} select clip_id, idx as id, coalesce(lane, 'UNKNOWN') as lane, start_ms, end_ms from (select *, unnest(case idx % 3 when 0 then [speaker, 'other'] when 1 then [speaker] else [null] end) as lane from turns)")
def anchor_lane_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_anchors(spark, sf_dir)
    speakers = F.when(F.col("id") % 3 == 0, F.array(F.col("speaker"), F.lit("other"))).when(F.col("id") % 3 == 1, F.array("speaker")).otherwise(F.array().cast("array<string>"))
    return meetings.anchor_lanes(rows.withColumn("speakers", speakers))


@query(f"with {TURNS_SQL} select clip_id, idx as id, case when idx % 2 = 0 then speaker else 'UNKNOWN' end as speaker, false as overlap, idx % 2 <> 0 as needs_review from turns")
def single_speaker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_anchors(spark, sf_dir).withColumn("speakers", F.when(F.col("id") % 2 == 0, F.array("speaker", F.lit("z"))).otherwise(F.array().cast("array<string>")))
    return meetings.single_speaker_view(rows).select("clip_id", "id", "speaker", "overlap", "needs_review")


@query(f"with {TURNS_SQL}, one as (select clip_id, min(start_ms) as a, max(end_ms) as z from turns group by 1) select t.clip_id, count(*) as n, sum(greatest(0, least(z, end_ms) - greatest(a, start_ms)))::bigint as covered_ms, 'UNKNOWN' as speaker from turns t join one using (clip_id) group by 1")
def no_diarization_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    one = meetings.no_diarization(turns).select("clip_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("z"), F.col("speaker").alias("said"))
    met = turns.join(one, "clip_id")
    return met.groupBy("clip_id", F.col("said").alias("speaker")).agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0), F.least("z", "end_ms") - F.greatest("a", "start_ms"))).alias("covered_ms"))


@query(f"with {TURNS_SQL} select clip_id, case when clip_id % 5 = 0 then null else round(avg(case when idx % 7 = 2 then 1.0 else 0.0 end), 6) end as error from turns group by 1")
def positional_label_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("idx", c.alias("v")))), lambda x: x["v"])
    said = F.when(F.col("idx") % 7 == 2, "other").otherwise(F.col("speaker"))
    rows = conversation_turns(spark, sf_dir).groupBy("clip_id").agg(listed(F.col("speaker")).alias("ref"), listed(said).alias("pred"))
    pred = F.when(F.col("clip_id") % 5 == 0, F.concat("pred", F.array(F.lit("x")))).otherwise(F.col("pred"))
    return rows.select("clip_id", meetings.label_error(F.col("ref"), pred).alias("error"))


@query(f"with {SHIFTED_SQL}, m as (select t.clip_id, t.idx, t.idx % 2 = 0 as ro, h.idx % 3 = 0 as ho, row_number() over (partition by t.clip_id, t.idx order by coalesce(least(t.end_ms, h.end_ms) - greatest(t.start_ms, h.start_ms), 0) desc, abs(t.start_ms - h.start_ms) + abs(t.end_ms - h.end_ms), h.idx) as place from turns t left join hyp h on t.clip_id = h.clip_id and h.start_ms < t.end_ms and t.start_ms < h.end_ms) select clip_id, count(*) as n, count_if(ro <> coalesce(ho, false)) as wrong from m where place = 1 group by 1")
def overlap_flag_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    met = intervals.best_overlap_match(turns, shifted(turns))
    return meetings.overlap_flag_error(met.select("clip_id", (F.col("ref_idx") % 2 == 0).alias("ref_overlap"), (F.col("hyp_idx") % 3 == 0).alias("hyp_overlap")))


@query(f"with {TURNS_SQL}, cuts as (select distinct x.clip_id, y.start_ms, x.end_ms, x.speaker || '+' || y.speaker as speakers from turns x join turns y on x.clip_id = y.clip_id where x.speaker <> y.speaker and y.start_ms > x.start_ms and y.end_ms > x.end_ms and x.end_ms - y.start_ms >= 200) select clip_id, clip_id || '_interruption_' || lpad(row_number() over (partition by clip_id order by start_ms, end_ms, speakers)::varchar, 3, '0') as candidate_id, start_ms, end_ms, speakers from cuts")
def interruption_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = meetings.interruption_candidates(conversation_turns(spark, sf_dir))
    return found.select("clip_id", "candidate_id", "start_ms", "end_ms", intervals.joined_speakers().alias("speakers"))


@query("with l as (select c_custkey, 'Cust-' || c_custkey as key from customer), r as (select distinct case o_custkey % 3 when 0 then 'Cust-' || o_custkey when 1 then 'cust ' || o_custkey else 'cust' || o_custkey || 'x.wav' end as candidate from orders), n as (select candidate, regexp_replace(lower(candidate), '[^a-z0-9]', '', 'g') as rn from r), m as (select key, candidate, 1 as how from l join n on key = candidate union all select key, candidate, 2 from l join n on regexp_replace(lower(key), '[^a-z0-9]', '', 'g') = rn union all select key, candidate, 3 from l join n on starts_with(rn, regexp_replace(lower(key), '[^a-z0-9]', '', 'g')) and length(rn) > length(regexp_replace(lower(key), '[^a-z0-9]', '', 'g'))) select l.key, candidate, how from l left join (select * from m qualify row_number() over (partition by key order by how, candidate) = 1) using (key)")
def prefix_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.concat(F.lit("Cust-"), F.col("c_custkey").cast("string")).alias("key"))
    k = F.col("o_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Cust-"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("cust "), k.cast("string"))).otherwise(F.concat(F.lit("cust"), k.cast("string"), F.lit("x.wav")))
    return meetings.prefix_match(left, table(spark, sf_dir, "orders").select(name.alias("name")).distinct(), "key", "name")


@query("select lower(event_type) as canonical, case user_id % 3 when 0 then 'exact' when 1 then 'fuzzy' else 'phonetic' end as method, max(value) as score, count(distinct user_id % 50) as n_anchors, (list(user_id % 50 order by event_id))[1] as first_anchor from events group by 1, 2")
def candidate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").select(F.upper("event_type").alias("canonical"), F.when(u % 3 == 0, "exact").when(u % 3 == 1, "fuzzy").otherwise("phonetic").alias("method"), F.col("value").alias("score"), (u % 50).alias("anchor_id"), F.col("event_id").alias("place"))
    return meetings.candidate_rollup(rows).select("canonical", "method", "score", F.size("anchor_ids").alias("n_anchors"), F.element_at("anchor_ids", 1).alias("first_anchor"))


@query(f"with {TURNS_SQL}, w as (select clip_id, speaker, word, count(*) as n, min(idx * 1000000 + pos) as seen from (select clip_id, speaker, idx, unnest(ws) as word, generate_subscripts(ws, 1) as pos from (select *, regexp_extract_all(lower(text), '[a-z0-9]{{6,}}') as ws from turns)) group by 1, 2, 3 qualify row_number() over (partition by clip_id, speaker order by n desc, seen) <= 6), terms as (select clip_id, speaker, string_agg(word, ' ' order by n desc, seen) as terms from w group by 1, 2) select clip_id, speaker, count(*) as n, count_if(idx % 3 = 0) as n_overlap, count_if(idx % 4 = 0) as n_review, md5(array_to_string((list(text order by idx))[1:4], '|')) as quotes_md5, any_value(terms) as terms from turns left join terms using (clip_id, speaker) group by 1, 2")
def evidence_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = meetings.evidence_cards(turn_anchors(spark, sf_dir))
    return cards.select("clip_id", "speaker", "n", "n_overlap", "n_review", F.md5(F.array_join("quotes", "|")).alias("quotes_md5"), F.array_join("terms", " ").alias("terms"))


@query(f"with {TURNS_SQL}, a as (select clip_id, idx, case when idx % 4 = 1 then '' else text end as raw from turns where idx % 3 <> 0), b as (select clip_id, idx, text || '!' as corrected from turns where idx % 2 = 0) select clip_id, idx, md5(coalesce(nullif(trim(corrected), ''), nullif(trim(raw), ''), '')) as shown_md5, raw is distinct from corrected as changed from a full join b using (clip_id, idx)")
def paired_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and corrected quotes side by side: what is shown is the corrected one, else the raw one."""
    turns = conversation_turns(spark, sf_dir)
    a = turns.where("idx % 3 <> 0").select("clip_id", "idx", F.when(F.col("idx") % 4 == 1, "").otherwise(F.col("text")).alias("raw"))
    b = turns.where("idx % 2 = 0").select("clip_id", "idx", F.concat("text", F.lit("!")).alias("corrected"))
    shown = F.coalesce(F.nullif(F.trim("corrected"), F.lit("")), F.nullif(F.trim("raw"), F.lit("")), F.lit(""))
    return a.join(b, ["clip_id", "idx"], "outer").select("clip_id", "idx", F.md5(shown).alias("shown_md5"), (~F.col("raw").eqNullSafe(F.col("corrected"))).alias("changed"))


_GLOSSARY = [("TERM ONE", ["term one"], None, ["the of", "de la"], "finance", None), ("Ouen", None, None, ["and the"], "company_name", ["is"])]


@query()
def gated_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a glossary offers for each turn, gated and applied in order; rule by rule in tests/test_evidence.py."""
    glossary = spark.createDataFrame(_GLOSSARY, evidence.GLOSSARY)
    texts = conversation_turns(spark, sf_dir).select(F.concat_ws("-", F.col("clip_id").cast("string"), F.col("idx").cast("string")).alias("id"), "text")
    offered = evidence.candidates(texts, glossary)
    done = evidence.apply_corrections(texts, offered, glossary)
    return done.select("id", F.md5("corrected").alias("corrected_md5"), F.array_join(F.transform("records", lambda r: F.concat_ws(":", r["source"], r["decision"], r["reason"])), ",").alias("records"))
