"""Queries over turns and words, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import anchors, intervals
from turnstone.sources.tables import TURNS_SQL, WORDS_SQL, conversation_turns, conversation_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OVERLAPS_SQL = TURNS_SQL + """, ends as (select distinct clip_id, unnest([start_ms, end_ms]) as a from turns where end_ms > start_ms),
  pieces as (select clip_id, a, lead(a) over (partition by clip_id order by a) as z from ends),
  held as (select p.clip_id, a, z, list_sort(list_distinct(list(speaker))) as speakers from pieces p join turns t on p.clip_id = t.clip_id and t.start_ms <= a and z <= t.end_ms and t.end_ms > t.start_ms group by all having len(list_distinct(list(speaker))) >= 2),
  marked as (select *, case when lag(z) over w = a and lag(speakers) over w = speakers then 0 else 1 end as new from held window w as (partition by clip_id order by a)),
  islands as (select *, sum(new) over (partition by clip_id order by a) as island from marked),
  regions as (select clip_id, min(a) as start_ms, max(z) as end_ms, speakers, max(z) - min(a) as duration_ms from islands group by clip_id, island, speakers)"""
EVENTS_SQL = OVERLAPS_SQL + """, cuts as (
  select distinct x.clip_id, y.start_ms, x.end_ms, [x.speaker, y.speaker] as speakers from turns x join turns y on x.clip_id = y.clip_id
  where x.speaker <> y.speaker and y.start_ms > x.start_ms and y.end_ms > x.end_ms and x.end_ms - y.start_ms >= 200),
  found as (select clip_id, 'overlap' as type, start_ms, end_ms, speakers, case when duration_ms >= 1000 then 'high' else 'medium' end as severity from regions
    union all select clip_id, 'interruption', start_ms, end_ms, speakers, case when end_ms - start_ms >= 1000 then 'high' else 'medium' end from cuts)"""
ALIGNED_SQL = WORDS_SQL + """, aligned as (
  select *, case when len(speakers) = 0 then 'UNKNOWN' when len(speakers) = 1 then speakers[1] else 'OVERLAP' end as speaker from (
    select w.clip_id, w.idx, pos, word, w.start_ms, w.end_ms, coalesce(list_sort(list_distinct(list(t.speaker) filter (t.speaker is not null))), []) as speakers
    from words w left join turns t on w.clip_id = t.clip_id and 2 * t.start_ms <= w.start_ms + w.end_ms and w.start_ms + w.end_ms < 2 * t.end_ms group by all))"""
SESSIONS_SQL = ALIGNED_SQL + """, marked_words as (
  select *, case when lag(speaker) over w = speaker and lag(speakers) over w = speakers and start_ms - lag(end_ms) over w <= 1000 then 0 else 1 end as new
  from aligned window w as (partition by clip_id order by start_ms, end_ms, idx, pos)),
  sessions as (select *, sum(new) over (partition by clip_id order by start_ms, end_ms, idx, pos) as anchor from marked_words),
  anchors as (select clip_id, anchor, min(speaker) as speaker, min(speakers) as speakers, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_words,
    string_agg(word, ' ' order by start_ms, end_ms, idx, pos) as text, min(case speaker when 'OVERLAP' then 0.55 when 'UNKNOWN' then 0.5 else 0.9 end) as confidence from sessions group by clip_id, anchor)"""
SHIFTED_SQL = TURNS_SQL + ", hyp as (select clip_id, idx, case when idx % 5 = 4 then 'other' else speaker end as speaker, start_ms + 500 as start_ms, end_ms + 500 as end_ms from turns where idx % 4 <> 3)"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = f"with {sql}"
        return function

    return register


def shifted(turns: DataFrame) -> DataFrame:
    """A made-up hypothesis: half a second late, every fourth turn missing, every fifth of another speaker."""
    speaker = F.when(F.col("idx") % 5 == 4, "other").otherwise(F.col("speaker"))
    return turns.where("idx % 4 <> 3").select("clip_id", "idx", speaker.alias("speaker"), (F.col("start_ms") + 500).alias("start_ms"), (F.col("end_ms") + 500).alias("end_ms"))


def all_events(turns: DataFrame) -> DataFrame:
    return intervals.overlap_events(turns).unionByName(intervals.interruption_events(turns))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    return anchors.align_words(conversation_words(turns), turns)


@query(OVERLAPS_SQL + " select clip_id, start_ms, end_ms, array_to_string(speakers, '+') as speakers, duration_ms from regions")
def overlap_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_regions(conversation_turns(spark, sf_dir)).withColumn("speakers", intervals.joined_speakers())


@query(EVENTS_SQL + " select clip_id, start_ms, end_ms, array_to_string(speakers, '+') as speakers, severity, format('{}_interruption_{:03d}', clip_id, row_number() over (partition by clip_id order by start_ms, end_ms, speakers)) as event_id from found where type = 'interruption'")
def interruption_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    events = intervals.interruption_events(conversation_turns(spark, sf_dir))
    number = F.row_number().over(Window.partitionBy("clip_id").orderBy("start_ms", "end_ms", "speakers"))
    return events.select("clip_id", "start_ms", "end_ms", intervals.joined_speakers().alias("speakers"), "severity", F.format_string("%s_interruption_%03d", "clip_id", number).alias("event_id"))


@query(TURNS_SQL + " select x.clip_id, x.idx as i, y.idx as j, least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms) as overlap_ms from turns x join turns y on x.clip_id = y.clip_id and x.idx < y.idx where least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms) >= 50")
def pairwise_overlap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.pairwise_overlaps(conversation_turns(spark, sf_dir))


@query(TURNS_SQL + " select x.clip_id, x.idx as id1, y.idx as id2, least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms) as overlap_ms from turns x join turns y on x.clip_id = y.clip_id where least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms) >= 1")
def bucketed_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir).withColumnRenamed("idx", "id")
    return intervals.bucketed_pairs(turns, turns, bucket_ms=30_000)


@query(ALIGNED_SQL + " select clip_id, idx, pos, word, speaker, array_to_string(speakers, '+') as speakers, case speaker when 'OVERLAP' then 0.55 when 'UNKNOWN' then 0.5 else 0.9 end::double as confidence, case when speaker in ('OVERLAP', 'UNKNOWN') then 'uncertain' else 'high' end as confidence_label from aligned")
def word_speaker_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark, sf_dir).select("clip_id", "idx", "pos", "word", "speaker", intervals.joined_speakers().alias("speakers"), "confidence", anchors.confidence_label(F.col("confidence")).alias("confidence_label"))


@query(SESSIONS_SQL + " select clip_id, anchor::bigint as anchor, speaker, array_to_string(speakers, '+') as speakers, start_ms, end_ms, n_words, text, confidence::double as confidence from anchors")
def anchor_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.sessionize(aligned(spark, sf_dir)).withColumn("speakers", intervals.joined_speakers())


UNION_SQL = """reached as (select *, max(end_ms) over (partition by clip_id, speaker order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as r from turns where end_ms > start_ms),
  numbered as (select *, sum(case when r is null or start_ms > r then 1 else 0 end) over (partition by clip_id, speaker order by start_ms, end_ms rows unbounded preceding) as island from reached)"""


@query(TURNS_SQL + ", " + UNION_SQL + " select clip_id, speaker, min(start_ms) as start_ms, max(end_ms) as end_ms from numbered group by clip_id, speaker, island")
def speaker_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.interval_union(conversation_turns(spark, sf_dir), "clip_id", "speaker")


def _union_sql(name: str, rows: str) -> str:
    return f"""{name}_r as (select *, max(end_ms) over (partition by clip_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as r from {rows}),
  {name}_n as (select *, sum(case when r is null or start_ms > r then 1 else 0 end) over (partition by clip_id order by start_ms, end_ms rows unbounded preceding) as island from {name}_r),
  {name} as (select clip_id, min(start_ms) as start_ms, max(end_ms) as end_ms from {name}_n group by clip_id, island)"""


@query(SHIFTED_SQL + ", " + _union_sql("u", "turns") + ", " + _union_sql("v", "hyp") + """, t as (select clip_id, sum(end_ms - start_ms)::bigint as total_ms from u group by 1),
  c as (select u.clip_id, sum(least(u.end_ms, v.end_ms) - greatest(u.start_ms, v.start_ms))::bigint as covered_ms from u join v on u.clip_id = v.clip_id and v.start_ms < u.end_ms and u.start_ms < v.end_ms group by 1)
  select t.clip_id, total_ms, coalesce(covered_ms, 0)::bigint as covered_ms, round(coalesce(covered_ms, 0) / total_ms, 6) as coverage from t left join c using (clip_id)""")
def turn_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    return intervals.coverage(turns, shifted(turns))


@query(EVENTS_SQL + """ select f.clip_id, type, f.start_ms, f.end_ms, array_to_string(speakers, '+') as speakers, severity, array_to_string(list_sort(list_distinct(list(idx) filter (idx is not null))), ',') as anchor_ids
  from found f left join turns t on f.clip_id = t.clip_id and least(f.end_ms, t.end_ms) > greatest(f.start_ms, t.start_ms) group by all""")
def event_evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    linked = intervals.evidence_links(all_events(turns), turns)
    return linked.withColumn("speakers", intervals.joined_speakers()).withColumn("anchor_ids", F.array_join(F.col("anchor_ids").cast("array<string>"), ","))


@query(EVENTS_SQL + """, noted as (select *, 0 as source from found union all select clip_id, type, start_ms, end_ms, list_reverse(speakers), severity, 1 from found)
  select clip_id, type, start_ms, end_ms, array_to_string(speakers, '+') as speakers, source from noted qualify row_number() over (partition by clip_id, type, start_ms, end_ms, list_sort(speakers) order by source, speakers) = 1""")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = all_events(conversation_turns(spark, sf_dir))
    noted = events.withColumn("source", F.lit(0)).unionByName(events.withColumn("speakers", F.reverse("speakers")).withColumn("source", F.lit(1)))
    first = intervals.deduplicate_events(noted.withColumn("order", F.struct("source", "speakers")), "order")
    return first.select("clip_id", "type", "start_ms", "end_ms", intervals.joined_speakers().alias("speakers"), "source")


MATCHED_SQL = SHIFTED_SQL + """, matched as (select t.clip_id, t.idx as ref_idx, t.speaker as ref_speaker, h.idx as hyp_idx, h.speaker as hyp_speaker, t.start_ms as rs, t.end_ms as re, coalesce(least(t.end_ms, h.end_ms) - greatest(t.start_ms, h.start_ms), 0) as overlap_ms
  from turns t left join hyp h on t.clip_id = h.clip_id and h.start_ms < t.end_ms and t.start_ms < h.end_ms
  qualify row_number() over (partition by t.clip_id, t.idx order by coalesce(least(t.end_ms, h.end_ms) - greatest(t.start_ms, h.start_ms), 0) desc, abs(t.start_ms - h.start_ms) + abs(t.end_ms - h.end_ms), h.idx) = 1)"""


@query(MATCHED_SQL + " select clip_id, ref_idx, hyp_idx, hyp_speaker, overlap_ms from matched")
def best_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    return intervals.best_overlap_match(turns, shifted(turns)).select("clip_id", "ref_idx", "hyp_idx", "hyp_speaker", "overlap_ms")


@query(MATCHED_SQL + " select clip_id, sum(re - rs)::bigint as ref_ms, sum(case when hyp_speaker is not distinct from ref_speaker then 0 else re - rs end)::bigint as wrong_ms, round(sum(case when hyp_speaker is not distinct from ref_speaker then 0 else re - rs end) / sum(re - rs), 6) as wder from matched group by clip_id")
def best_match_wder(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    return intervals.diarization_error(intervals.best_overlap_match(turns, shifted(turns)))


@query(SHIFTED_SQL + " select t.clip_id, t.speaker as ref_speaker, h.speaker as pred_speaker, sum(least(t.end_ms, h.end_ms) - greatest(t.start_ms, h.start_ms))::bigint as overlap_ms from turns t join hyp h on t.clip_id = h.clip_id and h.start_ms < t.end_ms and t.start_ms < h.end_ms group by 1, 2, 3")
def speaker_overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    return intervals.speaker_overlap_matrix(turns, shifted(turns))


@query(SESSIONS_SQL + EVENTS_SQL.removeprefix(TURNS_SQL) + """, met as (
  select a.clip_id, a.anchor, a.speaker, a.speakers, a.start_ms, a.end_ms, a.confidence, coalesce(bool_or(type = 'overlap'), false) as meets, coalesce(bool_or(type = 'interruption'), false) as interruption,
    coalesce(flatten(list(f.speakers) filter (type = 'overlap')), []) as others
  from anchors a left join found f on a.clip_id = f.clip_id and least(a.end_ms, f.end_ms) > greatest(a.start_ms, f.start_ms) group by 1, 2, 3, 4, 5, 6, 7),
  joined as (select *, list_sort(list_distinct(list_concat(speakers, others))) as everyone from met)
  select clip_id, anchor::bigint as anchor, case when len(everyone) > 1 then 'OVERLAP' else speaker end as speaker, array_to_string(everyone, '+') as speakers, start_ms, end_ms, meets or speaker = 'OVERLAP' as overlap, interruption,
    case when meets or speaker = 'OVERLAP' then least(confidence, 0.55) else confidence end::double as confidence, meets or speaker = 'OVERLAP' or (len(everyone) <= 1 and speaker = 'UNKNOWN') as needs_review from joined""")
def temporal_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    found = anchors.temporal_anchors(anchors.sessionize(aligned(spark, sf_dir)).drop("n_words", "text"), all_events(turns))
    return found.withColumn("speakers", intervals.joined_speakers())


@query(TURNS_SQL + " select clip_id, speaker, sum(greatest(0, end_ms - start_ms))::bigint as speaking_ms, count(*) as n_turns, min(start_ms) as first_ms, max(greatest(0, end_ms - start_ms)) as longest_ms from turns group by 1, 2")
def speaker_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.speaker_cards(conversation_turns(spark, sf_dir))


@query(WORDS_SQL + """, terms as (select w.clip_id, t.speaker, regexp_replace(lower(word), '[^a-z]', '', 'g') as term, w.idx * 1000000 + pos as place from words w join turns t using (clip_id, idx)),
  counted as (select clip_id, speaker, term, count(*) as n, min(place) as first_at from terms where len(term) > 3 group by 1, 2, 3)
  select clip_id, speaker, row_number() over (partition by clip_id, speaker order by n desc, first_at) as rank, term, n from counted qualify rank <= 5""")
def top_terms_per_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    words = conversation_words(turns).join(turns.select("clip_id", "idx", "speaker"), ["clip_id", "idx"])
    term = F.regexp_replace(F.lower("word"), "[^a-z]", "")
    return anchors.top_terms(words.select("clip_id", "speaker", term.alias("term"), (F.col("idx") * 1000000 + F.col("pos")).alias("at")).where(F.length("term") > 3))


@query(TURNS_SQL + " select clip_id, idx, lag(speaker) over w as previous_speaker, lag(start_ms) over w as previous_ms, lead(speaker) over w as next_speaker, lead(start_ms) over w as next_ms from turns window w as (partition by clip_id order by idx)")
def lag_lead_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("clip_id").orderBy("idx")
    at = lambda f, c: f(c).over(w)
    return conversation_turns(spark, sf_dir).select("clip_id", "idx", at(F.lag, "speaker").alias("previous_speaker"), at(F.lag, "start_ms").alias("previous_ms"), at(F.lead, "speaker").alias("next_speaker"), at(F.lead, "start_ms").alias("next_ms"))


@query(TURNS_SQL + """, gaps as (select clip_id, idx, case when idx % 3 = 1 then null else start_ms end as ms from turns),
  ends as (select *, last_value(ms ignore nulls) over p as before_ms, last_value(case when ms is not null then idx end ignore nulls) over p as before_idx, first_value(ms ignore nulls) over n as after_ms, first_value(case when ms is not null then idx end ignore nulls) over n as after_idx
    from gaps window p as (partition by clip_id order by idx rows between unbounded preceding and current row), n as (partition by clip_id order by idx rows between current row and unbounded following))
  select clip_id, idx, case when ms is not null then ms when before_ms is null then after_ms when after_ms is null then before_ms + 350 * (idx - before_idx) else before_ms + (after_ms - before_ms) * (idx - before_idx) // (after_idx - before_idx) end as ms from ends""")
def interpolate_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing starts between known ones by line, before the first as the first, after the last 350 ms a turn."""
    from pyspark.sql import Window

    gaps = conversation_turns(spark, sf_dir).select("clip_id", "idx", F.when(F.col("idx") % 3 != 1, F.col("start_ms")).alias("ms"))
    w = Window.partitionBy("clip_id").orderBy("idx")
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("ms").isNotNull(), F.col("idx"))
    ends = gaps.select("clip_id", "idx", "ms", F.last("ms", True).over(past).alias("before_ms"), F.last(known, True).over(past).alias("before_idx"), F.first("ms", True).over(future).alias("after_ms"), F.first(known, True).over(future).alias("after_idx"))
    line = F.expr("before_ms + (after_ms - before_ms) * (idx - before_idx) div (after_idx - before_idx)")
    filled = F.when(F.col("ms").isNotNull(), F.col("ms")).when(F.col("before_ms").isNull(), F.col("after_ms")).when(F.col("after_ms").isNull(), F.expr("before_ms + 350 * (idx - before_idx)")).otherwise(line)
    return ends.select("clip_id", "idx", filled.alias("ms"))
