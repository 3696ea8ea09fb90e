"""Queries over matched intervals, mapped speakers and streams, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import diarization, intervals, matching
from turnstone.plans.interval_queries import OVERLAPS_SQL, shifted
from turnstone.scratch import folder, written
from turnstone.sources.tables import TURNS_SQL, conversation_turns, table
from turnstone.streaming import overlaps, sessions

#: When the clips of a stream begin, in milliseconds.
_ORIGIN = 1_600_000_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _regions(turns: DataFrame) -> DataFrame:
    """Overlap regions with an id that orders a clip's regions."""
    return intervals.overlap_regions(turns).select("clip_id", F.col("start_ms").alias("id"), "start_ms", "end_ms")


@query()
def event_match_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap regions of turns against those of the made-up hypothesis; greedy matching has no SQL and is tested by hand."""
    turns = conversation_turns(spark, sf_dir)
    return matching.event_scores(_regions(turns), _regions(shifted(turns)))


@query()
def speaker_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted labels to reference speakers, one to one."""
    turns = conversation_turns(spark, sf_dir)
    return matching.map_speakers(intervals.speaker_overlap_matrix(turns, shifted(turns)))


@query()
def mapped_diarization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed, false and confused speaker time after the mapping."""
    turns = conversation_turns(spark, sf_dir)
    hypothesis = shifted(turns)
    return matching.mapped_error(turns, hypothesis, matching.map_speakers(intervals.speaker_overlap_matrix(turns, hypothesis)))


@query()
def interruption_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interruptions of turns against those of the made-up hypothesis; see tests/test_matching.py."""
    turns = conversation_turns(spark, sf_dir)
    events = lambda rows: intervals.interruption_events(rows).select("clip_id", F.xxhash64("start_ms", "end_ms", "speakers").alias("id"), "start_ms", "end_ms", "speakers")
    return matching.interruption_scores(events(turns), events(shifted(turns)))


@query()
def mapped_boundary_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean boundary error of turns of mapped speakers."""
    turns = conversation_turns(spark, sf_dir).withColumnRenamed("idx", "id")
    hypothesis = shifted(conversation_turns(spark, sf_dir)).withColumnRenamed("idx", "id")
    return matching.boundary_error(turns, hypothesis, matching.map_speakers(intervals.speaker_overlap_matrix(turns, hypothesis)))


@query()
def collar_diarization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarization error without the 250 ms around the reference's boundaries."""
    turns = conversation_turns(spark, sf_dir)
    hypothesis = shifted(turns)
    mapping = matching.map_speakers(intervals.speaker_overlap_matrix(turns, hypothesis))
    return matching.mapped_error(matching.with_collar(turns, turns, 250), matching.with_collar(hypothesis, turns, 250), mapping)


@query()
def jaccard_diarization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    hypothesis = shifted(turns)
    return matching.jaccard_error(turns, hypothesis, matching.map_speakers(intervals.speaker_overlap_matrix(turns, hypothesis)))


_SPEECH_SQL = """rows as (select cast(user_id % 8 as varchar) as speaker, ts from events),
  marked as (select *, case when ts < lag(ts) over (partition by speaker order by ts) + interval 10 minutes then 0 else 1 end as new from rows),
  numbered as (select *, sum(new) over (partition by speaker order by ts rows unbounded preceding) as session from marked)"""


@query(f"with {_SPEECH_SQL} select speaker, min(ts) as \"start\", max(ts) + interval 10 minutes as \"end\", count(*) as n from numbered group by speaker, session")
def speech_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a speaker's events by gaps in event time, over the whole table."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("string").alias("speaker"), "ts")
    return sessions.speech_sessions(events)


@query(f"with {_SPEECH_SQL} select speaker, min(ts) as \"start\", max(ts) + interval 10 minutes as \"end\", count(*) as n from numbered group by speaker, session")
def streaming_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions of a stream of the events: a mark at its end closes those that are still open."""
    base = folder(spark, "streaming-sessions")
    spark.createDataFrame([], "speaker string, ts timestamp").write.parquet(f"{base}/marks")
    stream = sessions.speech_sessions(sessions.read_event_turns(spark, sf_dir).unionByName(sessions.read_marks(spark, f"{base}/marks")))
    closed, _ = overlaps.run_to_end(stream, f"{base}/out", f"{base}/state", lambda: sessions.write_end(spark, f"{base}/marks"))
    return closed.where(F.col("speaker") != sessions.END).withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("start", "end")})


@query(f"with {OVERLAPS_SQL} select clip_id, start_ms, end_ms, array_to_string(speakers, '+') as speakers from regions")
def streaming_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps of a stream of turns, which come in four files in the order of their starts; state by clip."""
    base = folder(spark, "streaming-overlaps")
    since = lambda name: (F.col(name) + _ORIGIN).alias(name)
    turns = conversation_turns(spark, sf_dir).select(F.col("clip_id").cast("string").alias("clip_id"), "speaker", F.timestamp_millis(F.col("start_ms") + _ORIGIN).alias("ts"), since("start_ms"), since("end_ms"))
    last = (turns.agg(F.max("start_ms")).first()[0] or _ORIGIN) - _ORIGIN
    for k in range(4):
        turns.where(f"(start_ms - {_ORIGIN}) * 4 div {last + 1} = {k}").coalesce(1).write.mode("append").parquet(f"{base}/turns")
    stream = overlaps.overlap_regions(overlaps.read_turns(spark, f"{base}/turns"))
    found, _ = overlaps.run_to_end(stream, f"{base}/out", f"{base}/state", lambda: overlaps.write_end(spark, f"{base}/turns"))
    return found.select(F.col("clip_id").cast("long").alias("clip_id"), *((F.col(name) - _ORIGIN).alias(name) for name in ("start_ms", "end_ms")), intervals.joined_speakers().alias("speakers"))


@query("select date_trunc('hour', ts) as \"start\", count(*) as n, count(distinct user_id % 8) as n_speakers from events group by 1")
def activity_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and speakers of each hour of event time, over the whole table; eight speakers are counted exactly."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("string").alias("speaker"), "ts")
    return sessions.activity_by_window(events)


@query(f"with {TURNS_SQL} select clip_id, idx, sum(end_ms - start_ms) over (partition by clip_id order by idx rows unbounded preceding)::bigint as spoken_ms from turns")
def cumulative_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum of spoken time in a clip."""
    from pyspark.sql import Window

    w = Window.partitionBy("clip_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return conversation_turns(spark, sf_dir).select("clip_id", "idx", F.sum(F.col("end_ms") - F.col("start_ms")).over(w).alias("spoken_ms"))


def _scored_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns, their events but for every third, and a shifted prediction; written, as each score reads them again."""
    turns = written(conversation_turns(spark, sf_dir).drop("text"), "turns")
    numbered = lambda rows: rows.select("clip_id", F.col("idx").alias("id"), "speaker", "start_ms", "end_ms")
    return numbered(turns), written(diarization.events_of(numbered(turns)).where("id % 3 <> 0"), "events"), numbered(shifted(turns))


@query()
def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every clip without diarization and with the reference's own turns; by hand in tests/test_diarization.py."""
    reference, events, _ = _scored_turns(spark, sf_dir)
    return diarization.baselines(reference, events)


@query()
def clip_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of every clip's predicted turns, with standard errors outside the collar, with and without overlaps."""
    reference, events, predicted = _scored_turns(spark, sf_dir)
    return diarization.score_turns(reference, events, predicted, standard=True)
