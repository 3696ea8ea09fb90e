"""The workflow variants of all clips, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import workflow
from turnstone.plans.interval_queries import EVENTS_SQL, SESSIONS_SQL
from turnstone.sources.tables import TURNS_SQL, conversation_turns, conversation_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Forms that stand in the test texts, and what the rules then put in.
FORMS = (("the", "DER"), ("de la", "RAG"), ("and the", "Whisper"))


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return register


_MET_SQL = SESSIONS_SQL + EVENTS_SQL.removeprefix(TURNS_SQL) + """, met as (
  select a.clip_id, a.anchor, any_value(a.speaker) as speaker, any_value(a.speakers) as speakers, any_value(a.start_ms) as start_ms, any_value(a.end_ms) as end_ms, any_value(a.text) as text,
    coalesce(bool_or(type = 'overlap'), false) as meets, coalesce(bool_or(type = 'interruption'), false) as interruption, coalesce(flatten(list(f.speakers) filter (type = 'overlap')), []) as others
  from anchors a left join found f on a.clip_id = f.clip_id and least(a.end_ms, f.end_ms) > greatest(a.start_ms, f.start_ms) group by 1, 2),
  aware as (select *, meets or speaker = 'OVERLAP' as overlap, case when len(list_distinct(list_concat(speakers, others))) > 1 then 'OVERLAP' else speaker end as said from met),
  """ + "terms as (select *, " + " + ".join(f"contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' {form} ')::int" for form, _ in FORMS) + " as n_terms from aware)"
_LATER_SQL = "count(*) as n, count_if(said not in ('UNKNOWN', 'OVERLAP')) as n_known, count_if(overlap) as n_overlap, count_if(interruption) as n_interruption, count_if(overlap or said = 'UNKNOWN') as n_review"


@query(f"""with {_MET_SQL}, gaps as (select *, case when start_ms - lag(end_ms) over (partition by clip_id order by start_ms, end_ms, idx, pos) <= 1000 then 0 else 1 end as fresh from words)
  select 'asr_only' as variant, clip_id, 1::bigint as n, 0::bigint as n_known, 0::bigint as n_overlap, 0::bigint as n_interruption, 0::bigint as n_review, 0::bigint as n_terms, min(start_ms) as start_ms, max(end_ms) as end_ms from words group by clip_id
  union all select 'temporal_anchor_only', clip_id, sum(fresh), 0, 0, 0, sum(fresh), 0, min(start_ms), max(end_ms) from gaps group by clip_id
  union all select 'reference_speaker_time', clip_id, count(*), count_if(speaker <> 'UNKNOWN'), 0, 0, count_if(speaker = 'UNKNOWN'), 0, min(start_ms), max(end_ms) from anchors group by clip_id
  union all select 'overlap_aware', clip_id, {_LATER_SQL}, 0, min(start_ms), max(end_ms) from aware group by clip_id
  union all select unnest(['term_rescue', 'constrained_correction', 'full']), clip_id, n, n_known, n_overlap, n_interruption, n_review, n_terms, start_ms, end_ms from (select clip_id, {_LATER_SQL}, sum(n_terms)::bigint as n_terms, min(start_ms) as start_ms, max(end_ms) as end_ms from terms group by clip_id)""")
def workflow_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each clip's anchors under each variant; corrected texts are held to the rules in tests/test_workflow.py."""
    turns = conversation_turns(spark, sf_dir)
    words = conversation_words(turns)
    find = workflow.exact_terms(spark.createDataFrame(FORMS, "form string, canonical string"))
    return workflow.counters(workflow.variants(words, turns, find)).drop("n_corrected")
