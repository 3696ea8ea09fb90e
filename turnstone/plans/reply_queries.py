"""Replies to the transcripts of whole turns, gated and scored; the SQL knows what each planted case must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import evidence, replies
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


_GLOSSARY = [("cents a share", ["cents per share"], None, ["seems to share"], "finance_unit", ["dividend"], 1), ("Zyxel Corp", ["Zyxel"], None, ["zicksel"], "company_name", ["results"], 2)]
_GOOD = '{"corrections": [{"source_text": "262 seems to share", "replacement_text": "262 cents a share", "canonical_term": "cents a share"}, 7], "needs_review": [{"source_text": "x"}]}'
_NAME = '```json\n{"corrections": [{"source_text": "zicksel", "replacement_text": "Zyxel Corp", "canonical_term": "Zyxel Corp"}, {"source_text": "zicksel", "replacement_text": "Zyxel Corp", "canonical_term": "Zyxel Corp"}]}\n```'
#: What the reference, the transcript and the corrected text begin with, the reply, whether it is asked for, words wrong before, and
#: records accepted, rejected, for review and left as they are; terms before and after, of those required.
CASES = (
    ("our dividend at 262 cents a share ", "our dividend at 262 seems to share ", "our dividend at 262 cents a share ", _GOOD, True, 2, (1, 1, 1, 0), 0.0, 1.0),
    ("nothing to see ", "nothing to say ", "nothing to say ", _GOOD, False, 1, (0, 0, 0, 0), 1.0, 1.0),
    ("the results of Zyxel Corp ", "the results of zicksel ", "the results of Zyxel Corp ", _NAME, True, 2, (1, 1, 0, 0), 0.0, 1.0),
    ("hear Zyxel Corp ", "hear zicksel ", "hear zicksel ", "Sorry, no JSON.", True, 2, (0, 1, 0, 0), 0.0, 0.0),
    ("the dividend was 5 cents per share and zicksel ", "the dividend was 5 cents per share and zicksel ", "the dividend was 5 cents per share and zicksel ",
     '{"corrections": [{"source_text": "5 cents per share", "replacement_text": "5 cents a share", "canonical_term": "cents a share"}]}', True, 0, (0, 0, 0, 1), 1.0, 1.0),
)
_values = ", ".join(f"({k}, '{ref}', '{new}', {str(asked).lower()}, {wrong}, {n[0]}, {n[1]}, {n[2]}, {n[3]}, {before}, {after})" for k, (ref, _, new, _, asked, wrong, n, before, after) in enumerate(CASES))
_SQL = f"""with {TURNS_SQL}, cases(k, ref, new, asked, wrong, n_accept, n_reject, n_needs_review, n_no_op, before, after) as (values {_values}),
  said as (select clip_id, idx, cases.*, ref || coalesce(text, '') as reference, new || coalesce(text, '') as corrected from turns join cases on k = (clip_id + idx) % {len(CASES)}), counted as (select *, len(list_filter(string_split({wer_sql('reference')}, ' '), lambda w: w <> '')) as n from said)
  select clip_id, idx, asked, md5(corrected) as corrected_md5, round(wrong / n, 6) as wer_before, round(case when ref = new then 0 else wrong end / n, 6) as wer_after, before::double as term_recall_before, after::double as term_recall_after, n_accept::bigint as n_accept, n_reject::bigint as n_reject, n_needs_review::bigint as n_needs_review, n_no_op::bigint as n_no_op from counted"""


@query(_SQL)
def reply_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replies change in every turn, in words and in terms, and what became of them."""
    cases = spark.createDataFrame([(k, ref, heard, reply) for k, (ref, heard, _, reply, *_) in enumerate(CASES)], "k int, ref string, heard string, reply string")
    turns = conversation_turns(spark, sf_dir).select("clip_id", "idx", F.coalesce("text", F.lit("")).alias("text"), ((F.col("clip_id") + F.col("idx")) % len(CASES)).cast("int").alias("k"))
    rows = turns.join(F.broadcast(cases), "k").select((F.col("clip_id") * 100_000 + F.col("idx")).alias("id"), F.concat("ref", "text").alias("reference_text"), F.concat("heard", "text").alias("hypothesis_text"), F.lit("en").alias("language"), "reply")
    glossary = spark.createDataFrame(_GLOSSARY, evidence.GLOSSARY + ", entry_place int")
    done = replies.evaluate_replies(rows.drop("reply"), rows.select("id", "reply"), glossary)
    return done.select(F.expr("id div 100000").alias("clip_id"), (F.col("id") % 100_000).alias("idx"), "asked", F.md5("corrected_text").alias("corrected_md5"), "wer_before", "wer_after", "term_recall_before", "term_recall_after", *(f"n_{name}" for name in replies.DECISIONS))
