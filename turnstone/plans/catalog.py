"""Registry of the meeting-analytics queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnstone.plans import audit_queries, document_queries, edit_queries, file_queries, gate_queries, interval_queries, learning_queries, matching_queries, reply_queries, report_queries, retrieval_queries, review_queries, rollup_queries, selection_queries, text_queries, workflow_queries

FLAGSHIP = "overlap_regions"
_PARTS = (interval_queries, text_queries, rollup_queries, matching_queries, review_queries, report_queries, file_queries, learning_queries, workflow_queries, edit_queries, gate_queries, audit_queries, selection_queries, document_queries, reply_queries, retrieval_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
