"""The training-corpus pipeline: its stages are in turnstone.llm.pipeline."""

from turnstone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
