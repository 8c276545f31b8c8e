"""A corpus for training: the stages are in scholarflow/llm/pipeline.py."""

from scholarflow.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
