"""The corpus pipeline, quality -> toxicity -> near copies -> secrets -> packing; made in ``tideline.llm.pipeline``."""

from tideline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
