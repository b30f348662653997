"""The corpus pipeline; its stages live in ``cairnfield.llm.pipeline``."""

from cairnfield.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
