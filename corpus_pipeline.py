"""The corpus pipeline of sunledger.llm.pipeline: its stages, their SQL and run()."""

from sunledger.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
