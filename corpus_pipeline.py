"""Training-data pipeline over documents: quality, line dedup, near duplicates, decontamination, SentencePiece encoding."""

from lectern.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
