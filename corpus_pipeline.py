"""The corpus pipeline's contract: its stages, its run, and SQL for its rows."""

from passagework.llm.pipeline import ORACLE_SQL, SIMILAR, STAGES, near_dedup, packing, quality_classifier, quality_rules, run

__all__ = ["ORACLE_SQL", "SIMILAR", "STAGES", "near_dedup", "packing", "quality_classifier", "quality_rules", "run"]
