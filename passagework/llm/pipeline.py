"""A corpus pipeline of four stages: rules, classifier, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes each
result to the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .near_dedup import near_duplicates
from .packing import pack
from .quality_mil import score_quality
from .quality_rules import apply_rules

#: Percent of their union that linked documents have in common.
SIMILAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule rejects, with all their columns.

    Each row is judged by its own text, whatever other rows have its id. Null and empty
    texts have too few words and go; long texts are judged whole; null ids, repeated rows
    and extra columns of any name stay as they are; an empty table stays empty.
    """
    return apply_rules(docs, carry=True).filter("kept").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts to be good, with all their columns.

    The model is fitted on labelled ids among ``docs``; null labels are left out, and
    without any label all scores are about 0.5, so nothing stays. Each row is scored by
    its own text; equal texts have equal scores. Null ids, repeated rows and extra columns
    stay as they are; an empty table stays empty.
    """
    return score_quality(docs, table(spark, sf_dir, "labels"), carry=True).filter("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the least id, with all its columns.

    Rows are told apart by a number of their own, so two texts with one id, or without
    an id, are two documents, and a repeated row is a copy. A null id counts as the
    largest; of equal ids the row that comes first stays. Texts without words are in no
    group and stay; an empty table stays empty.
    """
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct("*").alias("row")), "rows")
    found = near_duplicates(rows.select("row_key", "row.text"), id_col="row_key", percent=SIMILAR)
    group = found.select(F.col("doc_id").alias("row_key"), "component_id").join(rows.select("row_key", F.col("row.doc_id").alias("id")), "row_key")
    first = group.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("first")).select(F.col("first.row_key").alias("row_key"))
    return rows.join(first, "row_key", "left_semi").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row in sequences of 2048 tokens; see ``pack`` for odd rows."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("packing", packing)]

#: The packing's tokenizer and the classifier are beyond SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages keep of ``documents``; an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
