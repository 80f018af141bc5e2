"""The content-addressed score table: lookups, upserts with eviction, old records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.constants import CONTRIBUTIONS, MAX_CACHED_SCORES

SCHEMA = "hash string, score double, contribution string, scores map<string,double>, accessed long"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def is_valid() -> Column:
    """A finite score, a known contribution and finite parts; one bad value spoils the row."""
    return F.coalesce(_finite(F.col("score")) & F.col("contribution").isin(*CONTRIBUTIONS) & F.col("scores").isNotNull() & F.forall(F.map_values("scores"), _finite), F.lit(False))


def lookup(wanted: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their scores, rows of ``wanted`` without a valid score), by ``hash``."""
    valid = store.filter(is_valid()).select("hash", "score", "contribution", "scores")
    return wanted.join(valid, "hash"), wanted.join(valid.select("hash"), "hash", "left_anti")


def touched(store: DataFrame, read: DataFrame, clock: int) -> DataFrame:
    """The store after a read: rows that were found count as used now."""
    used = read.select("hash").distinct().withColumn("used", F.lit(True))
    return store.join(used, "hash", "left").withColumn("accessed", F.when(F.col("used"), F.lit(clock)).otherwise(F.col("accessed"))).drop("used")


def upsert(store: DataFrame, rows: DataFrame, most: int = MAX_CACHED_SCORES) -> DataFrame:
    """The latest row of each hash, and of those the ``most`` that were used last. Of rows
    that were used at the same time the written one counts, then the larger score."""
    both = store.withColumn("late", F.lit(0)).unionByName(rows.withColumn("late", F.lit(1)))
    columns = [c for c in store.columns if c != "hash"]
    newest = F.max_by(F.struct(*columns), F.struct("accessed", "late", "score", "contribution"))
    latest = both.groupBy("hash").agg(newest.alias("row")).select("hash", "row.*").select(*store.columns)
    return latest.orderBy(F.desc("accessed"), "hash").limit(most)


def import_records(text: DataFrame, store: DataFrame) -> DataFrame:
    """Old records (JSON texts of version 1 in ``value``) whose hash the store lacks."""
    shape = "version int, entries array<struct<hash:string,value:struct<score:double,contribution:string,scores:map<string,double>>>>"
    rows = text.select(F.from_json("value", shape).alias("j")).filter("j.version = 1").select(F.inline("j.entries"))
    flat = rows.select("hash", "value.*").withColumn("accessed", F.lit(0).cast("long")).filter(is_valid() & F.col("hash").rlike("^[0-9a-f]{64}$")).dropDuplicates(["hash"])
    return store.unionByName(flat.join(store.select("hash"), "hash", "left_anti"))


def promote(missing: DataFrame, store: DataFrame) -> DataFrame:
    """Rows for the store from scores under an older key (``old_hash``) of the same passage."""
    old = store.filter(is_valid()).withColumnRenamed("hash", "old_hash")
    return missing.select("hash", "old_hash").join(old, "old_hash").select("hash", "score", "contribution", "scores", "accessed")
