"""How two rankings or two scorings of the same passages differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.numbering import numbered


def spearman(pairs: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """rho from ordinal ranks; equal values rank in the order of ``order``."""
    ranked = numbered(numbered(pairs.select(a, b, order), [], [a, order], "ra"), [], [b, order], "rb")
    n = F.count("*").cast("double")
    d = (F.col("ra") - F.col("rb")).cast("double")
    return ranked.agg((1 - 6 * F.sum(d * d) / (n * (n * n - 1))).alias("rho"))


def drift(pairs: DataFrame, base: str, other: str, key: str, threshold: float, k: int) -> DataFrame:
    """Mean and largest change, how many cross the threshold, how many of the first k stay."""
    d = F.abs(F.col(base) - F.col(other))
    top = lambda c: pairs.orderBy(F.desc(c), key).limit(k).select(key)
    kept = top(base).intersect(top(other)).agg(F.count("*").alias("kept"))
    crossed = (F.col(base) >= threshold) != (F.col(other) >= threshold)
    return pairs.agg(F.avg(d).alias("mean_drift"), F.max(d).alias("max_drift"), F.count_if(crossed).alias("crossed")).crossJoin(kept)
