"""Connected components of links that are too many for one machine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Links that one task takes; more are dealt to more tasks and joined in rounds.
TASK_LINKS = 1_000_000


def _stars(batches):
    """Links to a star for each component of what this task holds."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(root)]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])


def _star_round(links: DataFrame) -> DataFrame:
    """Large star, then small star: every node is linked to the least of its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """doc_id, component_id for each id in a link; ``links`` has a and b.

    The component's id is its least. Ids without a link to another are left out, as are
    links with a null end; repeated links count once; no links give no rows.
    """
    df = links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v")
    while True:
        df = materialise(df, "links")
        n = df.count()
        tasks = max(1, -(-n // task_links))
        df = df.coalesce(tasks).mapInArrow(_stars, "u long, v long")
        if tasks == 1:
            return df.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
        before = materialise(df, "stars")
        df = materialise(_star_round(before), "stars")
        if df.count() == before.count() and df.exceptAll(before).isEmpty():
            return df.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
