"""Places of rows in an order, without one task that has them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.storage import fresh_path


def numbered(rows: DataFrame, within: list[str], by: list[str], name: str) -> DataFrame:
    """``name``: the row's place from 0 in order of ``by`` among those equal in ``within``.

    Rows are dealt by ranges of both, written (so that a lost task can't deal them
    otherwise), numbered within their range and moved by how many come before. So neither
    all rows nor those of one frequent value of ``within`` meet in a task. Nulls are equal.
    """
    dealt = rows.repartitionByRange(*within, *by).sortWithinPartitions(*within, *by).withColumn("_part", F.spark_partition_id())
    path = fresh_path(rows.sparkSession, "ranked")
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path)
    keys = [*within, "_part"]
    sizes = dealt.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = sizes.select(*(F.col(c).alias(f"_key{k}") for k, c in enumerate(keys)), (F.sum("_n").over(Window.partitionBy(*within).orderBy("_part")) - F.col("_n")).alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(keys)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1
    joined = dealt.withColumn("_nth", nth).join(before if within else F.broadcast(before), same)  # without ``within``, a row for each partition
    return joined.select(*rows.columns, (F.col("_before") + F.col("_nth")).cast("long").alias(name))
