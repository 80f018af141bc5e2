"""The selection while scores still arrive: after each batch the order of what has been judged.

A batch's rows meet only the selection so far, ``limit`` rows at most, as a row that isn't
among the first ``limit`` of some batches is not among those of all. So each step is a merge of
two short sorted runs, whatever was judged before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.operators.judge import selection_order
from passagework.storage import complete_folders, remove
from passagework.streaming.live import run_to_end


class PartialSelection:
    """The first ``limit`` of the judged rows (``keys``, score, contribution) that pass
    ``threshold``, kept under ``path`` by batch; ``told`` hears of each state (rows with their
    ``position``, how many were judged, how many passed). A batch that comes again is told again
    and changes nothing."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], threshold: float, mode: str, limit: int, told: Callable[[DataFrame, int, int], None] | None = None):
        self.spark, self.path, self.keys, self.threshold, self.mode, self.limit, self.told = spark, path.rstrip("/"), keys, threshold, mode, limit, told

    def _last(self, before: float = float("inf")) -> int:
        done = (int(n.partition("-")[2]) for n in complete_folders(self.spark, self.path) if n.startswith("counts-"))
        return max((n for n in done if n < before), default=-1)

    def _counts(self, batch: int) -> tuple[int, int]:
        row = self.spark.read.parquet(f"{self.path}/counts-{batch}").first() if batch >= 0 else None
        return (row.judged, row.passed) if row else (0, 0)

    def merge(self, judged: DataFrame, batch: int) -> None:
        """Take in a batch of rows that no other batch has."""
        last = self._last()
        if batch > last:
            rows = judged.select(*self.keys, "score", "contribution")
            judged_n, passed_n = rows.agg(F.count("*"), F.count_if(F.col("score") >= self.threshold)).first()
            before = self._counts(last)
            best = rows.filter(F.col("score") >= self.threshold)
            if last >= 0:
                best = best.unionByName(self.spark.read.parquet(f"{self.path}/best-{last}"))
            best.orderBy(*selection_order(self.mode, self.keys)).limit(self.limit).write.mode("overwrite").parquet(f"{self.path}/best-{batch}")
            self.spark.createDataFrame([(before[0] + judged_n, before[1] + passed_n)], "judged long, passed long").write.mode("overwrite").parquet(f"{self.path}/counts-{batch}")
            old = self._last(before=last)
            if old >= 0:  # a reader may still be at the last but one
                remove(self.spark, f"{self.path}/best-{old}")
                remove(self.spark, f"{self.path}/counts-{old}")
        if self.told:
            self.told(self.rows(), *self._counts(self._last()))

    def follow(self, stream: DataFrame) -> None:
        """Take in batches of judged rows as a stream has them."""
        run_to_end(stream, self.merge, checkpoint=f"{self.path}/_stream")

    def rows(self) -> DataFrame:
        """keys, score, contribution and ``position`` from 0 of what is first so far."""
        best = self.spark.read.parquet(f"{self.path}/best-{self._last()}")
        place = Window.orderBy(*selection_order(self.mode, self.keys))  # ``limit`` rows at most
        return best.withColumn("position", (F.row_number().over(place) - 1).cast("long"))
