"""Vectors of passages by their content: a text is encoded once, whoever has it and when.

Two tables follow a stream of changes: which text a passage has (its hash), and the vector of
each hash. A batch encodes only hashes that the table doesn't have. Texts that no passage has
any more stay until ``compact``, so one that comes back costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.embedding import encode_texts
from passagework.storage import complete_folders, remove, written
from passagework.streaming.live import LiveSnapshot, latest, run_to_end


class VectorStore:
    """The vectors of passages (key, text), kept from changes (key, ``order``, op, text)."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], tokenize: Callable[[str], list[int]], weights: np.ndarray, text: str = "text"):
        self.spark, self.path, self.key, self.order, self.text = spark, path.rstrip("/"), key, order, text
        self.tokenize, self.weights = tokenize, weights
        self.owners = LiveSnapshot(spark, key, order, path=f"{self.path}/owners")

    def _parts(self) -> list[str]:
        """The folders that count: the newest base and what was encoded after it."""
        names = complete_folders(self.spark, self.path)
        number = lambda n: int(n.partition("-")[2])
        bases = [n for n in names if n.startswith("base-")]
        base = max(bases, key=number, default=None)
        after = number(base) if base else -1
        return ([base] if base else []) + sorted((n for n in names if n.startswith("vectors-") and number(n) > after), key=number)

    def _vectors(self) -> DataFrame | None:
        parts = self._parts()
        return self.spark.read.parquet(*(f"{self.path}/{n}" for n in parts)).dropDuplicates(["hash"]) if parts else None

    def merge(self, changes: DataFrame, batch: int) -> None:
        """Take in a batch. New hashes are encoded before passages point to them; a batch that
        comes again finds its hashes there."""
        rows = written(latest(changes.select(self.key, *self.order, "op", self.text), self.key, self.order).withColumn("hash", F.sha2(F.coalesce(self.text, F.lit("")), 256)), "changes")
        wanted = rows.filter("op <> 'delete'").groupBy("hash").agg(F.first(F.coalesce(self.text, F.lit(""))).alias("text"))
        known = self._vectors()
        missing = wanted if known is None else wanted.join(known.select("hash"), "hash", "left_anti")
        if f"vectors-{batch}" not in self._parts():
            encode_texts(missing, self.tokenize, self.weights, "hash").write.mode("overwrite").parquet(f"{self.path}/vectors-{batch}")
        self.owners.merge(rows.select(self.key, *self.order, "op", "hash"), batch)

    def follow(self, stream: DataFrame) -> None:
        """Take in all that the stream has and this hasn't."""
        run_to_end(stream, self.merge, checkpoint=f"{self.path}/_stream")

    def encoded(self, batch: int) -> int:
        """How many texts a batch had to encode."""
        return self.spark.read.parquet(f"{self.path}/vectors-{batch}").count()

    def rows(self) -> DataFrame:
        """key, hash, vector of every passage there is now."""
        return self.owners.rows().select(self.key, "hash").join(self._vectors(), "hash").select(self.key, "hash", "vector")

    def compact(self) -> None:
        """One table of the hashes that a passage has; what it replaces is removed after it."""
        parts = self._parts()
        last = max(int(n.partition("-")[2]) for n in parts)
        if parts == [f"base-{last}"]:
            return
        used = self.owners.rows().select("hash").distinct()
        self._vectors().join(used, "hash", "left_semi").write.mode("overwrite").parquet(f"{self.path}/base-{last}")
        for n in parts:
            if n != f"base-{last}":
                remove(self.spark, f"{self.path}/{n}")
