"""Order-dependent removal of overlapping line ranges.

Each of these goes through the rows of one path in a stated order: what a row meets
depends on what was kept before it, which no anti-join can say. Spark deals rows by path and
sorts them; a task then goes through its sorted rows once and keeps, of the path that it is
in, no more than a small state: the kept intervals in order of lines (a row finds its
neighbours by binary search), the last kept one, or the outline of all that was shown.
Rows are streamed, so a path of any length needs memory for its state only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


class Apart:
    """Keeps a range that meets none of those kept before."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int, _: bool) -> bool:
        k = bisect_left(self.starts, start)
        if k and self.ends[k - 1] >= start or k < len(self.starts) and self.starts[k] <= end:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


class Covered:
    """Keeps a range that no earlier one contains; one that must stay stays. Of the ranges so
    far only those count that no other contains: by start, their ends grow."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int, stays: bool) -> bool:
        k = bisect_right(self.starts, start)  # those before k start no later
        if k and self.ends[k - 1] >= end:
            return stays
        first = bisect_left(self.starts, start)
        last = bisect_right(self.ends, end)
        self.starts[first : max(first, last)] = [start]
        self.ends[first : max(first, last)] = [end]
        return True


def _streamed(df: DataFrame, partition: list[str], order: list[Column], state: Callable, stays: str | None = None) -> DataFrame:
    """The rows that ``state`` keeps, asked in order, ties by all columns that have an order."""
    columns = df.columns
    ties = [c for c in columns if not isinstance(df.schema[c].dataType, MapType)]
    keyed = df.select(*columns, *(o.alias(f"_o{k}") for k, o in enumerate(order)))
    by = [*partition, *(f"_o{k}" for k in range(len(order))), *ties]
    dealt = keyed.repartition(*partition).sortWithinPartitions(*by).select(*columns)
    at = [columns.index(c) for c in (*partition, "line_start", "line_end")]
    stay = columns.index(stays) if stays else None

    def run(batches):
        key, kept = object(), None
        for batch in batches:
            *keys, starts, ends = (batch.column(k).to_pylist() for k in at)
            must = batch.column(stay).to_pylist() if stay is not None else [False] * batch.num_rows
            keep = []
            for own, start, end, m in zip(zip(*keys, strict=True) if keys else [()] * batch.num_rows, starts, ends, must, strict=True):
                if own != key:
                    key, kept = own, state()
                keep.append(start is None or end is None or kept.add(start, end, bool(m)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, df.schema)


def drop_overlaps(df: DataFrame, order: list[Column], partition: list[str]) -> DataFrame:
    """Rows in order, without those whose lines meet a row that was kept before. A row
    without a first or last line meets none."""
    return _streamed(df, partition, order, Apart)


def context_ranges(df: DataFrame, partition: list[str]) -> DataFrame:
    """Ranges by start, then end; one that meets the last kept replaces it if it is longer."""
    columns = df.columns
    ties = [c for c in columns if c not in ("line_start", "line_end") and not isinstance(df.schema[c].dataType, MapType)]
    dealt = df.repartition(*partition).sortWithinPartitions(*partition, "line_start", "line_end", *ties).select(*columns)
    at = [columns.index(c) for c in (*partition, "line_start", "line_end")]

    def run(batches):
        key, last, held = None, None, None  # of the last kept row: its lines, and itself
        for batch in batches:
            *keys, starts, ends = (batch.column(k).to_pylist() for k in at)
            chosen, out = [], []
            for k, own, start, end in zip(range(batch.num_rows), zip(*keys, strict=True) if keys else [()] * batch.num_rows, starts, ends, strict=True):
                if last is not None and own == key and last[0] <= end and start <= last[1]:
                    if end - start > last[1] - last[0]:
                        last, held = (start, end), k
                    continue
                if held is not None:
                    (out if isinstance(held, pa.RecordBatch) else chosen).append(held)
                key, last, held = own, (start, end), k
            yield from out
            yield batch.take(pa.array(chosen, pa.int64()))
            if isinstance(held, int):
                held = batch.slice(held, 1)
        if held is not None:
            yield held

    return dealt.mapInArrow(run, df.schema)


def drop_covered(df: DataFrame, partition: list[str], position: str = "position", manual: str = "manual") -> DataFrame:
    """Shown rows by position, without those that an earlier one contains; manual ones stay."""
    return _streamed(df, partition, [F.col(position)], Covered, manual)


def assembled(df: DataFrame, partition: list[str], order: list[str], text: str = "text") -> DataFrame:
    """The texts of each partition in order, a blank line between."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return df.groupBy(*partition).agg(F.array_join(F.transform(rows, lambda r: r[text]), "\n\n").alias("context"))


def neighbours(df: DataFrame, partition: list[str], order: str, n: int, text: str = "text") -> DataFrame:
    """Each row widened by up to ``n`` rows on both sides: the span of their lines and their texts."""
    from pyspark.sql import Window

    around = Window.partitionBy(*partition).orderBy(order).rowsBetween(-n, n)
    return df.select(
        *partition, order,
        F.min("line_start").over(around).alias("from_line"), F.max("line_end").over(around).alias("to_line"),
        F.array_join(F.collect_list(text).over(around), "\n\n").alias("widened"),
    )
