"""Folds over ranges against plain loops, on long paths, and on odd rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from passagework.operators import ranges

SCHEMA = "path string, line_start int, line_end int, score double, position int, manual boolean, parts map<string,double>"


def meet(a, b):
    return a[0] <= b[1] and b[0] <= a[1]


def by_hand(kind, rows):
    """The kept (start, end) of one path's rows in order."""
    kept = []
    for start, end, manual in rows:
        x = (start, end)
        if kind == "overlaps":
            if not any(meet(k, x) for k in kept):
                kept.append(x)
        elif kind == "covered":
            if manual or not any(k[0] <= start and k[1] >= end for k in kept):
                kept.append(x)
        elif kept and meet(kept[-1], x):
            if end - start > kept[-1][1] - kept[-1][0]:
                kept[-1] = x
        else:
            kept.append(x)
    return sorted(kept)


def rows_of(rng, paths, n, lines):
    out = []
    for p in range(paths):
        for k in range(n):
            start = rng.randint(1, lines)
            out.append((f"p{p}", start, start + rng.choice((0, 1, 2, 5, 40)), float(rng.randint(0, n)), k, rng.random() < 0.1, {"a": 0.5}))
    return out


@pytest.mark.parametrize("kind", ["overlaps", "covered", "context"])
def test_folds_equal_plain_loops(spark, kind):
    rng = random.Random(4)
    rows = rows_of(rng, 20, 60, 90) + rows_of(rng, 1, 1, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    order = {"overlaps": lambda r: (-r[3], r[2] - r[1], *r[1:6]), "covered": lambda r: r[4], "context": lambda r: (r[1], r[2])}[kind]
    got = {"overlaps": lambda: ranges.drop_overlaps(df, [-F.col("score"), F.col("line_end") - F.col("line_start")], ["path"]), "covered": lambda: ranges.drop_covered(df, ["path"]), "context": lambda: ranges.context_ranges(df, ["path"])}[kind]().collect()
    for path in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == path), key=order)
        assert sorted((r.line_start, r.line_end) for r in got if r.path == path) == by_hand(kind, [(r[1], r[2], r[5]) for r in own]), path
    assert all(r.parts == {"a": 0.5} for r in got)


def test_ten_thousand_ranges_of_one_path(spark):
    rows = rows_of(random.Random(1), 1, 10_000, 100_000)
    df = spark.createDataFrame(rows, SCHEMA).cache()
    df.count()
    for run in (lambda: ranges.drop_overlaps(df, [-F.col("score")], ["path"]), lambda: ranges.context_ranges(df, ["path"]), lambda: ranges.drop_covered(df, ["path"])):
        run().count()
        began = time.perf_counter()
        assert run().count() > 100
        assert time.perf_counter() - began < 5
    state, began = ranges.Apart(), time.perf_counter()
    assert sum(state.add(r[1], r[2], False) for r in rows) > 100 and time.perf_counter() - began < 1


def test_odd_ranges(spark):
    df = spark.createDataFrame([(None, 1, 2, 1.0, 0, False, None), (None, 2, 3, 0.5, 1, False, None), ("p", None, 3, 1.0, 0, False, None), ("p", 1, None, 1.0, 1, False, None), ("p", 5, 5, 1.0, 2, False, {}), ("p", 5, 5, 1.0, 3, False, {})], SCHEMA)
    assert ranges.drop_overlaps(df, [-F.col("score")], ["path"]).count() == 4
    assert ranges.drop_covered(df, ["path"]).count() == 5
    for run in (ranges.drop_covered, ranges.context_ranges):
        assert run(df.limit(0), ["path"]).count() == 0
