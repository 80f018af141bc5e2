"""Whitened principal components of integer-scaled embeddings by MLlib's distributed SVD.

Each entry c becomes the whole number floor(1024 c) + 100000. Sums are whole numbers, so
means don't depend on the order of tasks. Rows less their means form MLlib's RowMatrix;
``computeSVD`` gives right singular vectors (the covariance's eigenvectors) and singular
values s, and e = s^2 / n are its eigenvalues for divisor n. All components are asked for,
as MLlib then decomposes the Gram matrix exactly (LAPACK) and not by iteration to 1e-10.
The total variance comes from the rows' own exact deviations, not from these values, so
``explained`` doesn't inherit the decomposition's error.

Four passes over the vectors (sums, Gram matrix, projection, and the covariance of what was
projected), each numpy on Arrow batches inside tasks; the driver gets one sum a dimension
and one matrix of dimension squared, whatever the number of rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries from here on count as not finite, so that sums of a batch fit in 64 bits.
LARGEST = 2.0**38
#: Components with less of the first one's variance have none but rounding.
LEAST = 1e-12
ROWS = 4096
#: A deviation is stored as two numbers, the higher counting in units of this.
UNIT_BITS = 60


def _whole(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Per number of dimensions: which rows of (id, vector) are usable, and their whole numbers."""
    column = batch.column(1)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    good = np.concatenate([[0], np.cumsum(np.abs(values) < LARGEST)])  # false for NaN, too
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (good[ends] - good[ends - sizes] == sizes)
    out = {}
    for d in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == d))
        at = (ends[rows] - d)[:, None] + np.arange(d)
        out[d] = rows, np.floor(values[at] * SCALE).astype(np.int64) + SHIFT
    return out


def _parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _whole(part)


def _sums(batches):
    """Per task and number of dimensions: how many rows, and each dimension's sum."""
    found: dict[int, list] = {}
    for _, by_size in _parts(batches):
        for d, (rows, x) in by_size.items():
            own = found.setdefault(d, [0, [0] * d])
            own[0] += len(rows)
            own[1] = [a + b for a, b in zip(own[1], x.sum(0).tolist(), strict=True)]
    if found:
        sums = pa.array([[Decimal(s) for s in own[1]] for own in found.values()], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([own[0] for own in found.values()], pa.int64()), sums], ["d", "n", "sums"])


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S of every entry, as 64-bit numbers or, where these don't suffice, Python's."""
    if len(x) and n * int(np.abs(x).max()) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(scaled: np.ndarray) -> list[int]:
    """The sum of squares of each row, exactly: by two halves of 25 bits and more, whose
    products fit in 64 bits, or by Python's numbers."""
    if scaled.dtype == object or scaled.shape[1] << 52 > 1 << 62 or len(scaled) and int(np.abs(scaled).max()) >= 1 << 51:
        return [sum(int(v) * int(v) for v in row) for row in scaled.tolist()]
    high, low = scaled >> 25, scaled & ((1 << 25) - 1)
    parts = [np.einsum("ij,ij->i", a, b).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(hh << 50) + (hl << 26) + ll for hh, hl, ll in zip(*parts, strict=True)]


def _centred(d: int, n: int, sums: list[int]):
    def run(batches):
        for _, by_size in _parts(batches):
            if d in by_size:
                x = (_scaled(by_size[d][1], n, sums) / n).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, x.size + 1, d, dtype=np.int32), x.ravel())], ["x"])

    return run


def _projected(d: int, n: int, sums: list[int], scaled_axes: np.ndarray):
    k = scaled_axes.shape[1]

    def run(batches):
        for part, by_size in _parts(batches):
            if d in by_size:
                rows, x = by_size[d]
                scaled = _scaled(x, n, sums)
                off = _deviations(scaled)
                w = (scaled / n).astype(np.float64) @ scaled_axes
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), w.ravel())
                halves = [pa.array([v >> UNIT_BITS for v in off], pa.int64()), pa.array([v & (1 << UNIT_BITS) - 1 for v in off], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *halves, lists], ["vec_id", "high", "low", "w"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error for
    every row that remains and each of the first ``components`` components.

    Rows drop out whose vector is null or has a null, non-finite or absolutely huge
    (2^38 and more) entry, and those that don't have the number of dimensions that most
    have (the larger one of a tie). Repeated rows and null ids count as they are; ties of
    eigenvalues come in MLlib's order. A component without variance has no whitening, so
    tables of equal rows, of empty vectors or without rows give none; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    partial = materialise(rows.mapInArrow(_sums, "d int, n long, sums array<decimal(38,0)>"), "whiten-sums")
    most = partial.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None or not most.d:
        return spark.createDataFrame([], schema)
    d, n = most.d, most.n
    each = partial.filter(F.col("d") == d).select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).orderBy("k")
    sums = [int(r.s) for r in each.collect()]  # one row a dimension
    centred = rows.mapInArrow(_centred(d, n, sums), "x array<double>").select(array_to_vector("x").alias("x"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "x"), n, d).computeSVD(d)
    values = np.array(svd.s.toArray()) ** 2 / n
    values = values[values > LEAST * values[0]][:components]
    if not len(values):
        return spark.createDataFrame([], schema)
    axes = svd.V.toArray()[:, : len(values)] / np.sqrt(values)
    done = materialise(rows.mapInArrow(_projected(d, n, sums, axes), "vec_id long, high long, low long, w array<double>"), "whitened")
    k = range(len(values))
    total = done.agg(*(F.sum(F.col(c).cast("decimal(38,0)")) for c in ("high", "low")), *(F.sum(F.get("w", F.lit(i))) / n for i in k)).first()
    means = [total[2 + i] for i in k]
    off = [F.get("w", F.lit(i)) - F.lit(means[i]) for i in k]
    pairs = [(i, j) for i in k for j in k if i <= j]
    error = max(abs(s - (i == j)) for s, (i, j) in zip(done.agg(*(F.sum(off[i] * off[j]) / n for i, j in pairs)).first(), pairs, strict=True))
    trace = ((int(total[0]) << UNIT_BITS) + int(total[1])) / n**3  # whole numbers up to here
    explained = F.array(*(F.lit(float(e / trace)) for e in values))
    whole = F.col("high").cast("decimal(20,0)") * F.lit(Decimal(1 << UNIT_BITS)).cast("decimal(19,0)") + F.col("low").cast("decimal(19,0)")
    out = done.select("vec_id", whole.cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("c", "whitened"))
    return out.select("vec_id", (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("c")).alias("explained"), F.lit(float(error)).alias("identity_error"))
