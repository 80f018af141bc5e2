"""MinHash near-duplicates by an LSH forest.

Each document's set of word shingles gives ``trees`` labels of ``DEPTH`` minimum hashes.
For each tree Spark sorts all labels; documents whose labels share a long prefix then
stand side by side. A document's candidates are the ``NEIGHBOURS`` rows on each side that
share its longest prefixes, of ``LEAST_DEPTH`` values at least: where few rows do, that is
all down to the least depth, and in a dense region the depth descends until no more than
these are left. This links most of what belongs together, but not all: the last step
compares the rest of every region (the rows that share ``LEAST_DEPTH`` values), whatever
its size, in blocks of ``BLOCK`` rows, and confirms on full sets where the blocks meet.
Only pairs of one component are left out there, as their links can't change anything.

Documents with equal sets are one from the start (a 128-bit fingerprint and the size).
Candidates are confirmed on full sets: first along the order of ``ORDERS`` trees, where
sets travel once and links that join what is joined already are skipped, then the pairs
that are left between different components, and then the regions' rest. There are as
many trees as it takes for two sets of the least similarity to share a prefix in none of
them with a chance of 2e-5: 12 for 0.85, 16 for 0.8. A sketch rules a pair out if it is
4.8 deviations below what the least similarity gives.

Shingles are 64-bit hashes under a key that is drawn for each run, so no texts can be made
whose shingles collide; two different shingles have one hash with a chance of 2^-64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_text, materialise, sliced
from .components import components
from .shingles import mix, numbered, secret_key, shingle_sets

MAX_TREES, DEPTH, LEAST_DEPTH, NEIGHBOURS, ORDERS = 48, 8, 3, 8, 2
MISSED = 2e-5
#: Sketch bits: one of each of so many further minimum hashes. Two sets of similarity
#: 0.85 agree in 118 of 128 on average, with a deviation of 3.
BITS = 128
PERCENT = 85
#: Rows of a region that are compared with as many at a time.
BLOCK = 2048
#: Ids of documents that need a second look are broadcast up to this many (8 bytes each).
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20_250_101)
_N = BITS + MAX_TREES * DEPTH
FACTORS = _rng.integers(1 << 31, size=_N, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _rng.integers(1 << 32, size=_N, dtype=np.uint32)
LABEL, REGION = DEPTH * 4, LEAST_DEPTH * 4


def trees_for(percent: int) -> int:
    trees = math.ceil(math.log(MISSED) / math.log(1 - min(0.99, percent / 100) ** LEAST_DEPTH))
    if trees > MAX_TREES:
        raise ValueError(f"{percent} percent need {trees} trees; there are {MAX_TREES}")
    return trees


def apart_bits(percent: int) -> int:
    """Sketch bits in which two sets that may be linked differ at most."""
    share = (1 - percent / 100) / 2
    return math.ceil(BITS * share + 4.8 * math.sqrt(BITS * share * (1 - share)))


def _signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """A row of ``count`` minimum hashes for each set; none may be empty."""
    every = np.concatenate(sets)
    low, high = every.astype(np.uint32), (every >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((count, len(sets)), np.uint32)
    for k in range(count):
        out[k] = np.minimum.reduceat((low ^ OFFSETS[k]) * FACTORS[k] ^ high, at)
    return out.T


def _sign(trees: int, key: int):
    def run(batches):
        for batch in sliced(batches, limit=1_000_000):
            sets = shingle_sets(batch.column(1).to_pylist(), key)
            full = [s for s in sets if len(s)]
            sums, xors, labels, sketches, k = [], [], [], [], 0
            if full:
                rows = _signatures(full, BITS + trees * DEPTH)
                forest = rows[:, BITS:].astype(">u4")
                bits = np.packbits((rows[:, :BITS] >> np.uint32(7) & np.uint32(1)).astype(np.uint8), axis=1)
            for s in sets:
                if len(s):
                    sums.append(int(np.sum(s, dtype=np.uint64).view(np.int64)))
                    xors.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)))
                    labels.append(forest[k].tobytes())
                    sketches.append(bits[k].tobytes())
                    k += 1
                else:
                    for x in (sums, xors, labels, sketches):
                        x.append(None)
            sizes = pa.array(list(map(len, sets)), pa.int64())
            columns = [pa.array(sums, pa.int64()), pa.array(xors, pa.int64()), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *columns], ["doc_id", "n", "f1", "f2", "labels", "sketch"])

    return run


def _neighbours(percent: int):
    """Pairs of each row with those of the ``NEIGHBOURS`` before it that share a prefix.

    In sorted order the rows next to a row share its longest prefixes, so what two rows
    have in common is the least of the prefixes between those in between.
    """
    apart = apart_bits(percent)

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(n, DEPTH).astype(np.uint32)
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(n, BITS // 64)
            now = [batch.column(0).to_numpy(), label, sketch, batch.column(3).to_numpy(), batch.column(4).to_numpy()]
            old = 0 if kept is None else len(kept[0])
            if old:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            tree, label, sketch, size, ids = now
            shared = np.zeros(len(tree), np.int8)  # values in common with the row before
            shared[1:] = np.cumprod(label[1:] == label[:-1], 1).sum(1) * (tree[1:] == tree[:-1])
            common, a, b = shared.copy(), [], []
            for k in range(1, min(NEIGHBOURS, len(tree) - 1) + 1):
                if k > 1:
                    common[k:] = np.minimum(common[k:], shared[1 : len(shared) - k + 1])
                j = max(old, k) + np.flatnonzero(common[max(old, k) :] >= LEAST_DEPTH)
                i = j - k
                near = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
                i, j = i[near], j[near]
                near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= apart
                a.append(ids[i[near]])
                b.append(ids[j[near]])
            kept = [x[-NEIGHBOURS:] for x in now]
            if a:
                yield _pairs(a, b)

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _along(percent: int):
    """Links between rows that stand near each other, by their sets."""

    def run(batches):
        recent: list[tuple] = []  # tree, prefix, set, id, group
        groups: dict[int, int] = {}

        def find(x: int) -> int:
            while groups.get(x, x) != x:
                x = groups[x]
            return x

        for batch in sliced(batches, 2):
            a, b = [], []
            sets = batch.column(2)
            for tree, label, i, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), range(batch.num_rows), batch.column(3).to_pylist(), strict=True):
                own = sets[i].values.to_numpy().view(np.uint64)
                prefix = label[: 4 * LEAST_DEPTH]
                for t, p, other, that in reversed(recent):
                    if t == tree and p == prefix and find(that) != find(doc) and similar(own, other, percent):
                        groups[find(doc)] = find(that)
                        a.append(min(doc, that))
                        b.append(max(doc, that))
                recent = [*recent[-NEIGHBOURS + 1 :], (tree, prefix, own, doc)]
            if len(groups) > 100_000:
                groups.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _sets(key: int):
    def run(batches):
        for batch in sliced(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return run


def _by_key(batches):
    """The rows of each key, which stand together, as one table."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for x, y in zip([0, *ends[:-1]], ends, strict=True):
            if keys[x] != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _met(rows: pa.Table, percent: int):
    """Pairs i, j of left rows with right ones that may be linked, 256 left rows at a time.

    They are in different components, neither size nor sketch rules them out, and this
    tree is the first in which they share a prefix, so that no pair is met twice.
    """
    apart = apart_bits(percent)
    tree, right, loose, ids, group, size = (rows.column(c).to_numpy() for c in ("tree", "right", "loose", "doc_id", "group", "n"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
    prefix = np.frombuffer(b"".join(rows.column("prefixes").to_pylist()), np.uint32).reshape(len(ids), -1, LEAST_DEPTH)
    left, right = np.flatnonzero(~right), np.flatnonzero(right)
    for k in range(0, len(left), 256):
        i, j = left[k : k + 256, None], right[None]
        x, y = np.nonzero(
            (group[i] != group[j]) & ((ids[i] < ids[j]) | ~loose[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        )
        i, j = left[k + x], right[y]
        near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= apart
        i, j = i[near], j[near]
        new = np.ones(len(i), bool)
        for t in range(int(tree.max())):
            new &= (tree[i] <= t) | (prefix[i, t] != prefix[j, t]).any(1)
        yield i[new], j[new]


def _asked(percent: int):
    """Those rows of each key that have a pair there: only their sets need to travel."""

    def run(batches):
        for rows in _by_key(batches):
            keep = np.zeros(rows.num_rows, bool)
            for i, j in _met(rows, percent):
                keep[i] = keep[j] = True
            if keep.any():
                yield from rows.filter(pa.array(keep)).to_batches()

    return run


def _joined(percent: int):
    """Links of each key's rows by their full sets; those between rows that are joined already are left out."""

    def run(batches):
        for rows in _by_key(batches):
            ids, group = rows.column("doc_id").to_numpy(), rows.column("group").to_numpy().copy()
            shingles = rows.column("shingles").combine_chunks()
            sizes = shingles.value_lengths().to_numpy()
            start = np.cumsum(sizes) - sizes
            number = numbered(shingles.flatten().to_numpy())[2]
            mark, a, b = np.zeros(len(number), bool), [], []
            for i, j in _met(rows, percent):
                ends = np.flatnonzero(np.diff(i, append=-1)) + 1
                for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    if x == y:
                        continue
                    own, others = i[x], j[x:y]
                    others = others[(group[others] != group[own]) & (sizes[others] > 0)]
                    mine = number[start[own] : start[own] + sizes[own]]
                    mark[mine] = True
                    for k in range(0, len(others), 256):  # so many sets at a time
                        some = others[k : k + 256]
                        first = np.cumsum(sizes[some]) - sizes[some]
                        both = np.add.reduceat(mark[number[np.repeat(start[some] - first, sizes[some]) + np.arange(first[-1] + sizes[some[-1]])]].astype(np.int64), first)
                        for other in some[100 * both >= percent * (sizes[own] + sizes[some] - both)].tolist():
                            if group[other] != group[own]:
                                a.append(min(ids[own], ids[other]))
                                b.append(max(ids[own], ids[other]))
                                group[group == group[other]] = group[own]
                    mark[mine] = False
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _meet(sets: dict[int, list[np.ndarray]], asked: dict[int, list[int]], percent: int):
    """Each id with those of its partners that are similar, by counts of common elements."""
    at = {}
    flat, sizes = [], []
    for doc, own in sets.items():
        at[doc] = [len(flat) + k for k in range(len(own))]
        flat += own
        sizes += map(len, own)
    sizes = np.array(sizes)
    start = np.cumsum(sizes) - sizes
    _, number = np.unique(np.concatenate(flat), return_inverse=True)
    mark = np.zeros(len(number), bool)
    for x, partners in asked.items():
        found: set[int] = set()
        rows = [(k, y) for y in partners for k in at.get(y, ())]
        k = np.array([k for k, _ in rows], np.int64)
        for own in at.get(x, ()) if rows else ():
            mark[number[start[own] : start[own] + sizes[own]]] = True
            first = np.cumsum(sizes[k]) - sizes[k]
            both = np.add.reduceat(mark[number[np.repeat(start[k] - first, sizes[k]) + np.arange(first[-1] + sizes[k[-1]])]].astype(np.int64), first)
            mark[number[start[own] : start[own] + sizes[own]]] = False
            found.update(rows[j][1] for j in np.flatnonzero(100 * both >= percent * (sizes[own] + sizes[k] - both)))
        yield x, found


def _confirm_blocks(percent: int):
    """Links among each key's pairs, whose sets come before them and travel once for a key."""

    def run(batches):
        key, sets, asked = None, {}, {}

        def out():
            a, b = [], []
            for x, found in _meet(sets, asked, percent) if sets else ():
                a += [x] * len(found)
                b += found
            sets.clear()
            asked.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in sliced(batches, 4):
            shingles = batch.column(4)
            for row, (k, is_pair, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if k != key:
                    yield out()
                    key = k
                if is_pair:
                    asked.setdefault(x, []).append(y)
                elif len(own := shingles[row].values):
                    sets.setdefault(x, []).append(own.to_numpy().view(np.uint64).copy())
        yield out()

    return run


def _confirmed(df: DataFrame, pairs: DataFrame, percent: int, broadcast_ids: int, secret: int) -> DataFrame:
    """Those of the written ``pairs`` that are similar: a, b.

    Pairs are dealt by blocks of their ends, so that a set travels once for many pairs of it.
    """
    need = materialise(_ends(pairs), "ids")
    n = need.count()
    parts = max(1, n // 256)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    pairs = pairs.withColumn("key", part("a") * parts + part("b"))
    sets = df.join(F.broadcast(need) if n <= broadcast_ids else need, "doc_id", "left_semi").mapInArrow(_sets(secret), "doc_id long, shingles array<long>")
    ends = pairs.select("key", F.col("a").alias("doc_id")).unionByName(pairs.select("key", F.col("b").alias("doc_id"))).distinct()
    travel = ends.join(sets, "doc_id").select("key", F.lit(False).alias("is_pair"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    asked = pairs.select("key", F.lit(True).alias("is_pair"), "a", "b", F.lit(None).cast("array<long>").alias("shingles"))
    both = travel.unionByName(asked).repartition("key").sortWithinPartitions("key", "is_pair")
    links = materialise(both.mapInArrow(_confirm_blocks(percent), "a long, b long"), "confirmed")
    discard(need)
    return links


def _rest(df: DataFrame, reps: DataFrame, final: DataFrame, percent: int, block: int, broadcast_ids: int, secret: int) -> DataFrame:
    """The links that are still missing between rows of one region: a, b.

    In each region with several components, all rows but those of the largest (the loose
    ones) meet all rows, in a task for every two blocks. So a group that is joined already
    costs little, and no region meets in one task. They meet twice: first by sketches,
    which leaves the rows that may be linked there, then these by their full sets. Only
    links leave a task, no more than it has rows; pairs are never rows.
    """
    trees = trees_for(percent)
    cut = lambda t: F.substring("labels", t * LABEL + 1, REGION)
    placed = reps.join(final, "doc_id", "left").select("doc_id", F.concat(*map(cut, range(trees))).alias("prefixes"), "sketch", "n", F.coalesce("component_id", "doc_id").alias("group"))
    placed = materialise(placed, "placed")
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.substring(F.col("prefixes"), t * REGION + 1, F.lit(REGION))))
    rows = placed.select(F.posexplode(prefixes).alias("tree", "region"), "doc_id", "group", "n")
    # A block has so many rows, or fewer if their sets are large.
    regions = rows.groupBy("region", "group").agg(F.sum(1 + F.col("n") / 1024).alias("k")).groupBy("region").agg(F.sum("k").alias("total"), F.max(F.struct("k", "group")).alias("top"), F.count("*").alias("groups"))
    regions = regions.filter("groups > 1").select(
        "region", F.ceil(F.greatest(F.col("total") - F.col("top.k"), F.lit(1.0)) / block).alias("n_left"), F.ceil(F.col("total") / block).alias("n_right"), F.col("top.group").alias("most"),
    )
    regions = materialise(regions, "regions")
    # Rows of every tree go through this join, so they are no more than numbers; the rest is added to those that stay.
    slim, wide_regions = rows.select("tree", "region", "doc_id"), regions.filter("n_right > 1")
    large = slim.join(F.broadcast(wide_regions) if wide_regions.count() <= broadcast_ids else wide_regions, "region", "left")
    small = large.filter("most IS NULL").select(*slim.columns).join(regions.filter("n_right = 1").hint("merge"), "region")
    dealt = large.filter("most IS NOT NULL").select(*small.columns).unionByName(small).distinct()
    dealt = materialise(dealt.join(placed.hint("merge"), "doc_id").withColumn("loose", F.col("group") != F.col("most")), "dealt")
    out = ["tree", "loose", "doc_id", "group", "n", "sketch", "prefixes"]
    lefts = dealt.filter("loose").withColumn("i", F.pmod(F.xxhash64("doc_id"), "n_left")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_right") - 1))).withColumn("right", F.lit(False))
    rights = dealt.withColumn("j", F.pmod(F.xxhash64("doc_id"), "n_right")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_left") - 1))).withColumn("right", F.lit(True))
    met = lefts.unionByName(rights.select(*lefts.columns)).select(F.xxhash64("region", "i", "j").alias("key"), "right", *out)
    met = met.repartition("key").sortWithinPartitions("key")
    asked = materialise(met.mapInArrow(_asked(percent), met.schema), "asked")
    need = materialise(asked.select("doc_id").distinct(), "ids")
    some = df.join(F.broadcast(need) if need.count() <= broadcast_ids else need, "doc_id", "left_semi")
    wide = asked.join(some.mapInArrow(_sets(secret), "doc_id long, shingles array<long>"), "doc_id").select(*asked.columns, "shingles")
    links = materialise(wide.repartition("key").sortWithinPartitions("key").mapInArrow(_joined(percent), "a long, b long"), "rest")
    discard(placed, regions, dealt, asked, need)
    return links


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, broadcast_ids: int = BROADCAST_IDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links have ``percent`` of their union in common.

    A null or empty text, or one without words, has no shingles and is alone. Repeated
    rows are repeated in the result with one component; an id with several texts joins
    their components. A null id has a null component and is kept, unless its text has another row. An
    empty table gives no rows; other columns are ignored.
    """
    df = id_text(docs, id_col, text_col)
    trees, secret = trees_for(percent), secret_key()
    signed = materialise(df.mapInArrow(_sign(trees, secret), "doc_id long, n long, f1 long, f2 long, labels binary, sketch binary"), "signed")
    key = ["n", "f1", "f2"]
    classes = materialise(signed.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = signed.filter("n > 0").join(classes.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi").dropDuplicates(["doc_id", *key])
    forest = reps.select(
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("labels"), t * LABEL + 1, F.lit(LABEL)))).alias("tree", "label"), "sketch", "n", "doc_id",
    )
    order = ["tree", "label", "doc_id"]
    rows = forest.select("tree", "label", "sketch", "n", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    pairs = materialise(rows.mapInArrow(_neighbours(percent), "a long, b long").distinct().filter("a != b"), "pairs")
    ids = materialise(_ends(pairs), "ids")
    few = ids.count() <= broadcast_ids
    some = (lambda x: x.join(F.broadcast(ids), "doc_id", "left_semi")) if few else (lambda x: x.join(ids, "doc_id", "left_semi"))
    sets = some(df).mapInArrow(_sets(secret), "doc_id long, shingles array<long>")
    placed = some(signed.filter("n > 0")).select("doc_id", *(F.substring("labels", t * LABEL + 1, LABEL).alias(f"label{t}") for t in range(ORDERS))).dropDuplicates(["doc_id"])
    wide = sets.join(placed, "doc_id")
    along = wide.select(F.posexplode(F.array(*(f"label{t}" for t in range(ORDERS)))).alias("tree", "label"), "shingles", "doc_id")
    along = along.select("tree", "label", "shingles", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    links = materialise(along.mapInArrow(_along(percent), "a long, b long"), "links")
    joined = materialise(components(links), "joined")
    left = (
        pairs.join(joined.select(F.col("doc_id").alias("a"), F.col("component_id").alias("ca")), "a", "left")
        .join(joined.select(F.col("doc_id").alias("b"), F.col("component_id").alias("cb")), "b", "left")
        .filter("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")
    )
    left = materialise(left, "left")
    checked = links.unionByName(_confirmed(df, left, percent, broadcast_ids, secret))
    final = materialise(components(checked), "final")
    final = components(checked.unionByName(_rest(df, reps, final, percent, block, broadcast_ids, secret)))
    whole = materialise(classes.join(final.withColumnRenamed("doc_id", "rep"), "rep", "left").select(*key, "copies", F.coalesce("component_id", "rep").alias("component_id")), "whole")
    discard(classes, pairs, ids, links, joined, left)
    # The classes with a thousandth of all rows or more, 1000 at most, are broadcast, so that no large one meets in a task.
    hot = whole.filter(F.col("copies") * 1000 >= signed.count()).select(*key, F.col("component_id").alias("hot_id"))
    out = signed.select("doc_id", *key).join(F.broadcast(hot), key, "left")
    cold = whole.filter(F.col("copies") * 1000 < signed.count()).select(*key, "component_id")
    rest = out.filter("hot_id IS NULL").drop("hot_id").join(cold, key, "left")
    out = rest.unionByName(out.filter("hot_id IS NOT NULL").select("doc_id", *key, F.col("hot_id").alias("component_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
