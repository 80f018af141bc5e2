"""Mixing, whitening and the manifest against brute force and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from passagework.llm import embedding_whitening, entry, merkle_manifest, source_mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size long, target string, copies int, rate string, seed int, grp string, digest string, row string, h1 string"
LONG = "Word " * 200_000
ODD = [
    (0, "Some words here", "a", "en", 15), (0, "Some words here", "a", "en", 15), (1, None, "a", None, None), (2, "", None, "en", 0), (3, LONG, None, "de", len(LONG)),
    (None, "no id AT all", "b", "fr", 12), (None, "no id AT all", "b", "fr", 12), (None, "another one", "ü", None, 3), (7, "\t\n\x0b \x0c\r", "", "xx", 6), (-5, "Negative ünd 😀", "😀", "en", 14),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 1, "r", 1, "g", "d", "row", "h") for r in rows], SCHEMA)


def shown(df, *names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


# mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(1, 2, 3), most=3):
    """By resharing, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in names}
        above = {s for s in names if out[s] > most * sizes[s]} - full
        if not above:
            return out
        full |= above


def test_mix_targets_with_resharing(spark):
    rows = [(k, "w " * n, s, "en", 0) for k, (s, n) in enumerate([("a", 900), ("b", 10), ("c", 20), ("d", 300), ("e", 1), ("f", 50), (None, 4000), ("zero", 0)])]
    got = {r.doc_id: r for r in source_mixing.planned(frame(spark, rows)).collect()}
    want = targets({s: words(t) for _, t, s, *_ in rows})
    for k, text, s, *_ in rows:
        assert got[k].target == pytest.approx(want[s]) and got[k].source_size == words(text) == got[k].size and got[k].copies <= 3
    assert sum(want.values()) == pytest.approx(sum(words(r[1]) for r in rows))
    assert {got[k].copies for k in (1, 2, 4)} == {3}  # at three times their size


def test_mixed_words_come_near_their_targets(spark):
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    got = source_mixing.planned(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert len(got) == len(docs)
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += words(d["text"])
    want, source, taken = targets(dict(sizes)), {d["doc_id"]: d["source"] for d in docs}, defaultdict(int)
    for r in got:
        taken[source[r.doc_id]] += r.copies * r.size
        rate = r.target / r.source_size
        assert r.copies in (int(rate), int(rate) + 1)
    for s, t in want.items():
        assert abs(taken[s] - t) < 0.05 * t, s
    again = source_mixing.planned(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_emits_whole_rows_as_often_as_planned(spark):
    docs = frame(spark, ODD)
    plan = source_mixing.planned(docs).collect()
    assert len(plan) == len(ODD) and Counter(r.size for r in plan) == Counter(words(r[1]) for r in ODD)
    mixed = source_mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in plan:
        want[r.doc_id, r.size] += r.copies
    assert Counter((r.doc_id, words(r.text)) for r in mixed.collect()) == +want
    by_size = {r.size: r for r in plan}
    assert by_size[0].copies * 0 == 0 and by_size[200_000].source_size == 200_000


@pytest.mark.parametrize("rows", [[], [(1, None, "a", "en", 0), (2, "", None, "en", 0)]])
def test_mix_of_nothing(spark, rows):
    got = source_mixing.planned(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.target == r.copies == r.size == 0 for r in got)
    assert source_mixing.mix(frame(spark, rows)).count() == 0


# whitening

VECTORS = "vec_id long, embedding array<double>, n long, w string, x string, label int"


def whole(rows):
    return np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for v in rows], object)


def held_against_numpy(got, ids, vectors, k=8):
    """All columns of ``whiten`` against a decomposition of the covariance of Python's numbers."""
    x = whole(vectors)
    n, sums = len(x), x.sum(0)
    off = n * x - sums
    centred = (off / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    rows = defaultdict(dict)
    for r in got:
        rows[r.vec_id][r.component] = r
    assert sorted(rows) == sorted(ids)
    trace = int((off**2).sum()) / n**3
    for c in range(1, k + 1):
        mine = np.array([rows[i][c].whitened for i in ids])
        want = centred @ axes[:, c - 1] / np.sqrt(values[c - 1])
        assert min(abs(mine - want).max(), abs(mine + want).max()) < 1e-8
        assert all(rows[i][c].explained == pytest.approx(values[c - 1] / trace, rel=1e-9) for i in ids[:5])
    for i, d in zip(ids, off, strict=True):
        assert {int(r.deviation) for r in rows[i].values()} == {int((d**2).sum())} and set(rows[i]) == set(range(1, k + 1))
    w = np.array([[rows[i][c].whitened for c in range(1, k + 1)] for i in ids])
    w -= w.mean(0)
    error = abs(w.T @ w / n - np.eye(k)).max()
    assert {r.identity_error for r in got} == {got[0].identity_error} and abs(got[0].identity_error - error) < 1e-9 and error < 1e-4
    assert {r.n for r in got} == {n}


def test_whitening_equals_numpy(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    got = entry.queries()["op12_embedding_whitening"](spark, SF).collect()
    held_against_numpy(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_whitening_leaves_out_what_is_not_finite(spark):
    rng = np.random.default_rng(3)
    good = {k: (rng.normal(size=9) * np.arange(1, 10) * (1e3 if k == 4 else 1)).tolist() for k in range(40)}
    bad = {100: None, 101: [], 102: [1.0] * 8, 103: [float("nan"), *[0.0] * 8], 104: [float("inf"), *[0.0] * 8], 105: [None, *[1.0] * 8], 106: [-1e300, *[0.0] * 8]}
    rows = [(k, v, 1, "w", "x", 0) for k, v in (good | bad).items()]
    got = embedding_whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    held_against_numpy(got, list(good), list(good.values()))


def test_whitening_with_few_components_and_copies(spark):
    vectors = [[0.0, 0.0, 1.0], [1.0, 0.0, 1.0], [0.0, 2.0, 1.0], [0.0, 2.0, 1.0]]  # the third has no variance
    got = embedding_whitening.whiten(spark.createDataFrame([(k % 3, v, 1, "w", "x", 0) for k, v in enumerate(vectors)] + [(None, vectors[0], 1, "w", "x", 0)], VECTORS)).collect()
    assert Counter(r.component for r in got) == {1: 5, 2: 5} and sum(r.vec_id is None for r in got) == 2 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_whitening_without_variance_has_no_rows(spark, rows):
    got = embedding_whitening.whiten(spark.createDataFrame([(k, v, 1, "w", "x", 0) for k, v in enumerate(rows)], VECTORS))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_of_any_size_are_exact():
    for scaled in (np.array([[3, -4], [1 << 50, -(1 << 50) - 12345]]), np.array([[1 << 60, -7], [1 << 61, 1]]), np.array([[1 << 90, 3]], object)):
        assert embedding_whitening._deviations(scaled) == [sum(int(v) ** 2 for v in row) for row in scaled.tolist()]


# the manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, source, lang, n_chars, low=False):
    if low and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(nodes):
    """The root, and for each node the sibling lists (before, after) up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 16 * 16
            paths[k].append((nodes[run:i], nodes[i + 1 : run + 16]))
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inside, out = {}, []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        inside[s] = brute_tree([leaf_of(*r) for r in groups[s]])
    root, upper = brute_tree([inside[s][0] for s in order])
    for s, above in zip(order, upper, strict=True):
        for r, path in zip(groups[s], inside[s][1], strict=True):
            path = path + above
            low = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf_of(*r, low=low)
            for before, after in path:
                now = sha(*before, now, *after)
            out.append((r[0], leaf_of(*r), inside[s][0], root, sha(*(x for a, b in path for x in (*a, *b))), now, now == root))
    return sorted(out, key=repr)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def test_manifest_of_odd_rows(spark):
    assert shown(merkle_manifest.manifest(frame(spark, ODD), tampered()), *MANIFEST) == brute_manifest(ODD)
    assert {r.verified for r in merkle_manifest.manifest(frame(spark, ODD)).collect()} == {True}


@pytest.mark.parametrize("n", [1, 16, 17, 4096, 4097, 9000])
def test_manifest_of_groups_over_several_blocks(spark, n):
    rows = [(k * 7 % 10_007, f"Text {k % 50}", "big" if k < n else f"s{k % 21}", "en", k % 3) for k in range(n + 60)]
    got = shown(merkle_manifest.manifest(frame(spark, rows).repartition(6), tampered()), *MANIFEST)
    want = brute_manifest(rows)
    assert got == want and {r[-1] for r in want} == {True, False}


def test_manifest_of_equal_rows_and_of_none(spark):
    rows = [ODD[0]] * 5000
    assert shown(merkle_manifest.manifest(frame(spark, rows), tampered()), *MANIFEST) == brute_manifest(rows)
    assert merkle_manifest.manifest(frame(spark, []), tampered()).collect() == []


def test_a_change_of_any_field_is_found(spark):
    for at, value in ((0, 99), (1, "other"), (3, "xx"), (4, -1)):
        changed = [(*r[:at], value, *r[at + 1 :]) if k == 4 else r for k, r in enumerate(ODD)]
        assert {r.root for r in merkle_manifest.manifest(frame(spark, changed)).collect()} != {r.root for r in merkle_manifest.manifest(frame(spark, ODD)).collect()}
