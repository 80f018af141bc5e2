"""Standing questions and delta vectors against asking and encoding everything anew."""

import math
import random

import numpy as np
import pytest

from passagework.functions.embedding import encode
from passagework.operators.vector_store import VectorStore
from passagework.streaming.standing import StandingQuestions

BATCH = "id string, version long, op string, text string"
WORDS = "conflict mediation peace work art other than thre".split()
ASKED = [(0, "peace art"), (1, "conflict"), (2, "than thre other"), (3, "nothing here"), (4, "the of")]


def batches(rng, n, size, keys):
    truth, out = {}, []
    for version in range(n):
        rows = []
        for key in rng.sample([f"p{k:02}" for k in range(keys)], size):
            gone = version and rng.random() < 0.4
            text = None if gone else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))
            rows.append((key, version, "delete" if gone else "upsert", text))
            truth.pop(key, None)
            if not gone:
                truth[key] = text
        out.append((rows, dict(truth)))
    return out


def top(truth, stats, question, k):
    """By hand, with the statistics of an epoch."""
    docs = {i: t.split() for i, t in stats.items()}
    n, avg = len(docs), max(1, sum(map(len, docs.values())) / max(1, len(docs)))
    terms = [t for t in question.split() if t not in ("the", "of")]
    out = []
    for key, text in truth.items():
        d, s, hits = text.split(), 0, 0
        d = [w for w in d if w != "the"]
        for t in terms:
            if tf := d.count(t):
                df = sum(t in x for x in docs.values())
                hits += 1
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.75 + 0.25 * len(d) / avg))
        if hits:
            out.append((-round(s * (1 + math.log(hits)), 9), key))
    return [(key, -s) for s, key in sorted(out)[:k]]


@pytest.mark.parametrize("k, fanout", [(3, 4), (50, 2)])
def test_lists_follow_a_stream(spark, tmp_path, k, fanout):
    """After every batch the lists equal asking anew; each batch comes to a new object, and some come again."""
    path, source = f"file://{tmp_path}/standing", str(tmp_path / "changes")
    asked = spark.createDataFrame(ASKED, "qid long, question string")
    stats, before = None, {}
    for n, (rows, truth) in enumerate(batches(random.Random(k), 5, 14, 30)):
        stats = truth if stats is None else stats
        df = spark.createDataFrame(rows, BATCH)
        df.coalesce(1).write.mode("append").parquet(source)
        live = StandingQuestions(spark, path, asked, k, ["id"], ["version"])
        live.index.fanout = fanout
        live.follow(spark.readStream.schema(df.schema).parquet(source))
        if n % 2:
            live.merge(df, n)
        got = {}
        for r in live.results().orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.id, round(r.lexical_score, 9)))
        want = {q: w for q, question in ASKED if (w := top(truth, stats, question, k))}
        assert got == want, n
        told = {r.qid for r in live.changed(n).collect()}
        assert {q for q in {*got, *before} if got.get(q) != before.get(q)} <= told
        before = got
    assert 4 not in told and 3 not in told  # their words are nowhere


def test_rebase_takes_new_statistics(spark, tmp_path):
    live = StandingQuestions(spark, f"file://{tmp_path}/s", spark.createDataFrame(ASKED, "qid long, question string"), 5, ["id"], ["version"])
    live.merge(spark.createDataFrame([("a", 0, "upsert", "peace"), ("b", 0, "upsert", "art")], BATCH), 0)
    live.merge(spark.createDataFrame([(f"c{k}", 1, "upsert", "conflict art") for k in range(5)], BATCH), 1)
    truth = {"a": "peace", "b": "art", **{f"c{k}": "conflict art" for k in range(5)}}
    live.rebase()
    got = [(r.id, round(r.lexical_score, 9)) for r in live.results().filter("qid = 0").orderBy("rank").collect()]
    assert got == top(truth, truth, "peace art", 5)
    live.merge(spark.createDataFrame([("a", 2, "delete", None)], BATCH), 2)
    left = {i: t for i, t in truth.items() if i != "a"}
    assert [r.id for r in live.results().filter("qid = 0").orderBy("rank").collect()] == [i for i, _ in top(left, truth, "peace art", 5)]


def test_only_new_texts_are_encoded(spark, tmp_path):
    weights = np.random.default_rng(0).normal(size=(9, 3)).astype(np.float32)
    tokenize = lambda t: [2 + len(w) % 7 for w in t.split()]
    seen, path = set(), f"file://{tmp_path}/vectors"
    for n, (rows, truth) in enumerate(batches(random.Random(9), 4, 12, 20)):
        store = VectorStore(spark, path, "id", ["version"], tokenize, weights)
        df = spark.createDataFrame([*rows, ("twin", n, "upsert", rows[0][3] or "peace")], BATCH)
        store.merge(df, n)
        store.merge(df, n)  # it comes again
        texts = {t for _, _, op, t in rows if op == "upsert"} | {rows[0][3] or "peace"}
        assert store.encoded(n) == len(texts - seen)
        seen |= texts
        truth = {**truth, "twin": rows[0][3] or "peace"}
        got = {r.id: r.vector for r in store.rows().collect()}
        assert got.keys() == truth.keys() and all(np.allclose(got[i], encode(tokenize(t), weights)) for i, t in truth.items())
        if n == 2:
            store.compact()
            assert {r.id for r in store.rows().collect()} == truth.keys() and store._vectors().count() == len(set(truth.values()))
            seen = set(truth.values())
    store.compact()
    store.compact()
    assert store.rows().count() == len(truth)
