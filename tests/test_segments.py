"""The segmented index against a rebuild, after any edits, replays and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import index, ranking
from passagework.operators.segments import SegmentedIndex
from passagework.streaming.live import LiveSnapshot

BATCH = "id string, version long, op string, text string"
WORDS = "conflict mediation peace work art other than thre".split()
QUESTION = "peace art conflict missing"


def scores(spark, found):
    terms = ranking.question_terms(spark.createDataFrame([(1, QUESTION)], "qid int, question string"))
    return {r.id: r.lexical_score for r in found.bm25(terms).collect()}


def batches(rng, n, size):
    truth, out = {}, []
    for version in range(n):
        rows = []
        for key in rng.sample([f"p{k}" for k in range(size * 3)], size):
            gone = rng.random() < 0.25
            text = None if gone or rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))
            rows.append((key, version, "delete" if gone else "upsert", text))
            truth.pop(key, None)
            if not gone:
                truth[key] = text
        rows += [(key, version - 1, "upsert", "stale peace") for key, *_ in rows[:2]]  # an older row of the same batch
        out.append((rows, dict(truth)))
    return out


@pytest.mark.parametrize("pushed", [1000, 3])
def test_edits_equal_a_rebuild(spark, pushed, monkeypatch):
    monkeypatch.setattr("passagework.operators.segments.PUSHED_TERMS", pushed)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/segments-{pushed}"
    names = set()
    for k, (rows, truth) in enumerate(batches(random.Random(pushed), 7, 12)):
        live = SegmentedIndex(spark, path, ["id"], ["version"], fanout=3)  # nothing but the folder is left of the one before
        assert (live.index() is None) == (k == 0)
        live.apply(spark.createDataFrame(rows, BATCH))
        found = live.index()
        want = index.prepare(spark.createDataFrame(list(truth.items()), "id string, text string"), ["id"])
        assert (found.n, found.total) == (want.n, want.total)
        assert scores(spark, found) == scores(spark, want)
        assert {(r.term, r.df) for r in found.terms.collect()} == {(r.term, r.df) for r in want.terms.collect()}
        assert sorted(r.id for r in found.passages.collect()) == sorted(truth)
        if k == 3:
            live.apply(spark.createDataFrame([("p0", 99, "delete", None)], BATCH), batch=2)  # a batch that comes again
            assert scores(spark, live.index()) == scores(spark, want)
        names |= {s.segment for s in live._segments()}
    assert any(n.count("-") == 2 for n in names)  # merges
    assert len(live._segments()) < 9


def test_an_edit_reads_its_own_texts_and_keys_only(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/segments-plan"
    live = SegmentedIndex(spark, path, ["id"], ["version"])
    live.apply(spark.createDataFrame([(f"p{k}", 0, "upsert", f"peace {k}") for k in range(50)], BATCH))
    old = live._alive(["seg-0"], "tokens", None).filter(live._touched(spark.createDataFrame([("p7",)], "id string")))
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "p7" in plan.split("PushedFilters")[1]
    before = {s.segment for s in live._segments()}
    live.apply(spark.createDataFrame([("p7", 1, "upsert", "work"), ("new", 1, "upsert", "peace")], BATCH))
    assert before < {s.segment for s in live._segments()}
    assert sum(s.n for s in live._segments()) == 52 and live.index().n == 51
    assert spark.read.parquet(f"{path}/tomb-1/dead").count() == 1


def test_segments_of_two_keys_and_of_nothing(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/segments-two"
    live = SegmentedIndex(spark, path, ["doc", "line"], ["version"])
    make = lambda *rows: spark.createDataFrame(rows, "doc long, line long, version long, op string, text string")
    live.apply(make((1, 1, 0, "delete", None)))
    assert live.index() is None or live.index().n == 0
    live.apply(make((1, 1, 0, "upsert", "peace art"), (1, 2, 0, "upsert", "peace"), (2, 1, 0, "upsert", None)))
    live.apply(make((1, 2, 1, "upsert", "art"), (2, 1, 1, "delete", None)))
    terms = ranking.question_terms(spark.createDataFrame([(1, "art")], "qid int, question string"))
    assert live.index().n == 2 and sorted((r.doc, r.line) for r in live.index().bm25(terms).collect()) == [(1, 1), (1, 2)]


def test_many_rows_of_few_terms_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(index, "BROADCAST_TERMS", 5)
    prepared = index.prepare(spark.createDataFrame([("a", "peace art"), ("b", "art")], "id string, text string"), ["id"])
    terms = spark.range(20).select(F.col("id").alias("qid"), F.lit("art").alias("term"))
    assert prepared.bm25(terms).count() == 40
    few = prepared.bm25(terms.limit(3)).collect()
    assert len(few) == 6 and len({r.lexical_score for r in few if r.id == "a"}) == 1


def test_rows_before_any_batch(spark):
    assert LiveSnapshot(spark, "id", ["version"]).rows().count() == 0
    assert LiveSnapshot(spark, "id", ["version"], schema=BATCH).rows().columns == ["id", "version", "text"]
