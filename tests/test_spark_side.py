import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passagework.functions import embedding
from passagework.functions.spec import Criteria
from passagework.operators import inclusions, index, judge, ranges, ranking, score_store
from passagework.operators.markdown import parse_notes
from passagework.sources.notes import read_notes
from passagework.storage import written
from passagework.streaming.live import LiveSnapshot


def lcg_corpus():
    seed, words = 13, "conflict mediation peace work art other".split()

    def draw(n):
        nonlocal seed
        seed = (seed * 1664525 + 1013904223) % 2**32
        return seed % n

    rows = []
    for i in range(600):
        n = 1 + draw(30)
        rows.append((f"{'a' if i % 3 == 0 else 'Z'}-{i}", " ".join(words[draw(6)] for _ in range(n))))
    return [*rows, ("x-1", rows[5][1].replace(" ", "  ")), ("x-2", rows[5][1])]


def expected(rows, question):
    terms = list(dict.fromkeys(w for w in question.split() if w not in ("the", "and")))
    docs = [t.split() for _, t in rows]
    avg = max(1, sum(map(len, docs)) / len(docs))
    out = {}
    for (key, _), d in zip(rows, docs):
        s = n = 0
        for t in terms:
            tf, df = d.count(t), sum(t in x for x in docs)
            if tf:
                n += 1
                s += np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.75 + 0.25 * len(d) / avg))
        if n:
            out[key] = s * (1 + np.log(n))
    return out


@pytest.mark.parametrize("question", ["conflict mediation art", "peace peace", "missing", "the and"])
@pytest.mark.parametrize("limits", [(1_000, 100_000), (0, 100_000), (0, 0)])
def test_bm25_against_numpy(spark, question, limits, monkeypatch):
    monkeypatch.setattr(index, "PUSHED_TERMS", limits[0])
    monkeypatch.setattr(index, "BROADCAST_TERMS", limits[1])
    rows = lcg_corpus()
    df = spark.createDataFrame(rows, "id string, text string")
    terms = ranking.question_terms(spark.createDataFrame([(1, question)], "qid int, question string"))
    got = {r.id: r.lexical_score for r in ranking.bm25(df, terms, ["id"], "text").collect()}
    want = expected(rows, question)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_copies_come_last(spark):
    df = spark.createDataFrame([("a", "peace  art"), ("b", "peace art"), ("c", "peace work")], "id string, text string")
    terms = ranking.question_terms(spark.createDataFrame([(1, "peace art")], "qid int, question string"))
    ranked = lambda k: [(r.id, r.is_copy) for r in ranking.lexical(index.prepare(df, ["id"]), terms, k).orderBy("rank").collect()]
    assert ranked(5) == [("a", False), ("c", False), ("b", True)] and ranked(2) == [("a", False), ("c", False)]


def test_fusion_keeps_ranks_of_lost_ids(spark):
    lex = spark.createDataFrame([(1, "a", 1, 2.0)], "qid int, id string, rank long, lexical_score double")
    sem = spark.createDataFrame([(1, "gone", 1, 0.9), (1, "b", 2, 0.8)], "qid int, id string, rank long, semantic_score double")
    passages = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, fp string")
    got = {r.id: r.retrieval_score for r in ranking.fuse(lex, sem, passages, "id", 9).collect()}
    assert got == {"a": 0.65 / 61, "b": 0.35 / 62}
    cut = ranking.bounded(ranking.fuse(lex, sem, passages, "id", 2), 1).collect()
    assert len(cut) == 1 and cut[0].truncated


def test_vector_floor(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("B", [1.0, 0.0]), ("c", [0.1, 0.9]), ("n", [float("nan"), 0.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, query_vector array<float>")
    for few in (32, 0):
        assert [r.id for r in ranking.vector_topk(v, q, 9, few=few).orderBy("rank").collect()] == ["B", "b"]
        assert [r.id for r in ranking.vector_topk(v, q, 1, few=few).collect()] == ["B"]


def test_overlap_folds(spark):
    r = spark.createDataFrame([("p", 1, 5, 3.0), ("p", 4, 9, 2.0), ("p", 8, 12, 1.0), ("q", 1, 1, 1.0)], "path string, line_start int, line_end int, score double")
    kept = ranges.drop_overlaps(r, [-F.col("score")], ["path"]).orderBy("path", "line_start").collect()
    assert [(x.path, x.line_start) for x in kept] == [("p", 1), ("p", 8), ("q", 1)]  # the dropped one drops nothing
    c = spark.createDataFrame([("p", *x) for x in ((1, 2), (1, 5), (3, 4), (8, 9), (8, 9))], "path string, line_start int, line_end int")
    assert [(x.line_start, x.line_end) for x in ranges.context_ranges(c, ["path"]).orderBy("line_start").collect()] == [(1, 5), (8, 9)]
    s = spark.createDataFrame([("p", 1, 5, 0, False), ("p", 2, 3, 1, False), ("p", 2, 4, 2, True)], "path string, line_start int, line_end int, position int, manual boolean")
    assert [x.position for x in ranges.drop_covered(s, ["path"]).orderBy("position").collect()] == [0, 2]


def score(h, s, at):
    return (h, s, "other", {"relevant": s}, at)


def test_score_store(spark):
    store = spark.createDataFrame([score("a", 0.1, 1), score("b", 0.2, 2), score("bad", float("nan"), 3)], score_store.SCHEMA)
    hits, missing = score_store.lookup(spark.createDataFrame([("a",), ("bad",), ("z",)], "hash string"), store)
    assert [r.hash for r in hits.collect()] == ["a"] and sorted(r.hash for r in missing.collect()) == ["bad", "z"]
    used = score_store.touched(store, hits, 10)
    kept = score_store.upsert(used, spark.createDataFrame([score("c", 0.3, 11)], score_store.SCHEMA), 2)
    assert sorted(r.hash for r in kept.collect()) == ["a", "c"]
    old = spark.createDataFrame([('{"version":1,"entries":[{"hash":"%s","value":{"score":0.5,"contribution":"other","scores":{"relevant":0.5}}},{"hash":"x","value":{"score":1,"contribution":"odd","scores":{}}}]}' % ("0" * 64),)], "value string")
    assert sorted(r.hash for r in score_store.import_records(old, store).collect()) == ["0" * 64, "a", "b", "bad"]


def test_judge(spark):
    rows = spark.createDataFrame([("h1", "peace and art"), ("h1", "peace and art"), ("h2", "none")], "hash string, model_text string")
    asked = judge.ask(rows, "peace art", Criteria("generic"), judge.overlap_scorer, size=1)
    out = {r.hash: (r.score, r.contribution) for r in judge.validated(asked, "generic").collect()}
    assert out == {"h1": (1.0, "other"), "h2": (0.0, "other")}
    with pytest.raises(PySparkException, match="valid score"):
        judge.validated(judge.ask(rows, "q", Criteria("generic"), lambda *a: [{"relevant": {"score": 1.5}}] * len(a[3])), "generic").collect()


def test_retries():
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise judge.Throttled
        return x

    assert judge.with_retries(flaky, sleep=waits.append, jitter=lambda: 1)(5) == 5 and waits == [0.25, 0.5]
    with pytest.raises(judge.Throttled):
        judge.with_retries(lambda: (_ for _ in ()).throw(judge.Throttled), sleep=waits.append)()


def test_gate_halves_and_grows():
    now = [0.0]
    gate = judge.Gate(16, clock=lambda: now[0])
    gate.throttle()
    gate.throttle()  # within a second: once
    assert gate.limit == 8
    now[0] = 1.5
    gate.throttle()
    assert gate.limit == 4
    for _ in range(9):
        with gate:
            pass
    assert gate.limit == 4  # not calm yet
    now[0] = 7.0
    for _ in range(4 + 5):
        with gate:
            pass
    assert gate.limit == 6
    for _ in range(9):
        now[0] += 2
        gate.throttle()
    assert gate.limit == 1


def throttling(question, criteria, context, texts):
    """Each batch's first two calls in a worker are throttled; one text is too large."""
    seen = throttling.__dict__.setdefault("seen", {})
    key = tuple(texts)
    seen[key] = seen.get(key, 0) + 1
    if seen[key] < 3:
        raise judge.Throttled
    if any("large" in t for t in texts):
        raise judge.TooLarge
    return judge.Reply(judge.overlap_scorer(question, criteria, context, texts), 7)


def test_a_throttling_scorer_is_asked_again_and_counted(spark):
    rows = [(f"h{k:02}", "too large" if k == 24 else f"peace {k}") for k in range(25)] * 2
    df = spark.createDataFrame(rows, "hash string, model_text string")
    asked = written(judge.ask(df, "peace", Criteria("generic"), throttling, size=4, in_flight=8, parallel=2), "asked")
    got = {r.hash: r.answers for r in asked.collect()}
    assert len(got) == 25 and asked.count() == 25 and [h for h, a in got.items() if a is None] == ["h24"]
    c = judge.costs(asked).first()
    assert (c.requests, c.retries, c.input_tokens) == (7, 14, 6 * 7) and c.request_ms > 0
    empty = judge.costs(judge.ask(df.limit(0), "q", Criteria("generic"), throttling)).first()
    assert (empty.requests, empty.retries, empty.input_tokens) == (0, 0, 0)


def test_order(spark):
    rows = spark.createDataFrame([("a", 0.9, "definition"), ("b", 0.99, "condition"), ("c", 0.2, "other")], "id string, score double, contribution string")
    passed, below = judge.select(rows, 0.5, "default", ["id"], 9)
    assert [r.id for r in passed.collect()] == ["a", "b"] and [r.id for r in below.collect()] == ["c"]
    assert [r.id for r in judge.select(rows, 0.5, "generic", ["id"], 1)[0].collect()] == ["b"]


def test_inclusion_match(spark):
    entries = spark.createDataFrame([("p", "f", 0.1, "other", {}), ("p", "g", 0.1, "other", {}), ("p", "h", 0.1, "other", {})], inclusions.ENTRY)
    passages = spark.createDataFrame([("p", "f", "1"), ("p", "g", "2"), ("p", "g", "3")], "path string, fingerprint string, id string")
    ok, missing = inclusions.match(entries, passages)
    assert [r.id for r in ok.collect()] == ["1"] and sorted(r.fingerprint for r in missing.collect()) == ["g", "h"]


def test_notes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b.md").write_text("# H\none\n\ntwo")
    (tmp_path / "sub" / "c.md").write_text("x")
    (tmp_path / "d.txt").write_text("no")
    notes = read_notes(spark, str(tmp_path), ["/sub/"])
    assert [r.path for r in notes.collect()] == ["a b.md"]
    assert sorted(r.text for r in parse_notes(notes).collect()) == ["one", "two"]


def test_live_snapshot(spark):
    seen = []
    live = LiveSnapshot(spark, "path", ["version"], lambda rows: seen.append(sorted((r.path, r.text) for r in rows.collect())))
    make = lambda *rows: spark.createDataFrame(rows, "path string, version long, op string, text string")
    live.merge(make(("a", 2, "upsert", "new"), ("b", 1, "upsert", "b")))
    live.merge(make(("a", 1, "upsert", "stale"), ("b", 3, "delete", None)))
    live.merge(make(("b", 2, "upsert", "late")))
    assert seen == [[("a", "new"), ("b", "b")], [("a", "new")], [("a", "new")]]


def test_live_snapshot_goes_on_after_a_restart(spark, tmp_path):
    source, path = str(tmp_path / "changes"), f"file://{tmp_path}/snapshot"
    truth = {}
    for k in range(7):
        rows = [(f"p{(k * 5 + j) % 9}", k * 10 + j if j % 3 else k, "delete" if (k + j) % 4 == 0 else "upsert", f"{k}-{j}") for j in range(6)]
        for r in rows:
            truth[r[0]] = max(truth.get(r[0], r), r, key=lambda x: x[1:])
        spark.createDataFrame(rows, "path string, version long, op string, text string").write.mode("append").parquet(source)
        live = LiveSnapshot(spark, "path", ["version"], path=path, compact=3)  # nothing but the folder is left of the one before
        live.follow(spark.readStream.schema("path string, version long, op string, text string").parquet(source))
        assert sorted((r.path, r.text) for r in live.rows().collect()) == sorted((p, r[3]) for p, r in truth.items() if r[2] != "delete")
    bases, deltas = live._parts()
    assert len(bases) <= 2 and len(deltas) <= 6
    before = sorted(live.rows().collect())
    for batch in (0, 6):  # one that is folded already, and the last
        live.merge(spark.createDataFrame(rows if batch else [("p0", -1, "upsert", "old")], "path string, version long, op string, text string"), batch)
        assert sorted(live.rows().collect()) == before


def test_places_within_buckets(spark):
    rows = [(None if k % 11 == 0 else "hot" if k % 3 else f"b{k % 7}", (k * 7919) % 1009) for k in range(1000)]
    df = spark.createDataFrame(rows, "bucket string, at int").repartition(5)
    got = {(r.bucket, r.at): (r.batch_id, r.slot) for r in judge.batched(df, 10, ["bucket"], ["at"]).collect()}
    for bucket in {b for b, _ in rows}:
        for n, at in enumerate(sorted(a for b, a in rows if b == bucket)):
            assert got[bucket, at] == (n // 10, n % 10)
    assert len(got) == 1000


def test_embedding(spark):
    w = np.arange(12, dtype=np.float32).reshape(4, 3)
    assert not embedding.encode([1, 9], w).any()
    v = embedding.encode([0, 2, 1], w)
    assert abs(float((v * v).sum()) - 1) < 1e-6 and np.allclose(v, w[[0, 2]].mean(0) / np.linalg.norm(w[[0, 2]].mean(0)))
    df = spark.createDataFrame([(1, "ab")], "id int, text string")
    assert len(embedding.encode_texts(df, lambda t: [0, 2], w).first().vector) == 3
