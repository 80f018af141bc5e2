"""The composed answer on small notes: each rule of a run by itself."""

import pytest
from pyspark.sql import functions as F

from passagework.functions.identity import old_score_hash, score_hash
from passagework.functions.spec import Criteria, QuerySpec
from passagework.functions.text import inclusion_fingerprint, model_text
from passagework.operators import inclusions, index, judge, score_store
from passagework.operators.answer import answer
from passagework.operators.markdown import parse_notes

NOTE = "# Peace\n\npeace one\n\npeace two art\n\n- peace item\n  - peace art item\n\npeace three\n\n# Other\n\npeace art work\n\nfar away"
LONG = "# " + "Head " * 2000 + "\n\n" + "peace " * 3990 + "\n\n" + "peace art " * 2500


@pytest.fixture(scope="module")
def world(spark):
    notes = spark.createDataFrame([("n.md", NOTE), ("ctx.md", "# Ground\nwords of it\n# Rest\nmore")], "path string, text string")
    passages = parse_notes(notes.filter("path = 'n.md'")).cache()
    return notes, passages, index.prepare(passages, ["id"], "search_text"), spark.createDataFrame([], score_store.SCHEMA)


def ask(world, scorer=judge.overlap_scorer, store=None, question="peace art", adjacent=0, limit=None, threshold=None, contexts=(), **more):
    notes, passages, idx, empty = world
    spec = QuerySpec(question, context_paths=contexts, criteria=Criteria("generic"), limit=limit, threshold=threshold, adjacent=adjacent)
    return spec, answer(passages, idx, spec, scorer, empty if store is None else store, notes=notes, **more)


def ids(df, order="position"):
    return [r.id.partition(":")[2] for r in df.orderBy(order).collect()]


def test_the_questions_own_limit_and_threshold(world):
    assert len(ids(ask(world, limit=2)[1].shown)) == 2
    assert len(ids(ask(world)[1].shown)) == len(ids(ask(world, threshold=0.0)[1].shown)) > 2
    got = ask(world, threshold=0.75, limit=9)[1]
    assert set(ids(got.shown)) == {"5-5", "7-8", "14-14"} and got.statistics.first().threshold == 0.75 and got.statistics.first().passed == 3


def test_overlaps_and_statistics_without_a_scorer(world):
    got = ask(world, None, limit=2)[1]
    s = got.statistics.first()
    assert (s.retrieved, s.overlap_removed, s.shortlisted, s.checked, s.requested, s.cached, s.passed) == (6, 1, 5, 0, 0, 0, 0)
    assert len(ids(got.shown)) == 2 and got.below.count() == got.skipped.count() == 0


def test_context_is_read_and_part_of_a_score(world):
    asked = []

    def scorer(question, criteria, context, texts):
        return [{"relevant": {"score": float(context == "# Ground\nwords of it")}} for _ in texts]

    spec, got = ask(world, scorer, contexts=("ctx#Ground",))
    assert {r.score for r in got.shown.collect()} == {1.0} and got.statistics.first().context_chars == 20 and not asked
    for link, why in (("ctx#Gone", "section"), ("nowhere", "no such note")):
        with pytest.raises(ValueError, match=why):
            ask(world, scorer, contexts=(link,))


def test_scores_are_read_promoted_and_kept(world, spark):
    spec, first = ask(world, clock=1)
    assert first.statistics.first().requested == 5
    again = ask(world, store=first.store, clock=2)[1]
    s = again.statistics.first()
    assert (s.requested, s.cached) == (0, 5) and {r.accessed for r in again.store.collect()} == {2}
    rows = world[1].withColumn("m", model_text("heading_path"))
    places = {**{c: F.col(c) for c in ("id", "path", "line_start", "line_end")}, "headings": F.col("heading_path"), "text": F.col("m")}
    old = rows.select(old_score_hash(spec, places, "offline").alias("hash"), F.lit(0.5).alias("score"), F.lit("other").alias("contribution"), F.create_map(F.lit("relevant"), F.lit(0.5)).alias("scores"), F.lit(0).cast("long").alias("accessed"))
    moved = ask(world, store=old, clock=3)[1]
    s = moved.statistics.first()
    assert (s.requested, s.cached) == (0, 5) and {r.score for r in moved.shown.collect()} == {0.5}
    new = {r.h for r in rows.select(score_hash(spec, F.col("m"), "offline").alias("h")).collect()}
    assert {r.accessed for r in moved.store.collect() if r.hash in new} == {3}


def test_old_keys_are_canonical_json(world):
    import hashlib
    import json

    spec = QuerySpec("q", criteria=Criteria("generic"))
    rows = world[1].withColumn("m", model_text("heading_path"))
    places = {**{c: F.col(c) for c in ("id", "path", "line_start", "line_end")}, "headings": F.col("heading_path"), "text": F.col("m")}
    for r in rows.withColumn("h", old_score_hash(spec, places, "n", "ctx")).collect():
        candidate = {"id": r.id, "path": r.path, "lineStart": r.line_start, "lineEnd": r.line_end, "headingPath": r.heading_path, "text": r.m}
        whole = {"namespace": "n", "question": "q", "criteria": {"mode": "generic"}, "context": "ctx", "candidate": candidate}
        assert r.h == hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_shown_passages_are_widened_and_covered_ones_go(world):
    got = ask(world, threshold=0.5, adjacent=1)[1].shown.orderBy("position").collect()
    by = {r.id: r for r in got}
    assert by["n.md:5-5"].text == "peace one\n\npeace two art\n\n- peace item\n  - peace art item" and (by["n.md:5-5"].line_start, by["n.md:5-5"].line_end) == (3, 8)
    assert "n.md:7-8" not in by and "n.md:3-3" not in by  # inside the widened one
    assert by["n.md:14-14"].text == "peace art work\n\nfar away"


def test_inclusions_stay_and_leave_what_is_below(world, spark):
    own = world[1].filter("id = 'n.md:3-3'").select("path", inclusion_fingerprint("text").alias("fingerprint")).first()
    entries = spark.createDataFrame([("n.md", own.fingerprint, 0.1, "other", {}, 0), ("n.md", "gone", 0.1, "other", {}, 1)], f"{inclusions.ENTRY}, nth long")
    got = ask(world, threshold=0.75, adjacent=1, entries=entries)[1]
    assert {r.id for r in got.shown.filter("manual").collect()} == {"n.md:3-3"} and got.missing.count() == 1
    assert "3-3" not in ids(got.below, "id")


def test_what_is_displayed_decides_what_is_too_long(spark):
    notes = spark.createDataFrame([("l.md", LONG)], "path string, text string")
    passages = parse_notes(notes)
    world = notes, passages, index.prepare(passages, ["id"], "search_text"), spark.createDataFrame([], score_store.SCHEMA)
    got = ask(world)[1]
    assert ids(got.skipped, "id") == ["5-5"] and set(ids(got.shown)) | set(ids(got.below, "id")) == {"3-3"}


def test_passages_are_read_by_their_keys(world, tmp_path, spark):
    from passagework.operators.answer import _fetched

    world[1].write.parquet(f"{tmp_path}/passages")
    passages = spark.read.parquet(f"{tmp_path}/passages")
    found = passages.filter("line_start = 5").select("id")
    plan = _fetched(passages, found, ("id",))._jdf.queryExecution().executedPlan().toString()
    assert "n.md:5-5" in plan.split("PushedFilters")[1].split("]")[0]
