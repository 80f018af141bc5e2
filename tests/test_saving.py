"""Planned block ids, and saving that goes on after it was cut off."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from passagework.operators import saving
from passagework.operators.markdown import outline_notes, parse_notes
from passagework.plans import note_queries

NOW = datetime(2024, 1, 2, tzinfo=UTC)
SOURCE = "para\r\n\r\n> quote\r\n\r\n- a\r\n  - b ^old\r\n- c\r\n"


def frames(spark, **texts):
    notes = spark.createDataFrame([(f"{k}.md", t) for k, t in texts.items()], "path string, text string")
    return notes, parse_notes(notes)


def test_plan_and_edits(spark):
    notes, passages = frames(spark, n=SOURCE)
    chosen = passages.filter("line_start != 5")
    plan = {(r.path, r.line): r for r in saving.plan_block_ids(chosen.unionByName(chosen), notes).collect()}
    assert {k[1]: (r.op, r.status) for k, r in plan.items()} == {1: ("append", "ok"), 3: ("insert", "ok"), 6: ("keep", "ok"), 7: ("append", "ok")}
    name = lambda line: plan["n.md", line].block_id
    assert name(6) == "old" and len({name(k) for k in (1, 3, 6, 7)}) == 4
    (edit,) = saving.edited(notes, saving.plan_block_ids(chosen, notes)).collect()
    assert edit.after == f"para ^{name(1)}\r\n\r\n> quote\r\n\r\n^{name(3)}\r\n\r\n\r\n- a\r\n  - b ^old\r\n- c ^{name(7)}\r\n"
    later, passages = frames(spark, n=edit.after)
    again = saving.plan_block_ids(passages.filter("line_start IN (1, 3, 9, 10) AND kind <> 'x'"), later)
    assert {r.op for r in again.collect()} == {"keep"} and saving.edited(later, again).count() == 0
    assert saving.unfound(later, saving.plan_block_ids(chosen, notes)).count() == 0 and saving.unfound(notes, saving.plan_block_ids(chosen, notes)).count() == 3


def test_a_note_of_many_passages(spark):
    rows = [f"p{k}" + (" ^own" if k == 7 else "") for k in range(200)]
    notes, passages = frames(spark, n="\n\n".join(rows), m="# \u00a0\nx")
    plan = saving.plan_block_ids(passages, notes)
    names = {(r.path, r.line): (r.op, r.block_id) for r in plan.collect()}
    assert len(names) == 201 and names["n.md", 15] == ("keep", "own")
    after = {r.path: r.after for r in saving.edited(notes, plan).collect()}
    assert after["n.md"] == "\n\n".join(x if k == 7 else f"{x} ^{names['n.md', 2 * k + 1][1]}" for k, x in enumerate(rows))
    saved = spark.createDataFrame([("s.md", "![[n#^own]] ![[m]] ![[gone]]")], "path string, text string")
    got = saving.saved_embeds(saved, notes, outline_notes(notes)).orderBy("nth").collect()
    assert [(r.id, r.line_start, r.line_end, r.status) for r in got] == [("n.md:15-15", 15, 15, "ok"), (None, 1, 2, "ok"), (None, None, None, "no such note")]


def test_saved_embeds_parses_the_notes_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(note_queries, "parse_notes", lambda notes: parse_notes(notes.mapInArrow(count, notes.schema)))
    note_queries.j11_saved_embeds(spark, "/root/testdata/sf0.001").collect()
    assert seen.value == note_queries.list_notes(spark, "/root/testdata/sf0.001").count()


def test_what_is_wrong_is_said_for_each_passage(spark):
    notes, passages = frames(spark, n=SOURCE, m="one\n\ntwo")
    moved = passages.withColumn("text", F.when(F.col("text") == "two", "other").otherwise(F.col("text")))
    gone = moved.filter("text = 'one'").withColumn("path", F.lit("gone.md")).withColumn("id", F.lit("g"))
    odd = moved.filter("text = 'one'").withColumn("kind", F.lit("heading")).withColumn("id", F.lit("h"))
    got = {r.id: r.status for r in saving.plan_block_ids(moved.unionByName(gone).unionByName(odd), notes).collect()}
    assert got["n.md:6-6"] == saving.OVERLAP and got["m.md:3-3"] == saving.CHANGED and got["g"] == saving.NO_NOTE and got["h"] == saving.NO_KIND
    assert got["n.md:5-6"] == got["n.md:1-1"] == saving.OK and got["m.md:1-1"] == saving.OVERLAP  # with the one that was made a heading
    assert saving.plan_block_ids(passages.limit(0), notes).count() == 0


def test_a_taken_id_is_not_taken_again(spark):
    notes, passages = frames(spark, n="one\n\ntwo")
    first = saving.plan_block_ids(passages.limit(1), notes).first().block_id
    taken, passages = frames(spark, n=f"one\n\ntwo ^{first}")
    got = saving.plan_block_ids(passages.filter("line_start = 1"), taken).first()
    assert got.status == "ok" and got.block_id != first


def files(tmp_path, spark, **texts):
    for k, t in texts.items():
        (tmp_path / f"{k}.md").write_text(t)
    notes, passages = frames(spark, **texts)
    return notes, passages.withColumn("position", F.row_number().over(Window.orderBy(F.desc("path"), F.desc("line_start"))))


def test_saving_and_embeds(spark, tmp_path):
    notes, shown = files(tmp_path, spark, n="one\n\ntwo", m="> three")
    save = lambda: saving.save_selection(str(tmp_path), notes, shown, "a/b: c?", "q x.md", f"file://{tmp_path}/state", now=NOW)
    path = save()
    assert path.endswith("Saved/a b c.md") and save() == path and len(list((tmp_path / "Saved").iterdir())) == 1
    body = (tmp_path / "Saved" / "a b c.md").read_text()
    assert "q%20x.md" in body and "2024-01-02" in body and body.count("![[") == 3 and body.index("[[n#") < body.index("[[m#")
    after = spark.createDataFrame([(f"{k}.md", (tmp_path / f"{k}.md").read_text()) for k in "nm"], "path string, text string")
    got = saving.saved_embeds(spark.createDataFrame([("s.md", body)], "path string, text string"), after, parse_notes(after)).orderBy("nth").collect()
    assert [r.id for r in got] == ["n.md:3-3", "n.md:1-1", "m.md:1-1"] and {r.status for r in got} == {"ok"}
    other = saving.unique_note(spark, f"{tmp_path}/Saved", "a/b: c?", "another")
    assert other.endswith("a b c 2.md")


def test_saving_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    notes, shown = files(tmp_path, spark, n="one", m="two")
    save = lambda: saving.save_selection(str(tmp_path), notes, shown, "q", "q.md", f"file://{tmp_path}/state", now=NOW)
    writes = []
    real = saving.replace_text

    def cut_off(s, path, text):
        if writes:
            raise RuntimeError("lost")
        writes.append(path)
        real(s, path, text)

    monkeypatch.setattr(saving, "replace_text", cut_off)
    with pytest.raises(RuntimeError):
        save()
    edited = sum("^pw-" in (tmp_path / f"{k}.md").read_text() for k in "nm")
    assert edited == 1 and not (tmp_path / "Saved").exists()
    monkeypatch.setattr(saving, "replace_text", real)
    assert save().endswith("Saved/q.md") and all("^pw-" in (tmp_path / f"{k}.md").read_text() for k in "nm")


def test_a_note_that_changed_meanwhile_is_left_alone(spark, tmp_path, monkeypatch):
    notes, shown = files(tmp_path, spark, n="one")
    (tmp_path / "n.md").write_text("one, changed")
    with pytest.raises(saving.StaleSource):
        saving.save_selection(str(tmp_path), notes, shown, "q", "q.md", f"file://{tmp_path}/state")
    assert (tmp_path / "n.md").read_text() == "one, changed" and not (tmp_path / "Saved").exists()
    with pytest.raises(ValueError, match="nothing"):
        saving.save_selection(str(tmp_path), notes, shown.limit(0), "q", "q.md", f"file://{tmp_path}/state")
