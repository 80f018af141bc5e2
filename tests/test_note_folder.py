"""A folder of notes as changes: edits, renames, vanished and excluded notes, crashes."""

import os
import re

import pytest

import __spark_entry__
from passagework.sources import notes
from passagework.sources.notes import NoteFolder
from passagework.streaming.live import LiveSnapshot


def write(root, path, text, at):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8") as f:
        f.write(text)
    os.utime(full, (at, at))


@pytest.mark.parametrize("named", [10_000, 0])
def test_changes_of_a_folder(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(notes, "NAMED_FILES", named)
    root, state = str(tmp_path / "notes"), f"file://{tmp_path}/state"
    hidden = []
    for k, name in enumerate(("a.md", "b c+d%20é.md", "sub/c.md", "old/d.md")):
        write(root, name, f"text {k}", 1000 + k)
    write(root, "no.txt", "no", 1)
    live = LiveSnapshot(spark, "path", ["version"], path=f"file://{tmp_path}/live")
    seen = []

    def take(rows, number):
        seen.append(sorted((r.path, r.op, r.text) for r in rows.collect()))
        live.merge(rows, number)

    poll = lambda: NoteFolder(spark, root, state, lambda: hidden).poll(take)
    there = lambda: {r.path: r.text for r in live.rows().collect()}
    assert poll() == 0 and there() == {"a.md": "text 0", "b c+d%20é.md": "text 1", "sub/c.md": "text 2", "old/d.md": "text 3"}
    assert poll() == 1 and seen[-1] == []
    write(root, "a.md", "edited", 2000)
    os.rename(f"{root}/sub/c.md", f"{root}/sub/e.md")
    hidden.append("old/")
    assert poll() == 2
    assert seen[-1] == [("a.md", "upsert", "edited"), ("old/d.md", "delete", None), ("sub/c.md", "delete", None), ("sub/e.md", "upsert", "text 2")]
    hidden.clear()
    os.remove(f"{root}/a.md")
    poll()
    assert there() == {"b c+d%20é.md": "text 1", "sub/e.md": "text 2", "old/d.md": "text 3"}


def test_a_crash_gives_the_same_batch_again(spark, tmp_path):
    root, state = str(tmp_path / "notes"), f"file://{tmp_path}/state"
    write(root, "a.md", "one", 1000)
    folder = NoteFolder(spark, root, state)

    def crash(rows, number):
        rows.collect()
        raise RuntimeError("lost")

    got = []
    with pytest.raises(RuntimeError):
        folder.poll(crash)
    write(root, "b.md", "late", 1001)  # after the listing
    assert folder.poll(lambda rows, n: got.append((n, sorted(r.path for r in rows.collect())))) == 0
    assert folder.poll(lambda rows, n: got.append((n, sorted(r.path for r in rows.collect())))) == 1
    assert got == [(0, ["a.md"]), (1, ["b.md"])]


def test_what_changes_after_the_listing_waits(spark, tmp_path):
    root, state = str(tmp_path / "notes"), f"file://{tmp_path}/state"
    write(root, "a.md", "one", 1000)
    write(root, "b.md", "two", 1000)
    write(root, "c.md", "three", 1000)
    folder = NoteFolder(spark, root, state)
    folder._list(f"{state}/listing-0")
    write(root, "a.md", "changed since", 2000)
    os.remove(f"{root}/b.md")
    got = []
    folder.poll(lambda rows, n: got.append(sorted((r.path, r.op) for r in rows.collect())))
    folder.poll(lambda rows, n: got.append(sorted((r.path, r.op) for r in rows.collect())))
    assert got == [[("c.md", "upsert")], [("a.md", "upsert"), ("b.md", "delete")]]


def test_many_changes_open_no_older_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(notes, "NAMED_FILES", 1)
    root, got = tmp_path / "many", []
    root.mkdir()
    for k in range(6):
        (root / f"{k}.md").write_text(f"note {k}")
        os.utime(root / f"{k}.md", (1_000_000 + k, 1_000_000 + k))
    folder = notes.NoteFolder(spark, str(root), str(tmp_path / "state"))
    folder.poll(lambda rows, n: None)
    for k in (1, 4):
        (root / f"{k}.md").write_text(f"edited {k}")
    opened = []

    def keep(rows, n):
        got.extend(sorted((r.path, r.op, r.text) for r in rows.collect()))
        opened.append(rows._jdf.queryExecution().executedPlan().toString())

    folder.poll(keep)
    assert got == [("1.md", "upsert", "edited 1"), ("4.md", "upsert", "edited 4")]
    assert re.search(r"\(file_modification_time#\d+ >= ", opened[0]) or re.search(r"_metadata#\d+\.file_modification_time >= ", opened[0])


def test_notes_are_written_and_removed_by_tasks(spark, tmp_path):
    root = tmp_path / "its notes"
    here = lambda: {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}
    rows = [("a.md", "one\n"), ("sub/deep/b c%20é.md", "zwei ü"), ("none.md", None), ("empty.md", "")]
    notes.write_notes(spark.createDataFrame(rows, "path string, text string"), f"file://{root}")
    assert here() == {p: (t or "").encode() for p, t in rows}
    notes.write_notes(spark.createDataFrame([("a.md", "edited")], "path string, text string"), f"file://{root}")
    notes.remove_notes(spark.createDataFrame([("none.md",), ("gone.md",), ("sub",)], "path string"), f"file://{root}")
    assert here() == {"a.md": b"edited", "sub/deep/b c%20é.md": "zwei ü".encode(), "empty.md": b""}


def test_a_task_lists_many_folders_and_reads_many_notes(spark, tmp_path):
    for k in range(800):
        write(tmp_path / "notes", f"{k % 200}/{k}.md", f"note {k}", 1000)
    group, counts = "many small notes", []
    spark.sparkContext.setJobGroup(group, group)
    try:
        NoteFolder(spark, str(tmp_path / "notes"), f"file://{tmp_path}/state").poll(lambda rows, n: counts.append(rows.count()))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    tasks = [told.getStageInfo(s).numTasks for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds if told.getStageInfo(s)]
    assert counts == [800] and max(tasks) <= 4 * spark.sparkContext.defaultParallelism


def test_note_changes_need_no_task_for_each_note(spark):
    group = "note changes"
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = __spark_entry__.queries()["s1_note_changes"](spark, "/root/testdata/sf0.001").count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    tasks = [told.getStageInfo(s).numTasks for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds if told.getStageInfo(s)]
    assert rows == 198 and max(tasks) <= 4 * spark.sparkContext.defaultParallelism


def test_a_poll_leaves_the_session_as_it_was(spark, tmp_path):
    write(tmp_path / "notes", "a.md", "one", 1000)
    folder, key, seen = NoteFolder(spark, str(tmp_path / "notes"), f"file://{tmp_path}/state"), "spark.sql.files.openCostInBytes", []
    before = spark.conf.get(key)
    spark.conf.set(key, "123456")
    try:

        def crash(rows, number):
            seen.append(spark.conf.get(key))
            raise RuntimeError("lost")

        with pytest.raises(RuntimeError):
            folder.poll(crash)
        assert seen == [notes.NOTE_COST] and spark.conf.get(key) == "123456"
    finally:
        spark.conf.set(key, before)
