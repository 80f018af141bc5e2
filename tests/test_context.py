"""Contexts by links, on notes with everything that can go wrong."""

import pytest

from passagework.operators import context

NOTES = [
    ("a/First.md", "# First\nx ^anchor\n## Child\ny\n# Second\nz\n\n```\n# no heading\n```\nend"),
    ("First.md", "top"),
    ("b/c/Deep.md", "# Twice\none\n# Twice\ntwo\n\n- item ^it\n  - below\n\nSet\n---\nlast"),
    ("d/Deep.md", None),
    ("Empty.md", ""),
]
LINKS = [
    ("a/First", "whole", "# First\nx ^anchor\n## Child\ny\n# Second\nz\n\n```\n# no heading\n```\nend"),
    ("a/First#First", "section", "# First\nx ^anchor\n## Child\ny"),
    ("a/First.md#Child", "child", "## Child\ny"),
    ("a/First#Second", "to the end", "# Second\nz\n\n```\n# no heading\n```\nend"),
    ("a/First#^anchor", "block", "x ^anchor"),
    ("First", "fewest folders", "top"),
    ("Deep#Twice", "none in the nearer note", None),
    ("b/c/Deep#Twice", "the first of two", "# Twice\none"),
    ("b/c/Deep#^it", "an item with what is below it", "- item ^it\n  - below"),
    ("b/c/Deep#Set", "underlined", "Set\n---\nlast"),
    ("a/First#no heading", "fenced", None),
    ("Empty", "empty", ""),
    ("Gone", "no note", None),
]


def frames(spark, links, source="q.md"):
    notes = spark.createDataFrame(NOTES, "path string, text string")
    return spark.createDataFrame([(source, k, link) for k, link in enumerate(links)], "source string, nth int, link string"), notes


def test_every_kind_of_link(spark):
    links, notes = frames(spark, [link for link, *_ in LINKS])
    got = {r.nth: r for r in context.read(links, notes).collect()}
    assert [got[k].text for k in range(len(LINKS))] == [text for *_, text in LINKS]
    assert got[12].status == context.NO_NOTE and got[6].status == got[10].status == context.NO_PLACE
    assert (got[1].line_start, got[1].line_end) == (1, 4) and got[6].path == "d/Deep.md"


def test_ambiguity_own_fragments_and_repeats(spark):
    links, notes = frames(spark, ["Deep", "#^anchor", "a/First#^anchor", "First#", "First"], "a/First.md")
    got = {r.nth: r for r in context.resolve(links, notes).collect()}
    assert sorted(got) == [0, 1, 3] and got[0].n == 2 and got[1].path == "a/First.md" and got[3].path == "First.md"


@pytest.mark.parametrize("most, status", [(48_000, context.OK), (30, context.TOO_LONG)])
def test_contexts_of_several_questions(spark, most, status):
    links, notes = frames(spark, ["a/First#First", "First"])
    more, _ = frames(spark, ["First", "Gone"], "p.md")
    got = {r.source: r for r in context.contexts(links.unionByName(more), notes, most).collect()}
    text = "# First\nx ^anchor\n## Child\ny\n\ntop"
    assert got["q.md"].status == status and got["q.md"].context == (text if status == "ok" else None) and got["q.md"].units == len(text)
    assert got["p.md"].status == context.NO_NOTE and got["p.md"].context is None
    assert context.contexts(links.limit(0), notes).count() == 0
