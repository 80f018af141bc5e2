import pandas as pd
import pytest

from passagework.operators.markdown import note_places, outline_notes, parse_markdown, parse_notes


def rows(text):
    return [(p.kind, p.line_start, p.line_end) for p in parse_markdown("note.md", text)]


def test_nested_list_items_hold_their_subtrees():
    ps = parse_markdown("n.md", "- a\n  - b\n    - c\n  - d\n- e")
    assert [(p.line_start, p.line_end) for p in ps] == [(1, 4), (2, 3), (3, 3), (4, 4), (5, 5)]
    assert ps[2].render_text == "- a\n  - b\n    - c"
    assert ps[2].parent_id == ps[1].id and ps[4].parent_id is None


def test_kinds_under_a_heading():
    text = "# H\n\n```py\n# no heading\n```\n\n> [!note] x\n> y\n\n|a|b|\n|---|---|\n|1|2|\n"
    ps = parse_markdown("n.md", text)
    assert [p.kind for p in ps] == ["fence", "callout", "table"]
    assert all(p.heading_path == ("H",) for p in ps)


def test_setext_beats_other_elements():
    assert rows("text\n---\nafter") == [("paragraph", 3, 3)]
    assert rows("one\ntwo\n===\nx")[0] == ("paragraph", 1, 1)
    assert parse_markdown("n", "one\ntwo\n===\nx")[1].heading_path == ("two",)
    assert [k for k, *_ in rows("```\n---\nx")] == ["paragraph"]


def test_quirks():
    assert rows("> a\n\n> b\n\nc") == [("blockquote", 1, 3), ("paragraph", 5, 5)]
    assert rows("```\nnever closed\nx") == [("fence", 1, 3)]
    assert rows("---\na: 1\n...\nx") == [("paragraph", 4, 4)]
    assert rows("a\r\nb\r\n\r\nc") == [("paragraph", 1, 2), ("paragraph", 4, 4)]
    assert parse_markdown("n", "# a\n### c\nx")[0].heading_path == ("a", "c")
    assert rows("") == [] and rows("\n \n") == []


def test_paragraph_before_an_element_keeps_its_section():
    ps = parse_markdown("n", "# a\none\n## b\ntwo")
    assert [(p.text, p.heading_path, p.section_id) for p in ps] == [("one", ("a",), "n:1"), ("two", ("a", "b"), "n:3")]


def test_fenced_items_are_no_items():
    assert rows("- a\n  ```\n  - fake\n  ```\n- b") == [("list", 1, 4), ("list", 5, 5)]


def test_many_paragraphs():
    ps = parse_markdown("n", "\n\n".join(["w"] * 20_000))
    assert len(ps) == 20_000 and ps[-1].line_start == 39_999


def test_white_space_is_that_of_passages():
    assert rows("a\n\ufeff\nb") == [("paragraph", 1, 1), ("paragraph", 3, 3)]
    assert rows("a\n\x1c\nb") == [("paragraph", 1, 3)]  # a separator that only Python takes for space
    assert rows("\u00a0- a\n\u00a0\u00a0- b")[1] == ("list", 2, 2)


@pytest.mark.parametrize("make", [outline_notes, parse_notes, note_places])
def test_small_notes_share_a_frame(spark, make, monkeypatch):
    notes, made = spark.createDataFrame([], "path string, text string"), []
    monkeypatch.setattr(type(notes), "mapInPandas", lambda self, run, schema: made.append(run))
    make(notes)
    frame = pd.DataFrame({"path": [f"{k}.md" for k in range(20)], "text": ["# H\n\none ^a\n"] * 20})
    (got,) = made[0](iter([frame, frame]))
    assert len(got) == 40 * (2 if make is note_places else 1)
