"""Nested lists as intervals, and widening against brute force over a note's passages."""

import random
import time

import pytest

from passagework.operators import widening
from passagework.operators.markdown import cut_texts, outline_notes, parse_markdown, parse_notes


def widened(target, passages, n):
    """By hand: lines and text of ``target`` with its neighbours."""
    by_id = {p.id: p for p in passages}

    def outer(p):
        return outer(by_id[p.parent_id]) if p.parent_id in by_id else p

    peers = [p for p in passages if p.section_id == target.section_id]
    if target.kind == "list":
        row = [p for p in peers if p.kind == "list" and p.parent_id == target.parent_id]
    else:
        row = list({outer(p).id: outer(p) for p in peers}.values())
    row.sort(key=lambda p: p.line_start)
    at = [p.id for p in row].index(target.id)
    chosen = row[max(0, at - n) : at + n + 1]
    shown = [p.text if p.render_text is None else p.render_text for p in chosen]
    if chosen[0].kind == "list":
        shown[1:] = [p.text if p.kind == "list" and p.parent_id == chosen[0].parent_id else s for p, s in zip(chosen[1:], shown[1:])]
    return target.id, chosen[0].line_start, max(p.line_end for p in chosen), "\n\n".join(shown)


def random_note(rng):
    out = []
    for _ in range(rng.randint(1, 8)):
        kind = rng.choice(["text", "list", "list", "fence", "quote", "heading"])
        if kind == "list":
            depth = 0
            for k in range(rng.randint(1, 9)):
                out.append("  " * depth + f"- item {rng.random():.4f}")
                if rng.random() < 0.2:
                    out.append("  " * (depth + 1) + "more of it")
                depth = max(0, min(5, depth + rng.choice([-2, -1, 0, 1, 1])))
        else:
            out.append({"text": f"Some text {rng.random():.4f}", "fence": "```\n- no item\n```", "quote": "> said\n> so", "heading": "#" * rng.randint(1, 3) + f" H{rng.randint(0, 9)}"}[kind])
        out.append("")
    return "\n".join(out)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_widening_equals_brute_force(spark, n):
    rng = random.Random(n)
    notes = [(f"d/{k}.md", random_note(rng)) for k in range(25)] + [("empty.md", ""), ("none.md", None)]
    df = spark.createDataFrame(notes, "path string, text string")
    want = sorted(widened(p, ps, n) for path, text in notes for ps in [parse_markdown(path, text or "")] for p in ps)
    tell = lambda rows: sorted((r.id, r.line_start, r.line_end, r.text) for r in rows.collect())
    passages, outline = parse_notes(df).cache(), outline_notes(df).cache()
    assert tell(widening.expand(passages, passages, n)) == want
    assert tell(widening.expand(outline, outline, n, df)) == want


def test_widening_of_what_is_wanted_only(spark):
    text = "# A\none\n\ntwo\n\n- x\n  - y\n\nthree\n\n# B\nfour"
    df = spark.createDataFrame([("n.md", text), ("m.md", text)], "path string, text string")
    passages = parse_notes(df).cache()
    wanted = passages.filter("path = 'n.md' AND text = 'two'").select("path", "id")
    wanted = wanted.unionByName(wanted).unionByName(spark.createDataFrame([("n.md", "gone"), ("o.md", "o.md:1-1")], "path string, id string"))
    (got,) = widening.expand(passages, wanted, 1).collect()
    assert (got.path, got.line_start, got.line_end, got.text) == ("n.md", 2, 7, "one\n\ntwo\n\n- x\n  - y")
    assert widening.expand(passages.limit(0), wanted, 1).count() == 0


def test_outermost_without_its_parents(spark):
    rows = spark.createDataFrame([("a", "lost"), ("b", "a"), ("c", "b"), ("d", None)], "id string, parent_id string")
    assert sorted(map(tuple, widening.outermost(rows).collect())) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "d", 0)]


def test_deep_lists_need_no_more_than_their_lines(spark):
    n = 1200
    text = "\n".join("  " * k + f"- item {k}" for k in range(n))
    df = spark.createDataFrame([("deep.md", text)], "path string, text string")
    began = time.perf_counter()
    outline = outline_notes(df).cache()
    rows = {r.line_start: r for r in outline.collect()}
    assert len(rows) == n and all(r.line_end == n for r in rows.values()) and rows[7].own_after == 7
    assert sum(len(r.id) + len(r.parent_id or "") for r in rows.values()) < len(text) / 10
    outer = widening.outermost(outline).collect()
    assert {r.outer_id for r in outer} == {"deep.md:1-1200"} and max(r.depth for r in outer) == n - 1
    wanted = outline.filter("line_start = 600").select("path", "id")
    (cut,) = cut_texts(df, wanted).collect()
    lines = text.split("\n")
    assert cut.text == "\n".join(lines[599:]) and cut.render_text == text
    (wide,) = widening.expand(outline, wanted, 2, df).collect()
    assert wide.text == text
    assert time.perf_counter() - began < 60
