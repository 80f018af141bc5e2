"""The report and the capture of one run, and files by size and digest."""

import hashlib
import json

import pytest

from passagework.functions.spec import Criteria, QuerySpec
from passagework.operators import index, judge, report, score_store
from passagework.operators.answer import answer
from passagework.operators.markdown import parse_notes
from passagework.sources.assets import check_assets, require_assets


def test_report_and_capture(spark, tmp_path):
    notes = spark.createDataFrame([("n.md", "# H\n\npeace art\n\npeace\n\n- art\n  - peace art")], "path string, text string")
    passages = parse_notes(notes).cache()
    spec = QuerySpec("peace art", criteria=Criteria("generic"), limit=2, threshold=0.75)
    idx, store = index.prepare(passages, ["id"], "search_text"), spark.createDataFrame([], score_store.SCHEMA)
    found = answer(passages, idx, spec, judge.overlap_scorer, store)
    text = report.report(found, spec)
    assert text.startswith("# peace art\n\n3 passages of 4 after 1 overlap\n3 checked, 0 known, 0 shared, 1 request with 0 retries, 0 skipped, 2 from 0.75 on\n0 tokens read\n")
    assert "1. n.md:3-3 · 1.000\n    peace art" in text and "2. n.md:7-8 · 1.000\n    - art\n      - peace art" in text and text.endswith("1 below the threshold\n")
    path = f"{tmp_path}/capture"
    report.capture(found, spec).write.json(path)
    rows = [(r.kind, r.nth, json.loads(r.record)) for r in spark.read.json(path).collect()]
    kinds = {k: [x for x in rows if x[0] == k] for k in ("question", "statistics", "candidate", "shown", "below", "skipped")}
    assert {k: len(v) for k, v in kinds.items()} == {"question": 1, "statistics": 1, "candidate": 4, "shown": 2, "below": 1, "skipped": 0}
    assert kinds["question"][0][2]["question"] == "peace art" and kinds["statistics"][0][2]["checked"] == 3
    assert kinds["below"][0][2]["id"] == "n.md:5-5" and {n for _, n, _ in kinds["candidate"]} == {1, 2, 3, 4}
    plain = answer(passages, idx, spec, None, store)
    assert "not judged" in report.report(plain, spec, judged=False)


def test_assets(spark, tmp_path):
    data = {"a.bin": b"weights", "sub/b.json": b"{}", "c.txt": b"12345", "d.txt": b"right size"}
    for name, x in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(x)
    expected = {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in data.items()}
    require_assets(spark, str(tmp_path), expected)
    expected |= {"c.txt": (4, "0" * 64), "d.txt": (10, "0" * 64), "e.txt": (1, "0" * 64)}
    got = {r.name: r.status for r in check_assets(spark, str(tmp_path), expected).collect()}
    assert got == {"a.bin": "ok", "sub/b.json": "ok", "c.txt": "another size", "d.txt": "another digest", "e.txt": "missing"}
    with pytest.raises(ValueError, match="c.txt: another size, d.txt: another digest, e.txt: missing"):
        require_assets(spark, str(tmp_path), expected)
