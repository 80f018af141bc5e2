import pytest

from passagework.functions.identity import bucket_key, namespace, selection_key, stable
from passagework.functions.spec import PRESETS, Criteria, QuerySpec, Settings, SpecError, parse_query, query_markdown, scalar
from passagework.operators import inclusions


def test_question_sources():
    assert parse_query("a/What is x.md", "text").question == "What is x"
    assert parse_query("q.md", "```pq\nall of\nthis\n```").question == "all of\nthis"
    spec = parse_query("q.md", "---\nquestion: old\nlimit: 3\n---\n```pq\nquestion: new\ncontext: [[N#^a|x]] [[M]]\n```")
    assert (spec.question, spec.limit, spec.context_paths) == ("new", 3, ("N#^a", "M"))
    assert parse_query("q.md", "---\r\nlimit: 3\r\n---\r\n") == parse_query("q.md", "---\nlimit: 3\n---\n")


@pytest.mark.parametrize("text", ["---\na: 1", "```pq\nquestion: a\nnope: b\n```", "```pq\nquestion: a\nloose\n```", "```pq\nlimit: 0\n```", "```pq\nlimit: 1.5\n```", "```pq\nquestion: true\n```", "```pq\nmode: odd\n```"])
def test_bad_questions(text):
    with pytest.raises(SpecError):
        parse_query("q.md", text)


def test_modes():
    mode = lambda t: parse_query("q.md", f"```pq\n{t}\n```").criteria.mode
    assert mode("question: what is it") == "default"
    assert mode("question: what is it\ntrue: yes it is") == "generic"
    assert mode("question: why") == "generic"
    assert mode("question: why\nmode: definition") == "default"


def test_scalars():
    assert [scalar(x) for x in ("true", " -2.5 ", "[[a]]", "[a, 'b', ]", "'q'")] == [True, -2.5, "[[a]]", ["a", "b"], "q"]


@pytest.mark.parametrize("preset", PRESETS)
def test_builder_round_trip(preset):
    spec = parse_query("q.md", query_markdown("why `now`\n```x", preset))
    assert spec.question == "why 'now' '''x" and spec.limit == 6 and spec.threshold == 0.5 and spec.criteria.mode == "generic"


def test_settings():
    s = Settings.from_dict({"threshold": 7, "candidate_limit": 5000.5, "result_limit": 0, "model": "../x", "other": 1})
    assert (s.threshold, s.candidate_limit, s.result_limit, s.model) == (1.0, 1000, 1, Settings().model)


def test_identity():
    a, b = QuerySpec("q", criteria=Criteria("generic", "i"), limit=1), QuerySpec("q", criteria=Criteria("generic", "i"), limit=9)
    assert selection_key(a) == selection_key(b) and bucket_key(a, "c") == bucket_key(b, "c")
    assert stable({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    assert namespace("v", "e", "m") != namespace("v", "e", "m", 10)


def test_inclusion_codec():
    entry = {"path": "a.md", "fingerprint": "f", "score": 0.5, "contribution": "other", "scores": {"relevant": 0.5}}
    note = inclusions.update("# q\n", "k", entry, True)
    assert inclusions.read_records(note) == {"k": [entry]}
    assert inclusions.update(note, "k", entry, True) == note
    assert inclusions.update(note, "k", entry, False) == "# q\n"
    assert "--" not in note.split("inclusions: ")[1].split(" -->")[0]
    with pytest.raises(ValueError):
        inclusions.read_records("<!-- passage-inclusions: %7B%22 -->")
