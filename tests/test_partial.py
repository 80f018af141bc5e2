"""Every state of a selection equals the order of what has been judged by then."""

import random

from passagework.functions.spec import Criteria, QuerySpec
from passagework.operators import index, judge, score_store
from passagework.operators.answer import answer
from passagework.operators.markdown import parse_notes
from passagework.operators.partial import PartialSelection

KINDS = ["definition", "condition", "distinction", "other"]


def test_prefixes_equal_the_whole_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"p{k}", round(rng.random(), 2), rng.choice(KINDS)) for k in range(80)]
    states, seen = [], []
    make = lambda: PartialSelection(spark, f"file://{tmp_path}/p", ["id"], 0.4, "default", 9, lambda df, n, good: states.append(([r.id for r in df.orderBy("position").collect()], n, good)))
    for n in range(5):
        part = rows[n * 16 : n * 16 + 16]
        seen += part
        df = spark.createDataFrame(part, "id string, score double, contribution string")
        for _ in range(2):  # it comes again
            make().merge(df, n)
            good = sorted((r for r in seen if r[1] >= 0.4), key=lambda r: (KINDS.index(r[2]), -r[1], r[0]))
            assert states[-1] == ([r[0] for r in good[:9]], len(seen), len(good))


def test_a_run_tells_of_its_rounds(spark):
    text = "\n\n".join(f"peace {'art ' * (k % 4)}{k}" for k in range(24))
    notes = spark.createDataFrame([("n.md", text)], "path string, text string")
    passages = parse_notes(notes).cache()
    idx, store = index.prepare(passages, ["id"], "search_text"), spark.createDataFrame([], score_store.SCHEMA)
    spec, states = QuerySpec("peace art", criteria=Criteria("generic"), limit=5), []
    run = lambda told: answer(passages, idx, spec, judge.overlap_scorer, store, threshold=0.75, on_partial=told, rounds=3)
    got = run(lambda df, n, good: states.append(([r.id for r in df.orderBy("position").collect()], n, good)))
    plain = run(None)
    assert len(states) == 4 and states[0] == ([], 0, 0) and [s[1] for s in states] == sorted(s[1] for s in states)
    assert states[-1][0] == [r.id for r in got.shown.orderBy("position").collect()] == [r.id for r in plain.shown.orderBy("position").collect()] and states[-1][1:] == (24, 18)
    a, b = got.statistics.first(), plain.statistics.first()
    assert a.requests >= b.requests == 3 and (a.checked, a.passed, a.requested) == (b.checked, b.passed, b.requested)
