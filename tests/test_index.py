"""What a prepared index writes: each word of a passage once, and nothing else of it beside."""

import re

from pyspark.sql import functions as F

from passagework.constants import SPACE_CLASS, SPACES
from passagework.functions import text as T
from passagework.operators import inclusions, index, ranking
from passagework.operators.index import prepare


def test_postings_hold_words_once_and_no_fingerprint(spark):
    rows = [(1, "be red Red blue, red"), (2, ""), (3, None), (4, "blue"), (5, "green " * 300)]
    made = prepare(spark.createDataFrame(rows, "id int, text string"), ["id"])
    assert made.postings.columns == ["term", "id", "len", "tf"]
    assert sorted(map(tuple, made.postings.collect())) == [("blue", 1, 4, 1), ("blue", 4, 1, 1), ("green", 5, 300, 300), ("red", 1, 4, 3)]
    assert (made.n, made.total) == (5, 305)


def test_postings_stay_in_their_tasks_and_each_file_is_sorted(spark, tmp_path):
    rows = spark.range(40).repartition(4).select("id", F.explode(F.array(*map(F.lit, ("peace", "art", "work")))).alias("term"))
    done, terms = index.write_postings(rows, str(tmp_path))
    files = done.select("term", F.input_file_name().alias("file")).groupBy("file").agg(F.collect_list("term").alias("all"), F.collect_set("term").alias("own")).collect()
    assert len(files) == 4 and all(r["all"] == sorted(r["all"]) and len(r.own) == 3 for r in files)
    assert sorted(map(tuple, terms.collect())) == [("art", 40), ("peace", 40), ("work", 40)]


def test_words_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(index, "CHUNK", 2)
    rows = [(k, text) for k, text in enumerate(["b a b", None, "", "the of", "İx c ÉA", "d e f g", "a\x85z"])]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    parts = list(index._counted(df.select("id", F.lit(b"f").alias("fp"), T.spaced("text").alias("w")).toArrow().to_batches()))
    got = {r["id"]: (r["len"], {x["term"]: x["tf"] for x in r["runs"]}) for p in parts for r in p.to_pylist()}
    want = {r.id: [*r.w] for r in df.select("id", F.coalesce(T.tokens("text"), F.array().cast("array<string>")).alias("w")).collect()}
    assert len(parts) > 1 and got == {k: (len(w), {x: w.count(x) for x in w}) for k, w in want.items()}


def test_copies_keep_their_fingerprints(spark):
    rows = [(k, "red  fox" if k % 2 else "red fox") for k in range(6)] + [(9, "a red hen")]
    made = prepare(spark.createDataFrame(rows, "id int, text string"), ["id"])
    asked = ranking.question_terms(spark.createDataFrame([(0, "red fox")], "qid long, question string"))
    got = ranking.lexical(made, asked, 10).orderBy("rank").collect()
    assert [(r.id, r.is_copy) for r in got] == [(0, False), (9, False), *((k, True) for k in range(1, 6))]
    assert len({bytes(r.fp) for r in got}) == 2


def test_white_space_of_fingerprints(spark):
    assert all(re.match(SPACE_CLASS, c) for c in SPACES) and len(set(SPACES)) == 25
    texts = [f"{c}{c}a{c}b {c} c{c}" for c in SPACES] + ["\x85 x \x85", "", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old = F.trim(F.regexp_replace("text", f"{SPACE_CLASS}+", " "))
    assert df.select(T.fingerprint("text").alias("new"), old.alias("old")).filter("new <> old").count() == 0


def test_inclusion_fingerprints_as_before(spark):
    texts = ["a ^b1", "a\n^b1\nc", "  a^b ", "a \x85", "x\r\ny ^z-1 \r\n", "^only", "  q 　\n", "a ^b c ^d  ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t]+\^[A-Za-z0-9-]+[ \t]*$", ""), r"(?m)^\^[A-Za-z0-9-]+[ \t]*$", "")
    old = F.sha2(F.regexp_replace(t, rf"\A{SPACE_CLASS}+|{SPACE_CLASS}+\z", ""), 256)
    assert df.select(T.inclusion_fingerprint("text").alias("new"), old.alias("old")).filter("new <> old").count() == 0


def test_matching_inclusions_reads_the_passages_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(k, "p", f"f{k // 2 if k < 4 else k}") for k in range(8)], "id long, path string, fingerprint string")
    entries = spark.createDataFrame([("p", "f0"), ("p", "f5"), ("p", "no")], "path string, fingerprint string")
    matched, missing = inclusions.match(entries, rows.mapInArrow(count, rows.schema))
    assert [r.id for r in matched.unionByName(missing.withColumn("id", F.lit(None).cast("long"))).collect() if r.id is not None] == [5]
    assert seen.value == 8
