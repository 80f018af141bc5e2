"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts are made for every text. On top of them stand rules, each a condition that
rejects a text. ``order_rules`` measures on a bounded sample what each rule costs and
how many rows it rejects, and puts those first that reject most for their cost; the
cascade is one CASE, so a rule runs only for rows that none before it rejected. The
order changes what the cascade costs and which rule is named as the first, never
whether a text is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows that the order of the rules is measured on. The kept rows don't depend on it.
SAMPLE_ROWS, SAMPLE_CHARS = 1_000, 20_000


#: A word that the next one repeats.
STUTTER = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?=[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D]))"


@dataclass(frozen=True)
class Rule:
    """A named condition that rejects a text; it may use the text and the base counts."""

    name: str
    rejects: Callable[[], Column]


def _share_of(pattern: str, whole: Column, percent: int) -> Column:
    """Characters that match make up more than this share of ``whole``."""
    return 100 * F.length(F.regexp_replace("text", pattern, "")) > percent * whole


RULES = (
    Rule("symbols", lambda: F.col("n_symbols") * 10 > F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 16 * F.col("n_words"))),
    Rule("duplicate_lines", lambda: 10 * F.col("n_dup_lines") > 5 * F.col("n_lines")),
    Rule("exclamations", lambda: 10 * F.expr("length(text) - length(replace(text, '!', ''))") > 3 * F.col("n_words")),
    Rule("shouting", lambda: _share_of("[^A-ZÀ-ÖØ-Þ]", F.col("word_chars"), 40)),
    Rule("few_letters", lambda: 100 * F.length(F.regexp_replace("text", r"[^\p{L}]", "")) < 40 * F.col("word_chars")),
    Rule("stutter", lambda: 100 * F.regexp_count("text", F.lit(STUTTER)) > 30 * F.col("n_words")),
    Rule("bullets", lambda: 100 * F.regexp_count("text", F.lit(r"(?m)^[ \t]*[-*•]")) > 90 * F.col("n_lines")),
    Rule("ellipses", lambda: 100 * F.regexp_count("text", F.lit(r"(?m)(?:\.\.\.|…)[ \t]*$")) > 30 * F.col("n_lines")),
)


def _held(value: Column) -> Column:
    """The same value, as one that the optimiser may not compute again elsewhere: it would
    move a filter on the verdict below the counts, and split a text for each of its words."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: each such window covers its own
    ``WINDOW`` words less those that the one before it covers."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(by_hash: Column) -> Column:
        near = lambda i, d: F.get(by_hash, i + d)["h"]
        found = F.filter(by_hash, lambda x, i: F.coalesce(x["h"] == near(i, -1), F.lit(False)) | F.coalesce(x["h"] == near(i, 1), F.lit(False)))
        return F.aggregate(
            F.array_sort(F.transform(found, lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    return _let(pairs, twice)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, text, the counts and ``base_failed`` of every row, with ``carry`` also its ``row``."""
    row = ["row"] if carry else []
    trimmed = F.btrim("text", F.lit(SPACE))
    df = id_text(docs, id_col, text_col, carry).withColumn("words", _held(F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))))
    df = df.withColumn("n_words", F.size("words"))
    # Single items, as slice() would copy the whole array for each window.
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(WINDOW))))
    repeated = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated(h)).otherwise(0))
    without = "text"
    for c in SYMBOLS:
        without = f"replace({without}, '{c}', '')"
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    df = df.select(
        "doc_id", "text", F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.expr(f"length(text) - length({without})").cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _held(F.when(F.col("n_words") > WINDOW, repeated).otherwise(0).cast("long")).alias("n_repeat_words"), *row,
    )
    return df.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").alias("n_lines"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"), *row,
    )


def cascade(rejects: list[list[bool]], costs: list[float]) -> list[int]:
    """The order of rules by rejection per cost, each among the rows that those before it
    leave: ``rejects`` has a row for each document with what every rule says of it. Ties go
    to the rule that comes first."""
    left, order = [row for row in rejects if any(row)], []
    rest = list(range(len(costs)))
    while rest:
        best = max(rest, key=lambda k: (sum(row[k] for row in left) / costs[k], -k))
        order.append(best)
        rest.remove(best)
        left = [row for row in left if not row[best]]
    return order


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of ``cascade``, both sides measured on at most ``sample_rows``
    rows with texts of at most ``SAMPLE_CHARS``: what all rules say in one pass, and each
    rule's seconds. They are taken from the first partitions that have them, so that
    measuring reads no more of a large table than of a small one."""
    rows = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS).take(sample_rows)
    sample = base_counts(docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(1)).persist()
    try:
        tried = sample.filter(~F.col("base_failed"))
        said = tried.select(F.array(*(F.coalesce(rule.rejects(), F.lit(False)) for rule in rules)).alias("x")).collect() if rules else []

        def seconds(condition: Column) -> float:
            """Of the second run, when the query is compiled."""
            for _ in range(2):
                began = time.perf_counter()
                tried.agg(F.count_if(condition)).first()
            return time.perf_counter() - began

        idle = seconds(F.lit(False))
        costs = [max(1e-3, seconds(rule.rejects()) - idle) for rule in rules]
    finally:
        sample.unpersist()
    return [rules[k] for k in cascade([r.x for r in said], costs)]


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, carry: bool = False) -> DataFrame:
    """The base counts and ``kept``, with ``carry`` also the whole ``row``. A row is kept if
    neither the base rule nor another rejects it; the first that does ends the cascade.

    A null or empty text has no words and fails the base rule; a null id stays null;
    repeated rows are judged one by one; an empty table gives no rows; other columns
    are ignored.
    """
    counts = base_counts(docs, id_col, text_col, carry)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in order_rules(id_text(docs, id_col, text_col), rules, sample_rows):
        verdict = verdict.when(rule.rejects(), F.lit(False))
    return counts.withColumn("kept", verdict.otherwise(F.lit(True))).drop("text")


#: The same over DuckDB's views, for the rules above.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
pos AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d),
run AS (SELECT doc_id, i, w = lead(w) OVER o AS again, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS five
        FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
stu AS (SELECT doc_id, count(*) AS n FROM run WHERE again GROUP BY doc_id),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM run WHERE five IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS w FROM win WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, t, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, coalesce(stu.n, 0) AS n_stutter
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN stu ON stu.doc_id = d.doc_id),
v AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 10 * n_dup_lines > 5 * n_lines
            OR 10 * (length(t) - length(replace(t, '!', ''))) > 3 * n_words
            OR 100 * length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) > 40 * word_chars
            OR 100 * length(regexp_replace(t, '[^\p{L}]', '', 'g')) < 40 * word_chars
            OR 100 * n_stutter > 30 * n_words
            OR 100 * len(regexp_extract_all(t, '(?m)^[ \t]*[-*•]')) > 90 * n_lines
            OR 100 * len(regexp_extract_all(t, '(?m)(?:\.\.\.|…)[ \t]*$')) > 30 * n_lines) AS kept
FROM v
"""
