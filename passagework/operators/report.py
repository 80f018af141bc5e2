"""What a run was and gave: a text report, and a capture of all that it looked at."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.constants import MAX_CONTEXT_CHARS
from passagework.functions.identity import stable
from passagework.functions.spec import QuerySpec
from passagework.operators.answer import Answer


def _count(c: str, one: str, many: str | None = None) -> Column:
    """A number with its noun."""
    return F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def statistics_lines(statistics: DataFrame, judged: bool = True) -> DataFrame:
    """nth, line: what a run's one row of statistics says, in words."""
    found = F.concat(
        _count("shortlisted", "passage"), F.lit(" of "), F.col("searchable").cast("string"), F.lit(" after "), _count("overlap_removed", "overlap"),
        F.when(F.col("truncated"), F.concat(F.lit(" at the limit of "), F.col("window_limit").cast("string"), F.lit(", there were more"))).otherwise(""),
    )
    scored = F.concat_ws(
        ", ", _count("checked", "checked", "checked"), _count("cached", "known", "known"), _count("shared", "shared", "shared"), F.concat(_count("requests", "request"), F.lit(" with "), _count("retries", "retry", "retries")),
        _count("skipped", "skipped", "skipped"), F.concat(F.col("passed").cast("string"), F.lit(" from "), F.col("threshold").cast("string"), F.lit(" on")),
    )
    cost = F.when(F.col("requests") > 0, F.concat(_count("input_tokens", "token"), F.lit(" read")))
    context = F.when(F.col("context_chars") > 0, F.concat(F.lit("context: "), F.col("context_chars").cast("string"), F.lit(f" of {MAX_CONTEXT_CHARS} characters")))
    lines = F.filter(F.array(found, scored if judged else F.lit("not judged: in the order of retrieval"), cost, context), lambda x: x.isNotNull())
    return statistics.select(F.posexplode(lines).alias("nth", "line"))


def passage_lines(shown: DataFrame) -> DataFrame:
    """position, line of what is shown: where it is, its score, its text set in by four."""
    at = F.concat("path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    head = F.concat((F.col("position") + 1).cast("string"), F.lit(". "), at, F.lit(" · "), F.format_string("%.3f", F.col("score")), F.when(F.col("manual"), " · by hand").otherwise(F.when(F.col("contribution") == "other", "").otherwise(F.concat(F.lit(" · "), "contribution"))))
    return shown.select("position", F.concat(head, F.lit("\n    "), F.replace("text", F.lit("\n"), F.lit("\n    "))).alias("line"))


def report(found: Answer, spec: QuerySpec, judged: bool = True) -> str:
    """The report of one answer: a reader's page."""
    rows = [r.line for r in statistics_lines(found.statistics, judged).orderBy("nth").collect()]
    shown = [r.line for r in passage_lines(found.shown).orderBy("position").collect()]
    rest = found.below.count()
    return "\n".join([f"# {spec.question}", "", *rows, "", *(shown or ["nothing passed"]), *([f"\n{rest} below the threshold"] if rest else [])]) + "\n"


def capture(found: Answer, spec: QuerySpec) -> DataFrame:
    """kind, nth, record: everything of one run as JSON texts, to be written as lines. The
    question and the statistics, each candidate with its rank and scores of retrieval, each
    passage that is shown, below the threshold, skipped, or an inclusion without a passage."""
    spark = found.shown.sparkSession
    question = spark.createDataFrame([("question", 0, stable(asdict(spec)))], "kind string, nth long, record string")

    def rows(kind: str, df: DataFrame, columns: list[str], order: str) -> DataFrame:
        present = [c for c in columns if c in df.columns]
        return df.select(F.lit(kind).alias("kind"), F.col(order).cast("long").alias("nth"), F.to_json(F.struct(*present)).alias("record"))

    parts = [
        rows("statistics", found.statistics.withColumn("zero", F.lit(0)), [c for c in found.statistics.columns if c != "request_ms"], "zero"),
        rows("candidate", found.candidates, ["id", "path", "line_start", "line_end", "lexical_score", "semantic_score", "retrieval_score", "is_copy", "hash", "text"], "rank"),
        rows("shown", found.shown, ["id", "path", "line_start", "line_end", "score", "contribution", "scores", "manual", "text"], "position"),
        rows("below", found.below, ["id", "score", "contribution", "scores"], "rank"),
        rows("skipped", found.skipped, ["id", "path", "line_start", "line_end"], "rank"),
    ]
    if found.missing is not None:
        parts.append(rows("missing", found.missing, ["path", "fingerprint", "score"], "nth"))
    for part in parts:
        question = question.unionByName(part)
    return question
