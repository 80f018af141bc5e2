"""Saving a selection: block ids in its sources, and a note that embeds them in order.

What is to be done is planned as a table first: a row for each passage, with its block id,
the edit that it takes, and what is wrong with it. Nothing is written unless every row is
right. The plan and the edited notes then become a manifest in the shared folder, so that a
run that was cut off goes on with it: each note is changed only if it still is as planned
(one that is edited already counts as done), a check then finds every id where it belongs,
and the note that embeds them comes last.
"""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.operators import context
from passagework.operators.markdown import note_places
from passagework.storage import complete_folders, create_text, read_text, replace_text

OK, NO_NOTE, NO_KIND, OVERLAP, CHANGED = "ok", "no such note", "can't be embedded", "overlaps another", "has changed"
INLINE = ("paragraph", "list")
#: Other names for a new id, should the note have one already.
TRIES = 8


class StaleSource(RuntimeError):
    """The source is no longer what the passages were taken from."""


def _lines(text: str = "source"):
    return F.split(F.col(text), "\r?\n")


def plan_block_ids(passages: DataFrame, notes: DataFrame) -> DataFrame:
    """id, path, block_id, line, op, status of passages (id, path, kind, line_start,
    line_end, text) in notes (path, text).

    ``keep``: the passage has an id already. ``append``: a new one goes behind line ``line``,
    the first of a list item and the last of a paragraph. ``insert``: it gets a line of its
    own below. A new id is made of the passage's place and text, so a plan that is made
    again is the same. A repeated passage has one row.
    """
    made = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda k: F.concat(F.lit("pw-"), F.substring(F.sha2(F.concat_ws("\n", k, "path", "line_start", "text"), 256), 1, 16)))
    digest = F.sha2(F.replace("text", F.lit("\r\n"), F.lit("\n")), 256)
    own = passages.dropDuplicates(["id"]).select("id", "path", "kind", "line_start", "line_end", digest.alias("digest"), made.alias("made"))
    before = Window.partitionBy("path").orderBy("line_start", "line_end", "id").rowsBetween(Window.unboundedPreceding, -1)
    asked = own.withColumn("reached", F.max("line_end").over(before)).groupBy("path").agg(F.collect_list(F.struct("id", "kind", "line_start", "line_end", "digest", "made", "reached")).alias("asked"))
    # A row for each note, its lines split once; a passage takes along what it needs of them.
    whole = asked.join(notes.select("path", F.col("text").alias("source")), "path", "left").withColumn("lines", _lines())
    filled = F.filter(F.transform("lines", lambda x, k: F.when(x.rlike(r"\S"), F.struct(k.alias("at"), x.alias("line")))), lambda x: x.isNotNull())
    whole = whole.withColumns({"filled": filled, "taken": F.regexp_extract_all("source", F.lit(r"\^(pw-[0-9a-f]{16})"), 1)})

    def row(x):
        start, end = x["line_start"], x["line_end"]
        there = F.array_join(F.slice("lines", start, end - start + 1), "\n")
        same = F.when((start >= 1) & (end <= F.size("lines")), F.sha2(there, 256) == x["digest"])
        inline, at = x["kind"].isin(*INLINE), F.when(x["kind"] == "list", start).otherwise(end)
        following = F.get(F.filter("filled", lambda y: y["at"] >= end), F.lit(0))["line"]
        free = F.get(F.filter(x["made"], lambda y: ~F.array_contains("taken", y)), F.lit(0))
        return x.withField("same", same).withField("inline", inline).withField("at", at).withField("own", F.get("lines", at - 1)).withField("following", F.when(x["kind"] != "list", following)).withField("free", free)

    rows = whole.select("path", F.col("source").isNull().alias("gone"), F.explode(F.transform("asked", row)).alias("row")).select("path", "gone", "row.*")
    status = (
        F.when(F.col("gone"), NO_NOTE).when(F.col("kind").isin("heading", "yaml"), NO_KIND).when(F.col("line_start") <= F.col("reached"), OVERLAP)
        .when(~F.coalesce("same", F.lit(False)), CHANGED).otherwise(OK)
    )
    good = F.col("status") == OK
    inside = F.when(F.col("inline"), F.regexp_extract("own", r"\s\^([A-Za-z0-9-]+)\s*$", 1))
    below = F.regexp_extract("following", r"^\^([A-Za-z0-9-]+)\s*$", 1)
    found = F.coalesce(F.nullif(inside, F.lit("")), F.nullif(below, F.lit("")))
    checked = rows.withColumn("status", status).withColumn("found", F.when(good, found))
    op = F.when(F.col("found").isNotNull(), "keep").when(F.col("inline"), "append").otherwise("insert")
    return checked.select("id", "path", F.when(good, F.coalesce("found", "free")).alias("block_id"), F.when(good, F.col("at")).alias("line"), F.when(good, op).alias("op"), "status")


def edited(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """path, before, after of the notes that the plan changes; line ends stay as they are."""
    edits = plan.filter("op IN ('append', 'insert')").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "op", "block_id"))).alias("edits"))
    rows = notes.select("path", F.col("text").alias("source")).join(edits, "path").withColumn("lines", _lines())

    def piece(edit, k):
        """The lines up to an edit's, with its id."""
        done = F.coalesce(F.get("edits", k - 1)["line"], F.lit(0))
        name = F.concat(F.lit("^"), edit["block_id"])
        return F.concat(F.array_join(F.slice("lines", done + 1, edit["line"] - done), "\1"), F.when(edit["op"] == "append", F.concat(F.lit(" "), name)).otherwise(F.concat(F.lit("\1\1"), name, F.lit("\1"))))

    end = F.when(F.instr("source", "\r\n") > 0, "\r\n").otherwise("\n")
    last = F.element_at("edits", -1)["line"]
    after = F.array_join(F.concat(F.transform("edits", piece), F.slice("lines", last + 1, F.size("lines") - last)), "\1")
    return rows.select("path", F.col("source").alias("before"), F.replace(after, F.lit("\1"), end).alias("after"))


def unfound(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of a plan whose id isn't in their note as it is now."""
    places = note_places(notes.join(plan.select("path").distinct(), "path", "left_semi"))
    return plan.join(places.select("path", F.expr("substring(fragment, 2)").alias("block_id")), ["path", "block_id"], "left_anti")


def note_name(title: str) -> str:
    """A title as a file's name."""
    return re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\\/:*?\"<>|#\[\]^]", " ", title)).strip()[:100].strip() or "Query"


def unique_note(spark: SparkSession, folder: str, title: str, text: str) -> str:
    """Write a note under a name that isn't taken: the title, or the title and 2, 3, ...; a
    note with the very text is the one that an earlier run has written."""
    k = 1
    while True:
        path = f"{folder.rstrip('/')}/{note_name(title)}{'' if k == 1 else f' {k}'}.md"
        if create_text(spark, path, text) or read_text(spark, path) == text:
            return path
        k += 1


def selection_note(question: str, query_path: str, embeds: list[str], when: str) -> str:
    head = re.sub(r"\r?\n", " ", question)
    return f"# {head}\n\nFrom [Saved question]({quote(query_path)}) · {when}\n\nThe sources' own passages, in the order of the answer.\n\n" + "\n\n".join(embeds) + "\n"


def save_selection(root: str, notes: DataFrame, shown: DataFrame, question: str, query_path: str, state: str, folder: str = "Saved", now: datetime | None = None) -> str:
    """Give what a reader was shown (id, path, kind, line_start, line_end, text, position)
    block ids in its sources under ``root``, and write the note that embeds it in order.
    ``notes`` (path, text) are the sources as they are. Returns the note's path; the same
    call after a crash goes on with the manifest in ``state``.
    """
    spark = shown.sparkSession
    order = [(r.id, r.path) for r in shown.orderBy("position").select("id", "path").collect()]  # what was on a reader's page
    if not order:
        raise ValueError("nothing is selected")
    key = hashlib.sha256(repr((question, query_path, order)).encode()).hexdigest()[:24]
    at = f"{state.rstrip('/')}/{key}"
    done = complete_folders(spark, at)
    if "manifest" not in done:
        plan = plan_block_ids(shown, notes)
        wrong = plan.filter(F.col("status") != OK).select("path", "status").first()
        if wrong:
            raise StaleSource(f"{wrong.path} {wrong.status}") if wrong.status in (CHANGED, NO_NOTE) else ValueError(f"a passage of {wrong.path} {wrong.status}")
        plan.write.mode("overwrite").parquet(f"{at}/plan")
        edited(notes, spark.read.parquet(f"{at}/plan")).write.mode("overwrite").parquet(f"{at}/edits")
        when = (now or datetime.now(UTC)).isoformat()
        spark.createDataFrame([(when,)], "made string").write.mode("overwrite").parquet(f"{at}/manifest")
    plan, made = spark.read.parquet(f"{at}/plan"), spark.read.parquet(f"{at}/manifest").first().made
    for r in spark.read.parquet(f"{at}/edits").toLocalIterator():  # no more notes than a reader's page has passages
        path = f"{root.rstrip('/')}/{r.path}"
        current = read_text(spark, path)
        if current == r.after:
            continue
        if current != r.before:
            raise StaleSource(f"{r.path} {CHANGED}")
        replace_text(spark, path, r.after)
    names = {r.id: r.block_id for r in plan.collect()}
    after = spark.createDataFrame([(p, read_text(spark, f"{root.rstrip('/')}/{p}")) for p in {p for _, p in order}], "path string, text string")
    if lost := unfound(after, plan).first():
        raise StaleSource(f"{lost.path} has no block {lost.block_id}")
    embeds = [f"![[{path.removesuffix('.md')}#^{names[i]}]]" for i, path in order]
    return unique_note(spark, f"{root.rstrip('/')}/{folder}", question, selection_note(question, query_path, embeds, made))


def saved_embeds(saved: DataFrame, notes: DataFrame, passages: DataFrame) -> DataFrame:
    """source, nth, link, path, line_start, line_end, id, status of what saved notes (path,
    text) embed: each embed with the passage (id, path, line_start, line_end) that stands
    there now, or a null id."""
    found = F.regexp_extract_all("text", F.lit(r"!\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), 1)
    links = saved.select(F.col("path").alias("source"), F.posexplode(found).alias("nth", "link"))
    places = context.locate(links, notes).drop("fragment")
    return places.join(passages.select("id", "path", "line_start", "line_end"), ["path", "line_start", "line_end"], "left")
