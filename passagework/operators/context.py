"""The context that a question's links name: notes, sections and blocks, over tables.

Links are resolved by one join on names and read by one on fragments, so any number of
questions find their contexts in one plan. What leads nowhere is a row with its status,
not an exception, and a caller decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.constants import MAX_CONTEXT_CHARS
from passagework.functions.text import utf16_length
from passagework.operators.markdown import note_places

OK, NO_NOTE, NO_PLACE, TOO_LONG = "ok", "no such note", "no such section or block", "too long"


def names(notes: DataFrame) -> DataFrame:
    """name, path, n of every name that a link can have for a note: its path or its file's
    name, with or without ``.md``. Of several notes the one in the fewest folders counts,
    then the first; ``n`` says how many there are."""
    path = F.col("path")
    base = F.substring_index(path, "/", -1)
    bare = lambda c: F.regexp_replace(c, r"\.md$", "")
    every = notes.select("path", F.explode(F.array_distinct(F.array(path, bare(path), base, bare(base)))).alias("name"))
    best = F.min(F.struct((F.size(F.split("path", "/")) - 1).alias("depth"), "path"))
    return every.groupBy("name").agg(best["path"].alias("path"), F.count("*").alias("n"))


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """source, nth, link, path, fragment, n of links (source, nth, link), by the notes
    (path): ``n`` notes have the name, none if it is 0 and the path null. A link that is only
    a fragment is to its own note. Of a source's equal targets the first link counts."""
    note = F.trim(F.substring_index("link", "#", 1))
    fragment = F.when(F.instr("link", "#") > 0, F.expr("substring(link, instr(link, '#') + 1)")).otherwise("")
    asked = links.select("source", "nth", "link", F.when(note == "", F.col("source")).otherwise(note).alias("name"), fragment.alias("fragment"))
    found = asked.join(names(notes), "name", "left").select("source", "nth", "link", "path", "fragment", F.coalesce("n", F.lit(0)).alias("n"))
    target = F.coalesce(F.concat("path", F.lit("#"), "fragment"), F.concat(F.lit("?"), "link"))
    first = found.withColumn("target", target).groupBy("source", "target").agg(F.min_by(F.struct("nth", "link", "path", "fragment", "n"), F.struct("nth", "link")).alias("row"))
    return first.select("source", "row.*")


def _lines() -> Column:
    return F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")


def locate(links: DataFrame, notes: DataFrame) -> DataFrame:
    """source, nth, link, path, fragment, line_start, line_end, status of each target, without
    its text: no link takes a note's text along."""
    found = resolve(links, notes)
    wanted = notes.join(found.select("path").distinct(), "path", "left_semi").select("path", "text")
    places = note_places(wanted).filter("fragment <> ''").unionByName(wanted.select("path", F.lit("").alias("fragment"), F.lit(1).alias("line_start"), F.size(_lines()).alias("line_end")))
    placed = found.join(places, ["path", "fragment"], "left")
    status = F.when(F.col("path").isNull(), NO_NOTE).when(F.col("line_start").isNull(), NO_PLACE).otherwise(OK)
    return placed.select("source", "nth", "link", "path", "fragment", "line_start", "line_end", status.alias("status"))


def read(links: DataFrame, notes: DataFrame) -> DataFrame:
    """source, nth, link, path, line_start, line_end, text, status of each target: a whole
    note, a section with all below it, or a block by its id; without a place no text."""
    placed = locate(links, notes).join(notes.select("path", "text"), "path", "left").withColumn("lines", _lines())
    text = F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    return placed.select("source", "nth", "link", "path", "line_start", "line_end", F.when(F.col("status") == OK, text).alias("text"), "status")


def contexts(links: DataFrame, notes: DataFrame, most: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """source, context, units, status: each source's texts in order of its links, a blank
    line between, how long that is in UTF-16 units, and the first thing that is wrong. A
    context over ``most`` units, or with a link that leads nowhere, is null."""
    rows = F.array_sort(F.collect_list(F.struct("nth", "link", "text", "status")))
    each = read(links, notes).groupBy("source").agg(rows.alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n")
    wrong = F.get(F.filter(F.transform("rows", lambda r: r["status"]), lambda s: s != OK), F.lit(0))
    units = utf16_length(text)
    status = F.coalesce(wrong, F.when(units > most, TOO_LONG).otherwise(OK))
    return each.select("source", F.when(status == OK, text).alias("context"), units.alias("units"), status.alias("status"))
