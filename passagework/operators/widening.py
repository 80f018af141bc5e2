"""Widening passages to their neighbours within a section, on tables.

A list item's neighbours are its siblings. Another passage's neighbours are the section's
outermost units, a nested item standing for the item that it is in at last. Outermost
units are found by pointer jumping, so a list of depth d takes log2(d) joins; neighbours by
places and a join, so neither a note nor a flat list of any length has to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import display_text
from passagework.operators.markdown import cut_texts
from passagework.operators.numbering import numbered
from passagework.storage import written


def outermost(passages: DataFrame) -> DataFrame:
    """id, outer_id, depth of every passage (id, parent_id): the last of its ancestors that
    the table has, itself without one, and how many it has. Each round doubles how far every
    row looks, until none moves."""
    nodes = passages.select("id", "parent_id")
    above = nodes.join(nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("there")), "parent_id", "left")
    start = above.select("id", F.when(F.col("there"), F.col("parent_id")).otherwise(F.col("id")).alias("outer_id"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"))
    current, moving = written(start, "outer"), True
    while moving:
        up = current.select(F.col("id").alias("outer_id"), F.col("outer_id").alias("next"), F.col("depth").alias("more"))
        inner = current.filter("depth > 0").join(up, "outer_id")
        moved = inner.select("id", F.col("next").alias("outer_id"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved"))
        step = written(moved, "outer-step")
        moving = not step.filter("moved").isEmpty()
        if moving:
            current = written(current.filter("depth = 0").unionByName(step.drop("moved")), "outer")
    return current


def around(passages: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """target, id, path, line_start, line_end, kind, parent_id: each wanted passage (path,
    id) with up to ``n`` neighbours on each side. ``passages`` (id, path, line_start,
    line_end, kind, parent_id, section_id) needs no texts; only the notes of what is wanted
    are looked at. Wanted ids that there aren't give no row."""
    fields = ["id", "path", "line_start", "line_end", "kind", "parent_id"]
    asked = wanted.select("path", "id").distinct()
    near = written(passages.select(*fields, "section_id").join(asked.select("path").distinct(), "path", "left_semi").select(*fields, "section_id"), "near")
    own = near.join(asked, ["path", "id"], "left_semi")
    itself = own.select(F.col("id").alias("target"), *fields)
    if n <= 0:
        return itself
    level = F.coalesce("parent_id", F.lit(""))
    group = ["path", "section_id"]
    items = near.filter("kind = 'list'").withColumn("level", level)
    placed = written(numbered(items, [*group, "level"], ["line_start", "id"], "nth"), "siblings")
    units = near.join(outermost(near).select("id", "outer_id"), "id").select(F.col("outer_id").alias("id"), *group).distinct()
    outer = units.join(near.select(*fields), ["id", "path"])
    ranked = written(numbered(outer, group, ["line_start", "id"], "nth"), "units")
    reach = F.explode(F.sequence(F.col("nth") - n, F.col("nth") + n)).alias("nth")

    def beside(targets: DataFrame, among: DataFrame, keys: list[str]) -> DataFrame:
        at = among.join(targets.select("id"), "id", "left_semi").select(F.col("id").alias("target"), *keys, reach)
        return at.join(among, [*keys, "nth"]).filter("id <> target").select("target", *fields)

    lists = beside(own.filter("kind = 'list'"), placed, [*group, "level"])
    others = beside(own.filter("kind <> 'list'"), ranked, group)
    return itself.unionByName(lists).unionByName(others)


def expand(passages: DataFrame, wanted: DataFrame, n: int, notes: DataFrame | None = None) -> DataFrame:
    """id, path, line_start, line_end, text of the wanted passages (path, id), widened by up
    to ``n`` neighbours on each side: from the first line to the last of all, their displayed
    texts in order with a blank line between. Siblings of a first list item show only
    themselves, as the items that they are in stand above the first already.

    With ``notes`` (path, text), ``passages`` is an outline, and just the texts that are
    shown are cut from the notes; otherwise they are the passages' own.
    """
    chosen = written(around(passages, wanted, n), "around")
    texts = passages if notes is None else cut_texts(notes, chosen)
    rows = chosen.join(texts.select("id", "text", display_text().alias("display")), "id")
    grouped = rows.groupBy("target").agg(
        F.array_sort(F.collect_list(F.struct("line_start", "line_end", "id", "kind", "parent_id", "text", "display"))).alias("rows"), F.first("path").alias("path"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end")
    )
    first = F.col("rows")[0]
    same = lambda x: (x["kind"] == "list") & (first["kind"] == "list") & x["parent_id"].eqNullSafe(first["parent_id"])
    pieces = F.transform("rows", lambda x, k: F.when((k > 0) & same(x), x["text"]).otherwise(x["display"]))
    return grouped.select(F.col("target").alias("id"), "path", "line_start", "line_end", F.array_join(pieces, "\n\n").alias("text"))
