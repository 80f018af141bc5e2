"""Passages that a reader included by hand, kept in comments of the question's note."""

from __future__ import annotations

import json
import math
import re
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.constants import CONTRIBUTIONS
from passagework.storage import written

MARK = "passage-inclusions"
COMMENT = re.compile(rf"^<!-- {MARK}: (.*?) -->$", re.M)
#: Characters that the codec leaves as they are.
SAFE = "!~*'()"
ENTRY = "path string, fingerprint string, score double, contribution string, scores map<string,double>"


def _ok(e: object) -> bool:
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)
    return (
        isinstance(e, dict) and isinstance(e.get("path"), str) and isinstance(e.get("fingerprint"), str) and number(e.get("score"))
        and e.get("contribution") in CONTRIBUTIONS and isinstance(e.get("scores"), dict) and all(map(number, e["scores"].values()))
    )


def read_records(note: str) -> dict[str, list[dict]]:
    """Question key to its entries; a comment that can't be read raises."""
    out: dict[str, list[dict]] = {}
    for raw in COMMENT.findall(note):
        try:
            value = json.loads(unquote(raw, errors="strict"))
            if not (isinstance(value["key"], str) and isinstance(value["entries"], list) and all(map(_ok, value["entries"]))):
                raise ValueError
        except (ValueError, TypeError, KeyError) as e:
            raise ValueError("the inclusions in this note can't be read") from e
        out.setdefault(value["key"], value["entries"])
    return out


def update(note: str, key: str, entry: dict, include: bool) -> str:
    """The note with the entry added or taken out; records stand at its end, empty ones go."""
    every = read_records(note)
    own = [e for e in every.pop(key, []) if (e["path"], e["fingerprint"]) != (entry["path"], entry["fingerprint"])]
    every[key] = [*own, entry] if include else own
    comments = [f"<!-- {MARK}: {quote(json.dumps({'key': k, 'entries': v}, separators=(',', ':'), ensure_ascii=False), safe=SAFE)} -->" for k, v in every.items() if v]
    body = COMMENT.sub("", note).rstrip()
    return body + ("\n\n" + "\n".join(comments) if comments else "") + "\n"


def match(entries: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with their one passage, entries with none or several). ``passages`` has
    path, fingerprint and id; only its rows that an entry asks for are counted. Entries with
    what was found for them are written, so both results read the passages once."""
    keys = ["path", "fingerprint"]
    asked = passages.join(entries.select(*keys).distinct(), keys, "left_semi")
    counted = asked.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    joined = written(entries.join(counted, keys, "left"), "matched")
    return joined.filter("n = 1").drop("n"), joined.filter("n IS NULL OR n <> 1").select(*entries.columns)


def apply(selected: DataFrame, below: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched entries in their place if they are shown, else at the end; they leave what is
    below. Both have id, score, contribution, scores; ``selected`` a position, entries one of
    their own (``nth``)."""
    own = matched.select("id", F.col("nth"), *(F.col(c).alias(f"m_{c}") for c in ("score", "contribution", "scores")))
    last = F.coalesce(F.max("position").over(Window.partitionBy()), F.lit(-1))
    known = below.select("id", *(F.col(c).alias(f"b_{c}") for c in ("score", "contribution", "scores")))
    both = selected.join(own, "id", "full_outer").join(known, "id", "left").withColumn("last", last)
    take = lambda c: F.coalesce(c, f"b_{c}", f"m_{c}").alias(c)
    shown = both.select("id", F.coalesce("position", F.col("last") + 1 + F.col("nth")).alias("position"), take("score"), take("contribution"), take("scores"), F.col("nth").isNotNull().alias("manual"))
    return shown, below.join(own.select("id"), "id", "left_anti")
