"""Scalar functions over passages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.constants import FENCE_PARTS, SPACE_CLASS, SPACES, STOP_WORDS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spaced(text) -> Column:
    """Lower-case runs of letters and digits with one space between, perhaps one at each end."""
    return F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}]+", " ")


def tokens(text) -> Column:
    """Lower-case runs of letters and digits without the stop words, in order."""
    return F.filter(F.split(spaced(text), " "), lambda w: ~w.isin("", *STOP_WORDS))


def fingerprint(text) -> Column:
    """White space runs as one space, trimmed; case counts."""
    return F.trim(F.regexp_replace(F.translate(_col(text), SPACES, " " * len(SPACES)), " {2,}", " "))


def inclusion_fingerprint(text) -> Column:
    """SHA-256 of a passage without the block ids that saving adds; only a text with a ``^``
    is searched for them."""
    t = F.replace(_col(text), F.lit("\r\n"), F.lit("\n"))
    bare = F.regexp_replace(t, r"(?m)[ \t]+\^[A-Za-z0-9-]+[ \t]*$", "")
    bare = F.regexp_replace(bare, r"(?m)^\^[A-Za-z0-9-]+[ \t]*$", "")
    return F.sha2(F.btrim(F.when(F.instr(t, "^") > 0, bare).otherwise(t), F.lit(SPACES)), 256)


def utf16_length(text) -> Column:
    return (F.octet_length(F.encode(_col(text), "UTF-16BE")) / 2).cast("long")


def display_text(text="text", render_text="render_text") -> Column:
    return F.coalesce(_col(render_text), _col(text))


def model_text(heading_path, text="text", render_text="render_text") -> Column:
    """The heading path in brackets, if there is one, and the displayed text."""
    path = _col(heading_path)
    head = F.when(F.size(path) > 0, F.concat(F.lit("[Headings: "), F.array_join(path, " > "), F.lit("]\n"))).otherwise("")
    return F.concat(head, display_text(text, render_text))


def cosine(a, b) -> Column:
    """The dot product of unit vectors, added up as doubles."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def span(start="line_start", end="line_end") -> Column:
    return F.greatest(F.lit(0), _col(end) - _col(start))


def links(text) -> Column:
    """Targets of wiki links with their fragments, without aliases."""
    found = F.regexp_extract_all(_col(text), F.lit(r"!?\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), 1)
    return F.transform(found, lambda x: F.trim(x))


def safe_title(title) -> Column:
    t = F.regexp_replace(_col(title), r"[\x00-\x1f\\/:*?\"<>|#\[\]^]", " ")
    t = F.trim(F.substring(F.trim(F.regexp_replace(t, f"{SPACE_CLASS}+", " ")), 1, 100))
    return F.when(t == "", "Query").otherwise(t)


def has_question_fence(text) -> Column:
    return _col(text).rlike(FENCE_PARTS)


def inert_fences(text) -> Column:
    """Opening fences of questions with the language ``text``, so that nothing runs them."""
    return F.regexp_replace(_col(text), FENCE_PARTS, "$1text$2")


def excluded(path, folders: list[str]) -> Column:
    """Whether a path is one of the folders or lies below one; blank folders exclude nothing."""
    names = [f for f in (x.strip().strip("/") for x in folders) if f]
    p, out = _col(path), F.lit(False)
    for name in names:
        out = out | (p == name) | F.startswith(p, F.lit(f"{name}/"))
    return out
