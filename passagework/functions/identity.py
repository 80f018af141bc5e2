"""What makes two scores the same: question, rubric, context and the passage's own text."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.spec import QuerySpec

KEY_VERSION = 2


def stable(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _criteria(spec: QuerySpec) -> dict:
    return {k: v for k, v in asdict(spec.criteria).items() if v is not None}


def namespace(version: str, endpoint: str, model: str, batch_size: int = 1) -> str:
    return ":".join([version, endpoint, model, *([f"batch-{batch_size}"] if batch_size > 1 else [])])


def bucket_key(spec: QuerySpec, context: str) -> str:
    return "\0".join([spec.question, json.dumps(_criteria(spec), separators=(",", ":"), ensure_ascii=False), context])


def selection_key(spec: QuerySpec) -> str:
    return json.dumps([spec.question, _criteria(spec), list(spec.context_paths)], separators=(",", ":"), ensure_ascii=False)


def old_score_hash(spec: QuerySpec, passage: dict[str, Column], space: str, context: str = "") -> Column:
    """The key that scores had before: by a passage's place (``id``, ``path``, ``line_start``,
    ``line_end``, ``headings``) beside its text. What is kept under it is read once."""
    head = {"context": context, "criteria": _criteria(spec), "namespace": space, "question": spec.question}
    fields = {"headingPath": "headings", "id": "id", "lineEnd": "line_end", "lineStart": "line_start", "path": "path", "text": "text"}
    own = F.to_json(F.struct(*(passage[c].alias(name) for name, c in fields.items())), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit('{"candidate":'), own, F.lit("," + stable(head)[1:])), 256)


def score_hash(spec: QuerySpec, model_text: Column, space: str, context: str = "") -> Column:
    """SHA-256 of the canonical JSON; only the passage's text varies by row, so the rest is
    made once. Place, limit and threshold are no part of it."""
    mark = "\0passage\0"
    head, tail = stable({"context": context, "criteria": _criteria(spec), "keyVersion": KEY_VERSION, "namespace": space, "passage": mark, "question": spec.question}).split(json.dumps(mark))
    quoted = F.regexp_extract(F.to_json(F.struct(model_text.alias("p"))), r"(?s)^\{\"p\":(.*)\}$", 1)
    return F.sha2(F.concat(F.lit(head), quoted, F.lit(tail)), 256)
