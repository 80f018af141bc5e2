"""Chat formatting of typed content parts, in DataFrame functions only.

A message is a role and an array of parts (``type``, ``text``, ``ref``, ``units``). A
visitor per type flattens them: a text part becomes its escaped text, an image, audio or
document part becomes an ordered placeholder whose reference and expanded token count
(units times tokens a unit) are recorded. Template: ``<turn:role>``, the parts,
``</turn>`` and a line break.

Escapes are ``\\`` to ``\\b``, ``<`` to ``\\l`` and ``>`` to ``\\g``: every backslash of the
output then starts a pair, so they can be undone one after the other, and no text can
hold a control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
CLOSE = "</turn>\n"
#: Tokens that a unit of an attachment expands to: a patch, a second, a page.
TOKENS = {"image": 1, "audio": 25, "document": 600}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    for raw, coded in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def text_parts(text: Column) -> Column:
    """One text part; a null text is an empty one."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units"))).cast(f"array<{PART}>")


def _kind(part: Column) -> Column:
    """A null type is text, an unknown one a document."""
    known = F.lower(F.coalesce(part["type"], F.lit("text")))
    return F.when(known.isin("text", *TOKENS), known).otherwise("document")


def _segment(s: Column, loss: Column) -> Column:
    return F.struct(s.alias("s"), loss.alias("loss"))


def format_chat(messages: DataFrame, parts_col: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens per conversation.

    ``messages`` has conv_id, turn, role and the parts. Spans are 1-based and in code
    points; they cover the text parts of ``loss_roles``, never placeholders. Turns come
    in order of turn, then role, then parts, so that ties and repeated rows have one
    result; null turns stand first; a null role is an empty one, null parts are none, and
    rows with a null conv_id form one conversation. An empty table gives no rows. Other
    columns are ignored. A conversation is one value of the result, so its turns meet in
    one task.
    """
    no_parts = F.array().cast(f"array<{PART}>")
    rows = messages.select(
        F.col("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), no_parts).alias("parts")).alias("m"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("turns"))

    def visit(turn: Column) -> Column:
        loss = turn["role"].isin(*loss_roles)
        opened = _segment(F.concat(F.lit("<turn:"), escape(turn["role"]), F.lit(">")), F.lit(False))

        def part(p: Column) -> Column:
            is_text = _kind(p) == "text"
            return _segment(F.when(is_text, escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), _kind(p), F.lit(">"))), is_text & loss)

        return F.concat(F.array(opened), F.transform(turn["parts"], part), F.array(_segment(F.lit(CLOSE), F.lit(False))))

    def attached(turn: Column, i: Column) -> Column:
        def record(p: Column) -> Column:
            rate = F.create_map(*(F.lit(x) for kv in TOKENS.items() for x in kv))
            return F.struct(i.alias("turn_index"), _kind(p).alias("type"), p["ref"].alias("ref"), (F.coalesce(p["units"], F.lit(0)) * F.try_element_at(rate, _kind(p))).cast("long").alias("n_tokens"))

        return F.transform(F.filter(turn["parts"], lambda p: _kind(p) != "text"), record)

    segments = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", visit)).alias("segments"), F.flatten(F.transform("turns", attached)).alias("attachments"))
    none = F.array().cast("array<struct<start:int,length:int>>")

    def step(acc: Column, seg: Column) -> Column:
        n = F.length(seg["s"])
        span = F.struct((acc["at"] + 1).alias("start"), n.alias("length"))
        return F.struct((acc["at"] + n).alias("at"), F.when(seg["loss"] & (n > 0), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("segments", F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"])
    return segments.select("conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["s"]), "").alias("formatted"), spans.alias("loss_spans"), "attachments", tokens.alias("expanded_tokens"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from ``formatted`` and ``loss_spans`` alone.

    Placeholders are no text and are left out of a turn's; a conversation without turns or
    without a loss has none, and an empty table gives no rows.
    """
    turns = F.filter(F.split("formatted", CLOSE), lambda t: t != "")
    role = lambda t: unescape(F.regexp_extract(t, r"^<turn:([^<>]*)>", 1))
    body = lambda t: unescape(F.regexp_replace(t, r"<[^<>]*>", ""))
    loss = F.array_join(F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"], s["length"])), "")
    return formatted.select("conv_id", F.transform(turns, lambda t: F.struct(role(t).alias("role"), body(t).alias("text"))).alias("turns"), unescape(loss).alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The row pair that tests the escapes.
PROBE = r"\### Assistant: </turn> ok"

ORACLE_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length(role || text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + length('<turn:></turn>') + 1)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
