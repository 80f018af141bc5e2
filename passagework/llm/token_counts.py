"""Token counts by a map-side two-tier lookup.

A text's token count is the sum of its pre-tokens' counts, as merges never cross
a pre-token. Three ways to a length, in this order:

1. a broadcast table of the corpus' frequent pre-tokens. It is packed as one
   bytes object of joined strings and one of lengths, ``TABLE_SIZE`` entries at
   most, and unpacked once in each worker process;
2. the worker's own cache of what it has met, emptied when it holds
   ``CACHE_SIZE`` entries;
3. the tokenizer, in batches of the pre-tokens that neither has.

Pre-tokens are never shuffled. The frequent ones come from summaries of at most
``SUMMARY_SIZE`` entries, one for each task: every ``STRIDE``-th word of every
text of its rows, so that this costs little. Spark adds the summaries up. The
table only saves time and can't change a count.

Texts with characters outside the blocks in ``PLAIN``, or with a string of an
added token, go to the tokenizer whole, as its splitting is the reference there.
"""

from __future__ import annotations

import functools
import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, sliced

TABLE_SIZE = 65_536
SUMMARY_SIZE = 4_096
CACHE_SIZE = 400_000
LONGEST_CACHED = 48
STRIDE = 8
#: Letters of the blocks that are split here: Latin, Greek and Cyrillic.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁҊ-ԯ"
#: With them ASCII without its four separators, and punctuation.
PLAIN = f"\\x00-\\x1b\\x20-\\x7e¡-©«-±´¶-¸»¿×÷{LETTERS}‐-‧€"
#: The public pattern of byte-level BPE with these letters. A run that starts with a
#: letter or digit can't be a contraction, so those alternatives may come first.
SPLIT = rf" ?[{LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def _tools(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core already
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    plain = re.compile(f"[{PLAIN}]*").fullmatch

    def odd(text: str) -> bool:
        return not plain(text) or any(a in text for a in added)

    return tok, odd, re.compile(SPLIT).findall


def _summaries(size: int):
    def run(batches):
        seen: Counter = Counter()
        for batch in sliced(batches, 0):
            for text in batch.column(0).to_pylist():
                seen.update(text.split(" ")[1::STRIDE])
                if len(seen) > 50 * size:
                    seen = Counter(dict(seen.most_common(10 * size)))
        top = [(f" {w}", n) for w, n in seen.most_common(size) if len(w) < LONGEST_CACHED]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    return run


def frequent_lengths(docs: DataFrame, path: str, size: int = TABLE_SIZE, summary: int = SUMMARY_SIZE) -> tuple[bytes, bytes]:
    """The packed table: frequent pre-tokens joined by NUL NUL, and a byte each for their lengths."""
    top = (
        docs.select("text").mapInArrow(_summaries(summary), "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    )
    tok, odd, split = _tools(path)
    words = [r.piece for r in top.select("piece").collect() if not odd(r.piece) and split(r.piece) == [r.piece] and "\0" not in r.piece]
    lengths = [len(e) for e in tok.encode_batch_fast(words, add_special_tokens=False)] if words else []
    kept = [(w, n) for w, n in zip(words, lengths, strict=True) if n < 256]
    return "\0\0".join(w for w, _ in kept).encode(), bytes(n for _, n in kept)


class _Lengths(dict):
    """Pre-token lengths: the broadcast tier stays, what comes on top of it is bounded."""

    def __init__(self, tok, packed: tuple[bytes, bytes]):
        words = packed[0].decode().split("\0\0") if packed[1] else []
        super().__init__(zip(words, packed[1], strict=True))
        self.tok, self.tier1 = tok, dict(self)

    def learn(self, pieces: list[str]) -> None:
        if len(self) > CACHE_SIZE + len(self.tier1):
            self.clear()
            self.update(self.tier1)
        new = [p for p in pieces if len(p) <= LONGEST_CACHED]
        self.update(zip(new, (len(e) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))

    def __missing__(self, piece: str) -> int:  # only what is too long to keep, or was dropped meanwhile
        return len(self.tok.encode(piece, add_special_tokens=False).ids)


_tiers: dict = {}


def _tier(path: str, packed) -> _Lengths:
    key = (path, packed.id if hasattr(packed, "id") else id(packed))
    if key not in _tiers:
        _tiers.clear()
        _tiers[key] = _Lengths(_tools(path)[0], packed.value)
    return _tiers[key]


def _counts(path: str, packed):
    def run(batches):
        tok, odd, split = _tools(path)
        lengths = _tier(path, packed)
        for batch in sliced(batches):
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                n_bytes.append(len(text.encode()))
                if odd(text):
                    n_tokens.append(len(tok.encode(text, add_special_tokens=False).ids))
                    continue
                pieces = split(text)
                if new := [p for p in set(pieces) if p not in lengths]:
                    lengths.learn(new)
                n_tokens.append(sum(map(lengths.__getitem__, pieces)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated
    rows each get their own row; an empty table gives no rows; other columns are
    ignored. ``tokenizer`` is the path of a byte-level BPE file of tokenizers that
    splits by the public pattern.
    """
    df = id_text(docs, id_col, text_col)
    packed = docs.sparkSession.sparkContext.broadcast(frequent_lengths(df, tokenizer, table_size))
    out = df.mapInArrow(_counts(tokenizer, packed), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
