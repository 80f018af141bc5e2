"""SentencePiece BPE models as a weighted finite-state transducer.

The normaliser (a prefix space, spaces to U+2581), the pieces and the byte fallback are
compiled to arcs: a trie over pieces, and for each character outside it one arc that
emits its bytes' ids. A state is a place in the input and the piece that ended there. An
arc from it exists only if the two pieces may stand side by side, that is if merging
their joint text alone parts it into just these two; by the local consistency of BPE
merges, the only path left through a text is then the one that merging the whole would
give. Each arc weighs 1, and the path is the shortest in the tropical semiring.

No piece has U+2581 behind another character, so a text falls into segments that begin
with it; these fall into parts where two characters meet that are neighbours in no
piece. What a worker has composed it keeps, segments and parts. Model type and normaliser
are read from the model's file; others than BPE with the identity are refused.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, sliced

SPACE = "▁"
#: Entries of each of a cache's two generations, about 200 bytes each.
CACHE_SIZE = 250_000
LONGEST_CACHED = 48


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        self.prefix = _checked(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space inside; texts can't be cut at spaces")
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.rank = {p: -s for p, s in self.scores.items()}
        self.parts: dict[str, list[str]] = {}
        self.trie: dict = {}
        for p in self.ids:
            if len(p) == 1 or self.merge(p, self.parts) == [p]:  # other pieces are on no path
                node = self.trie
                for c in p:
                    node = node.setdefault(c, {})
                node[""] = p
        self.fits: dict[tuple[str, str], bool] = {}
        self.pairs = {pair for p in self.ids for pair in zip(p, p[1:])}
        self.parts_cache = _Cache(self._part)
        self.cache = _Cache(self.compose, SPACE)

    def merge(self, text: str, last: dict | None = None) -> list[str]:
        """BPE of a short text: the best pair first, the leftmost of equal ones. ``last``
        gets what the last merge joined, by its result."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.scores]
            if not found:
                break
            k = min(found)[1]
            if last is not None:
                last[parts[k] + parts[k + 1]] = parts[k : k + 2]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def beside(self, left: str, right: str) -> bool:
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) > 500_000:
                self.fits.clear()
            runs = SPACE * 2 in left or SPACE * 2 in right  # their scores are equal, so ranks don't tell
            self.fits[key] = self.merge(left + right) == [left, right] if runs else self._apart(left, right)
        return self.fits[key]

    def _apart(self, left: str, right: str) -> bool:
        """Whether no merge across the border comes before those within: the latest merge
        at the border is undone again and again, and what then meets there must not merge
        sooner. Of equal merges the left one comes first."""
        sooner = float("inf")
        while True:
            across = self.rank.get(left + right)
            if across is not None and across < sooner:
                return False
            a = self.rank[left] if len(left) > 1 else -1
            b = self.rank[right] if len(right) > 1 else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                sooner, left = a, self.parts[left][1]
            else:
                sooner, right = b + 0.5, self.parts[right][0]

    def path(self, segment: str) -> list[str]:
        """The shortest path's pieces; a character that no piece has stands for its bytes.

        Long arcs are tried first, and states that lead nowhere aren't entered again. All
        arcs weigh 1 and compatible pieces leave one complete path, so it is the shortest.
        """
        n, fits, ids, trie = len(segment), self.fits, self.ids, self.trie
        dead: set[tuple[int, str]] = set()
        out: list[str] = []
        at, last = 0, ""
        arcs: list[list[str]] = []
        while at < n:
            node, k, here = trie, at, []
            while k < n and (node := node.get(segment[k])) is not None:
                k += 1
                if "" in node:
                    here.append(node[""])
            if not here and segment[at] not in ids:
                here.append(segment[at])
            arcs.append(here)
            while True:
                if not arcs[-1]:
                    dead.add((at, last))
                    arcs.pop()
                    if not out:
                        raise ValueError(f"no path through {segment!r}")
                    at -= len(out.pop())
                    last = out[-1] if out else ""
                    continue
                p = arcs[-1].pop()
                if last and not (fits[last, p] if (last, p) in fits else self.beside(last, p)):
                    continue
                if dead and (at + len(p), p) in dead:
                    continue
                out.append(p)
                at, last = at + len(p), p
                break
        return out

    def _part(self, part: str) -> bytes:
        ids: list[int] = []
        for p in self.path(part):
            ids += [self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()]
        return np.array(ids, "<u4").tobytes()

    def compose(self, segment: str) -> bytes:
        """The ids of one segment, which is cut where no piece has two neighbours side by side."""
        pairs, cache, at, out = self.pairs, self.parts_cache, 0, []
        if pairs.issuperset(zip(segment, segment[1:])):
            return cache[segment]
        for k in (*(k for k, pair in enumerate(zip(segment, segment[1:]), 1) if pair not in pairs), len(segment)):
            out.append(cache[segment[at:k]])
            at = k
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        words = text.replace(SPACE, " ").split(" ")
        if not self.prefix:
            return np.frombuffer(self.compose(words[0]) + b"".join(map(self.cache.__getitem__, _runs(words[1:]))), "<u4")
        return np.frombuffer(b"".join(map(self.cache.__getitem__, _runs(words))), "<u4")

    def decode(self, ids) -> str:
        data = b"".join(map(self.raw.__getitem__, ids))
        return (data[1:] if self.prefix and data[:1] == b" " else data).decode("utf-8", "replace")


class _Cache(dict):
    """The ids of what was composed. When ``CACHE_SIZE`` entries are there, they become the
    old ones, and those old before are forgotten unless they were asked for since."""

    def __init__(self, compose, prefix: str = ""):
        self.compose, self.prefix, self.old = compose, prefix, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word) or self.compose(self.prefix + word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHE_SIZE:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


def _runs(words: list[str]) -> list[str]:
    """Segments without their first space: an empty word is a space of the next segment."""
    if "" not in words:
        return words
    out, spaces = [], 0
    for word in words:
        if word:
            out.append(SPACE * spaces + word if spaces else word)
            spaces = 0
        else:
            spaces += 1
    return [*out, SPACE * (spaces - 1)] if spaces else out


def _fields(data: bytes) -> dict[int, list]:
    """A protocol buffer message's fields by number: integers, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        out.setdefault(key >> 3, []).append(value)
    return out


def _checked(path: str) -> bool:
    """Whether the model puts a space before a text. Raises on what isn't compiled here."""
    with open(path, "rb") as f:
        model = _fields(f.read())
    trainer, normaliser = (_fields(b"".join(model.get(k, []))) for k in (2, 3))
    if trainer.get(3, [1])[-1] != 2:
        raise ValueError("only BPE models are compiled")
    if any(normaliser.get(2, [])) or normaliser.get(4, [1])[-1] or not normaliser.get(5, [1])[-1]:
        raise ValueError("only the identity as a normaliser, with spaces kept and escaped, is compiled")
    return bool(normaliser.get(3, [1])[-1])


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _encode(path: str):
    def run(batches):
        t = transducer(path)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.encode(x).astype(np.int32) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        t = transducer(path)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids for every row, as the sentencepiece library gives them.

    A null or empty text has no ids; repeated rows have theirs each; a null id stays null;
    an empty table gives no rows; other columns are ignored. ``model`` is a BPE model with
    byte fallback, the identity as its normaliser, and a prefix space.
    """
    return id_text(docs, id_col, text_col).mapInArrow(_encode(model), "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text for every row; null ids are none, and bytes that are no UTF-8 become U+FFFD."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(model), "doc_id long, text string")


def _digest(path: str):
    def run(batches):
        t = transducer(path)
        for batch in sliced(batches):
            column = batch.column(1)
            rows = [column[i].values.to_numpy().astype("<u4") for i in range(batch.num_rows)]
            texts = [t.decode(r.tolist()).encode() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, rows), pa.int64()), pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])],
                ["doc_id", "n_pieces", "ids_crc32", "decoded_bytes", "decoded_sha256"],
            )

    return run


def digest(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), and the size and SHA-256 of
    the decoded text, for each row of ``encode_texts``."""
    return encoded.mapInArrow(_digest(model), "doc_id long, n_pieces long, ids_crc32 long, decoded_bytes long, decoded_sha256 string")
