"""Sequence packing by lexical retrieval.

The index is sharded by content. A document goes to the cluster of the term that weighs
most in it by BM25, of those that 256 documents have; clusters that may be larger than
a shard are dealt to several. Spark shuffles each text once, to its cluster, and
sorts by cluster; a shard is a run of at most ``SHARD_DOCS`` documents or ``SHARD_BYTES``
of text in that order, so its memory is bounded. Its inverted BM25 index holds all words
of its documents; document frequencies and the average length come from all documents.

A window starts with its seed. The index is asked with all words of the seed that not over
a sixteenth of the shard has, and with the others too if these find nothing. Its unused
neighbours come in order of score, as many as there are, and fill the window: those that
fit whole, then the best one cut at the window's end, whose rest is the next window's
seed. So windows are full. What is left at the end of a task is cut into sequences of
powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, sliced
from .shingles import distinct, edges_of, mix, numbered, words_of

WINDOW = 2048
END = (1).to_bytes(4, "little")
#: Document frequencies are kept for so many buckets of words, and broadcast (2 MB).
TERMS = 1 << 18
SHARD_DOCS, SHARD_BYTES = 4096, 64_000_000
#: A cluster's term is in that share of a shard's documents at least.
CLUSTER_SHARE = 1 / 16
K1, B = 1.2, 0.75
#: Words whose ids a worker keeps, about 40 bytes each; beyond that it starts anew.
TABLE_SIZE = 2_000_000

#: Lower-case letters of the blocks that are split here; other texts go to the tokenizer whole.
LETTERS = "a-zß-öø-įĲ-ɏа-џѡ-ҁҋ-ԯ"
PLAIN = "\x00-\x1b\x20-\x7e¡-©«-±´¶-¸»¿À-įĲ-ɏЀ-ҁҊ-ԯ‐-‧€"
SPLIT = rf"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}0-9]+"


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level BPE: printable ones for themselves,
    the others for those from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(rest)}


class WordIds:
    """Token ids of whole batches of texts. White space parts what the tokenizer parts, so
    a text's ids are its words' one after the other. Words are looked up by 64-bit hash in
    a sorted table that the worker keeps; new ones go through the tokenizer's model. What
    is found must be the same word: its length and first and last eight bytes, and of words
    over 16 bytes all bytes, are compared. A text with a word that isn't goes to the
    tokenizer whole, so ids don't depend on hashes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.plain = re.compile(f"[{PLAIN}]*").fullmatch
        self.split = re.compile(SPLIT).findall
        self.letters = _byte_letters()
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.edges = np.zeros((0, 3), np.uint64)
        self.long: dict[int, bytes] = {}  # the words over 16 bytes by their hash

    def _word(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace").lower()
        parts = (text,) if text.isascii() and text.isalpha() else self.split(text)
        return [t.id for p in parts for t in self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(self.letters))]

    def _learn(self, hashes: np.ndarray, edges: np.ndarray, words: list[bytes]) -> None:
        if len(self.hashes) + len(hashes) > TABLE_SIZE:
            self._reset()
        self.long.update((h, w) for h, w in zip(hashes.tolist(), words, strict=True) if len(w) > 16)
        ids = list(map(self._word, words))
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        start = len(self.flat) + np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        self.flat = np.concatenate([self.flat, np.fromiter((i for w in ids for i in w), np.uint32, int(length.sum()))])
        at = np.searchsorted(self.hashes, hashes)
        self.start, self.length = np.insert(self.start, at, start), np.insert(self.length, at, length)
        self.edges = np.insert(self.edges, at, edges, 0)
        self.hashes = np.insert(self.hashes, at, hashes)

    def encode(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Each text's ids with the end's, as bytes; the words' hashes; where texts begin there."""
        hashes, at, data, starts, ends = words_of(texts)
        known, first, which = numbered(hashes)
        edges = edges_of(data, starts, ends)
        for _ in range(2):  # the table may start anew, then all are unknown
            k = np.minimum(np.searchsorted(self.hashes, known), max(0, len(self.hashes) - 1))
            new = np.flatnonzero(self.hashes[k] != known) if len(self.hashes) else np.arange(len(known))
            if not len(new):
                break
            raw, a, b = data.tobytes(), starts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn(known[new], edges[first[new]], [raw[x:y] for x, y in zip(a, b, strict=True)])
        else:
            k = np.searchsorted(self.hashes, known)
            if len(known) and not np.array_equal(self.hashes[np.minimum(k, len(self.hashes) - 1)], known):
                self._reset()
                return self.encode(texts)
        length = self.length[k][which] if len(known) else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(self.start[k][which] - bounds[:-1], length) + np.arange(bounds[-1])] if len(known) else self.flat[:0]
        cut = bounds[at].tolist()
        differ = (self.edges[k][which] != edges).any(1) if len(known) else np.zeros(0, bool)
        raw = data.tobytes()
        for i in np.flatnonzero((ends - starts > 16) & ~differ).tolist():
            differ[i] = self.long[int(hashes[i])] != raw[starts[i] : ends[i]]
        other = set((np.searchsorted(at, np.flatnonzero(differ), "right") - 1).tolist())
        out = []
        for row, (text, x, y) in enumerate(zip(texts, cut[:-1], cut[1:], strict=True)):
            if row in other or not self.plain(text) or any(s in text for s in self.added):
                out.append(np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + END)
            else:
                out.append(ids[x:y].astype("<u4", copy=False).tobytes() + END)
        return out, hashes, at


@functools.lru_cache(maxsize=2)
def _ids(path: str) -> WordIds:
    return WordIds(path)


def _terms(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: the text's number, the word, how often; in order of texts."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    hashes = np.concatenate([np.sort(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]) if len(hashes) else hashes
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])) if len(hashes) else np.zeros(0, np.int64)
    return text[new], hashes[new], np.diff(np.append(new, len(hashes)))


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(TERMS - 1)).astype(np.int64)


def _frequencies(batches):
    found, docs, words = np.zeros(TERMS, np.int64), 0, 0
    for batch in sliced(batches):
        hashes, at = words_of(batch.column(1).to_pylist())[:2]
        pairs = distinct(np.repeat(np.arange(len(at) - 1) * TERMS, np.diff(at)) + _bucket(hashes))
        found += np.bincount(pairs % TERMS, minlength=TERMS)
        docs, words = docs + batch.num_rows, words + len(hashes)
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([found[at], [docs, words]]))], ["term", "n"])


class Statistics:
    """How many documents have a word (more exactly, one of its bucket), and how long they are."""

    def __init__(self, df: np.ndarray, docs: int, words: int):
        self.df, self.average = df, max(1.0, words / max(1, docs))
        self.idf = np.where(df > 0, np.log1p((docs - df + 0.5) / (df + 0.5)), 0).astype(np.float32)

    def weights(self, words: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """BM25 weights of words, given how often they occur and their documents' lengths."""
        return self.idf[_bucket(words)] * (times * (K1 + 1) / (times + K1 * (1 - B + B * lengths / self.average))).astype(np.float32)


def corpus_statistics(docs: DataFrame) -> Statistics:
    """Document frequencies and the average length over all rows; nulls are empty texts,
    repeated rows count each, and an empty table gives frequencies of 0 and a length of 1.

    A task sends a count per bucket, ``TERMS`` at most, and so does Spark to the driver.
    """
    rows = docs.mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    n = dict(zip(rows["term"], rows["n"], strict=True))
    total, words = n.pop(-1, 0), n.pop(-2, 0)
    df = np.zeros(TERMS, np.int64)
    if n:
        df[list(n)] = list(n.values())
    return Statistics(df, total, words)


def clusters(texts: list[str], statistics: Statistics, shard_docs: int = SHARD_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's cluster, and the shards that it may need. A text is in the cluster of
    its weightiest term that enough documents have, or else of its most frequent one."""
    hashes, at = words_of(texts)[:2]
    text, word, times = _terms(hashes, at)
    term = _bucket(word)
    weight = statistics.weights(word, times, np.diff(at)[text])
    df = statistics.df[term]
    rank = np.where(df >= CLUSTER_SHARE * shard_docs, weight, -1.0 / np.maximum(1, df))
    cluster = np.full(len(texts), TERMS, np.int64)
    if len(text):
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        best = np.flatnonzero(rank == np.repeat(np.maximum.reduceat(rank, first), np.diff(np.append(first, len(text)))))
        cluster[text[best]] = term[best]
    size = np.append(statistics.df, statistics.df.max(initial=1))[cluster]
    return cluster, -(-np.maximum(1, size) // shard_docs)


class Index:
    """An inverted BM25 index over a shard of documents, given as words and their counts."""

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]], statistics: Statistics):
        self.n = len(counted)
        doc = np.repeat(np.arange(self.n), [len(w) for w, _ in counted])
        words = np.concatenate([w for w, _ in counted]) if counted else np.zeros(0, np.uint64)
        times = np.concatenate([c for _, c in counted]) if counted else np.zeros(0, np.int64)
        weight = statistics.weights(words, times, np.bincount(doc, times, self.n)[doc] if len(doc) else times)
        term = numbered(words)[2]
        df = np.bincount(term)
        shared = df[term] > 1  # what one document alone has finds nothing
        doc, term, weight = doc[shared], term[shared], weight[shared]
        self.asked = term
        self.first = np.searchsorted(doc, np.arange(self.n + 1))
        by_term = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by_term].astype(np.int32), weight[by_term]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(df)))])
        self.common = np.diff(self.start) * 16 > self.n

    def _scores(self, terms: np.ndarray) -> np.ndarray:
        size = self.start[terms + 1] - self.start[terms]
        at = np.repeat(self.start[terms] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return np.bincount(self.doc[at], self.weight[at], self.n)

    def neighbours(self, seed: int, unused: np.ndarray, every: bool = False) -> Iterator[np.ndarray]:
        """Unused documents that share a word with the seed, best score first, in parts. By
        the words that tell documents apart, or by ``every`` word."""
        terms = self.asked[self.first[seed] : self.first[seed + 1]]
        terms = terms if every else terms[~self.common[terms]]
        if not len(terms):
            return
        scores = self._scores(terms) * unused
        found = np.flatnonzero(scores)
        if len(found) > 64:
            best = np.argpartition(-scores[found], 64)
            top, found = found[best[:64]], found[best[64:]]
            yield top[np.lexsort((top, -scores[top]))]
            found = found[unused[found] > 0]
        yield found[np.lexsort((found, -scores[found]))]


class Packer:
    """Fills windows from shards of documents; one shard's open window goes on in the next."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.sequence, self.open, self.fill, self.rows = window, first_sequence, [], 0, []

    def _place(self, doc, start: int, length: int) -> None:
        self.open.append((doc, start, length))
        self.fill += length
        if self.fill == self.window:
            self._close(self.open)
            self.open, self.fill = [], 0

    def _close(self, pieces) -> None:
        offset = 0
        for (doc_id, ids), start, length in pieces:
            crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
            self.rows.append((doc_id, start, length, crc, len(ids) // 4, self.sequence, offset))
            offset += length
        self.sequence += 1

    def add(self, docs: list[tuple], index: Index) -> None:
        """``docs``: (doc_id, ids) in the index's order."""
        sizes = np.array([len(ids) // 4 for _, ids in docs])
        unused, following = np.ones(len(docs)), 0

        def put(k: int) -> None:
            unused[k] = 0
            at = 0
            while at < sizes[k]:
                length = min(int(sizes[k]) - at, self.window - self.fill)
                self._place(docs[k], at, length)
                at += length

        while True:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                return
            seed = following
            put(seed)
            while self.fill:
                cut = None
                for near in (part for every in (False, True) if cut is None for part in index.neighbours(seed, unused, every)):
                    if cut is None and len(near):
                        cut = int(near[0])
                    while self.fill and len(near := near[sizes[near] <= self.window - self.fill]):
                        put(near[0])
                        near = near[1:]
                    if not self.fill:
                        break
                if cut is None:
                    break
                if self.fill and unused[cut]:
                    put(cut)
                    seed = cut

    def end(self) -> None:
        """What is open becomes sequences of powers of two."""
        pieces, left = list(reversed(self.open)), self.fill
        while left:
            size = 1 << left.bit_length() - 1
            own, room = [], size
            while room:
                doc, start, length = pieces.pop()
                taken = min(room, length)
                own.append((doc, start, taken))
                room -= taken
                if taken < length:
                    pieces.append((doc, start + taken, length - taken))
            self._close(own)
            left -= size
        self.open, self.fill = [], 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _deal(shared, shard_docs: int):
    """Shard key, a place in it, id and text. Rows of a large cluster go round its shards."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            cluster, shards = clusters(batch.column(1).to_pylist(), shared.value, shard_docs)
            place = mix(np.arange(row, row + batch.num_rows, dtype=np.uint64))
            row += batch.num_rows
            shard = cluster << 40 | (place % shards.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(place.view(np.int64)), *batch.columns], ["shard", "place", "doc_id", "text"])

    return run


def _pack(path: str, shared, window: int, shard_docs: int):
    def run(batches):
        words = _ids(path)
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        docs: list[tuple] = []
        counted: list[tuple] = []
        held = 0

        def flush():
            packer.add(docs, Index(counted, shared.value))
            docs.clear()
            counted.clear()
            return packer.batch()

        for batch in sliced(batches):
            ids, hashes, at = words.encode(batch.column(1).to_pylist())
            text, word, times = _terms(hashes, at)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            for doc_id, own, a, b in zip(batch.column(0).to_pylist(), ids, cut[:-1], cut[1:], strict=True):
                docs.append((doc_id, own))
                counted.append((word[a:b], times[a:b]))
                held += len(own)
                if len(docs) == shard_docs or held > SHARD_BYTES:
                    yield flush()
                    held = 0
        if docs:
            yield flush()
        packer.end()
        yield packer.batch()

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's and then id 1, so a null or empty text has one
    token. Each id lies in one piece. Repeated rows are packed as often as they occur; a
    null id stays null; an empty table gives no rows; other columns are ignored. Sequence
    ids are unique, not dense: the task's number stands in the high bits.
    """
    df = id_text(docs, id_col, text_col)
    statistics = docs.sparkSession.sparkContext.broadcast(corpus_statistics(df))
    dealt = df.mapInArrow(_deal(statistics, shard_docs), "shard long, place long, doc_id long, text string")
    sharded = dealt.repartition("shard").sortWithinPartitions("shard", "place").select("doc_id", "text")
    return sharded.mapInArrow(_pack(tokenizer, statistics, window, shard_docs), ", ".join(f"{n} long" for n in NAMES))
