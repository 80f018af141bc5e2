"""Cross-entropy difference of two matched n-gram models.

A target model and a background model are bigram models of the same form: one vocabulary,
one smoothing, counts of their own. The vocabulary is every word of the corpus, so it and
the n-grams grow with the input, and nothing is cut off: what occurs once has its count.
A document's score is the mean over its words of the background's loss less the target's:
above 0, it looks more like the target than the corpus does. A document is scored by what
the others have: its own counts are taken off first, or each would look like the model
that it is in. What occurs twice in the corpus still shows, as its copy stays.

No table of counts is ever in one place. Texts are read in blocks of ``BLOCK_BYTES``, and
a block's texts become numbers of its distinct words. Each block sends its distinct words,
contexts and pairs, as sorted 64-bit hashes with their counts, to the shards that own
these hashes. A shard adds up what all blocks sent, and answers every block with the
corpus' counts of just those. The block then knows all counts that its documents need.
Words that are everywhere are sent once by a block, so no shard gets more than its share
of hashes; there is a shard for every ``SHARD_BYTES`` of text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, sliced
from .shingles import mix, numbered, secret_key, words_of

BLOCK_BYTES = 4_000_000
SHARD_BYTES = 8_000_000
#: Weight of the words' own shares against the counts that follow a word.
PRIOR = 4.0
#: Ids of target documents are broadcast up to this many, and joined beyond.
BROADCAST_IDS = 1_000_000
#: What a hash counts stands in its last two bits.
WORD, CONTEXT, PAIR = np.uint64(0), np.uint64(1), np.uint64(2)
START = np.array([0x51A7], np.uint64)
BLOCK = "block long, doc_ids array<long>, sizes array<long>, targets array<long>, words binary, n long, tokens binary"


def _packed(x: np.ndarray) -> bytes:
    """Numbers by their bytes: all first ones, then all second ones, and so on, compressed."""
    return pa.compress(np.ascontiguousarray(x.ravel().view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _rows(batches):
    """One row at a time, as a row is a whole block."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _blocks(key: int):
    """Texts as numbers of their block's words, which are hashed under the run's key."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32

        def out(rows):
            nonlocal block
            ids, texts, targets = zip(*rows, strict=True)
            hashes, at = words_of(list(texts), key)[:2]
            words, _, which = numbered(hashes)
            block += 1
            columns = [[block - 1], [list(ids)], [np.diff(at).tolist()], [list(targets)], [words.tobytes()], [len(which)], [_packed(which.astype("<u4"))]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)

        rows, held = [], 0
        for batch in sliced(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held + len(row[1]) > BLOCK_BYTES:
                    yield out(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[1]) + 1
        if rows:
            yield out(rows)

    return run


FIELDS = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("targets", pa.list_(pa.int64())), ("words", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary())]
)


class _Grams:
    """A block's words, contexts and pairs: their hashes and counts, and which each token has."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        words = np.frombuffer(row["words"], np.uint64)
        self.token = _unpacked(row["tokens"], row["n"], "<u4").astype(np.int64)
        size = len(words)
        first = np.cumsum(self.sizes) - self.sizes
        self.before = np.concatenate([[size], self.token[:-1]])[: len(self.token)]
        self.before[first[self.sizes > 0]] = size  # the start of a text
        self.target = np.repeat(np.array(row["targets"], np.int64), self.sizes)
        pairs, _, which = numbered(self.before * size + self.token)
        self.parts = np.cumsum([0, size, size + 1, len(pairs)])
        self.pair = which
        u = np.concatenate([words, START])
        keys = [words, mix(u + np.uint64(1)), mix(mix(u[pairs // max(1, size)] + np.uint64(3)) ^ words[pairs % max(1, size)])]
        self.keys = np.concatenate([k & ~np.uint64(3) | kind for k, kind in zip(keys, (WORD, CONTEXT, PAIR), strict=True)])
        held = ((self.token, size), (self.before, size + 1), (which, len(pairs)))
        self.counts = np.stack([np.concatenate([np.bincount(at, w, n) for at, n in held]) for w in (None, self.target)]).astype(np.int64)

    def own(self) -> np.ndarray:
        """How often each token's word, context and pair occur in its text, and the text's tokens."""
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        out = []
        for at, n in zip((self.token, self.before, self.pair), np.diff(self.parts), strict=True):
            which = numbered(doc * n + at)[2]
            out.append(np.bincount(which)[which] if len(which) else which)
        return np.stack([*out, self.sizes[doc]])

    def losses(self, counts: np.ndarray, own: np.ndarray, vocabulary: int, prior: float) -> np.ndarray:
        """Each token's loss under the model with these counts of the block's keys, less
        those of its ``own`` text."""
        a, b, c = self.parts[1:]
        share = (counts[:a][self.token] - own[0] + 1) / (counts[-1] - own[3] + vocabulary + 1)
        return np.log(counts[a:b][self.before] - own[1] + prior) - np.log(counts[b:c][self.pair] - own[2] + prior * share)


def _send(shards: int):
    def run(batches):
        for row in _rows(batches):
            grams = _Grams(row)
            order = np.argsort(grams.keys)
            keys, counts = grams.keys[order], grams.counts[:, order].astype("<u4")
            cut = np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cut)).tolist()
            spans = [slice(cut[k], cut[k + 1]) for k in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([s.stop - s.start for s in spans], pa.int64()), pa.array([_packed(np.diff(keys[s], prepend=np.uint64(0))) for s in spans], pa.binary()), pa.array([_packed(counts[:, s]) for s in spans], pa.binary())],
                ["shard", "block", "n", "keys", "counts"],
            )

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """What each block sent, with the sums over all blocks; and how many words there are."""
    table = table.sort_by("block")
    sizes = table.column("n").to_pylist()
    sent = [np.cumsum(_unpacked(k, n, "<u8"), dtype=np.uint64) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)]
    counts = np.concatenate([_unpacked(c, 2 * len(k), "<u4").reshape(2, -1) for c, k in zip(table.column("counts").to_pylist(), sent, strict=True)], 1)
    keys, _, which = numbered(np.concatenate(sent))
    sums = np.stack([np.bincount(which, c, len(keys)).astype("<u8") for c in counts])
    at = np.cumsum([0, *sizes]).tolist()
    words = [int((keys & np.uint64(3) == WORD).sum())] + [0] * (len(sizes) - 1)
    answers = [_packed(sums[:, which[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table([table.column("block"), table.column("shard"), pa.array(words, pa.int64()), table.column("n"), pa.array(answers, pa.binary())], names=["block", "shard", "words", "n", "sums"])


def _score(totals: tuple[int, int], vocabulary: int, prior: float):
    def run(batches):
        for row in _rows(batches):
            grams = _Grams(row)
            order = np.argsort(grams.keys)
            sums = np.empty((2, len(order) + 1), np.float64)
            answers = sorted(row["answers"] or (), key=lambda a: a["shard"])
            sums[:, order] = np.concatenate([np.zeros((2, 0)), *(_unpacked(a["sums"], 2 * a["n"], "<u8").reshape(2, -1) for a in answers)], 1)
            sums[:, -1] = totals
            some = grams.sizes > 0
            first = (np.cumsum(grams.sizes) - grams.sizes)[some]
            mean = np.zeros((2, len(some)))
            own = grams.own()
            for out, counts, part in zip(mean, sums, (1, grams.target), strict=True):
                if len(first):
                    out[some] = np.add.reduceat(grams.losses(counts, own * part, vocabulary, prior), first) / grams.sizes[some]
            background, target = mean
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(grams.sizes), pa.array(target), pa.array(background), pa.array(background - target)],
                ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
            )

    return run


def score_documents(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row.

    ``target_ids`` has the doc_id of the target's documents; the background is all of
    ``docs``. A model's share of a word is (its count + 1) / (all its words + the vocabulary
    + 1), and the chance of a word after another (the pair's count + ``prior`` * that share)
    / (the other's count as a context + ``prior``); a text's start is a context too. All
    counts are those of the other rows: a row's own are taken off where it was counted.

    A null or empty text has no tokens, no losses and a score of 0; repeated rows count as
    often as they occur and score alike; a null id is no target; an empty target leaves its
    model uniform; an empty table gives no rows. Other columns are ignored.
    """
    df = id_text(docs, id_col, text_col)
    own = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(1))
    own = F.broadcast(own) if own.count() <= broadcast_ids else own
    flagged = df.join(own, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(0)).cast("long").alias("target"))
    blocks = materialise(flagged.mapInArrow(_blocks(secret_key()), BLOCK), "blocks")
    sizes = F.col("sizes")
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    both = F.zip_with(sizes, "targets", lambda n, t: n * t)
    tokens, target, size = blocks.agg(F.coalesce(F.sum(add(sizes)), F.lit(0)), F.coalesce(F.sum(add(both)), F.lit(0)), F.coalesce(F.sum(F.octet_length("words") + F.col("n")), F.lit(0))).first()
    sent = blocks.mapInArrow(_send(max(1, -(-2 * size // SHARD_BYTES))), "shard long, block long, n long, keys binary, counts binary")
    answers = materialise(sent.groupBy("shard").applyInArrow(_add_up, "block long, shard long, words long, n long, sums binary"), "answers")
    vocabulary = answers.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    each = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "n", "sums")).alias("answers"))
    return blocks.join(each, "block", "left").mapInArrow(_score((tokens, target), vocabulary, prior), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
