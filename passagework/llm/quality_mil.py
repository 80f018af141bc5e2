"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. A passage is encoded by its byte
histogram and the histogram of pairs of byte classes, both as shares, by how often a word
repeats the one before it, and by a learned layer over these. Gated attention weighs the
passages (softmax of w . (tanh(Vh) * sigmoid(Uh))); the weighted sum is the document's
representation, and a logistic layer scores it. All parts are learned together, by the
documents' labels alone.

It is fitted on at most ``MAX_LABELLED`` labelled documents, taken by a hash of the id
where there are more, and on no more than have ``MAX_PASSAGES`` passages together. All
passages of those are used, and every document is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import id_text, materialise, sliced
from .shingles import words_of

PASSAGE = 1024
HIDDEN, ATTENTION = 24, 12
MAX_LABELLED = 6_000
#: Passages that are sent to the driver, 852 bytes each and twice that in the fit. Beyond
#: that fewer documents are taken, and at least one.
MAX_PASSAGES = 100_000
THRESHOLD = 0.7
SCORED = (StructField("doc_id", LongType()), StructField("score", DoubleType()))


def _classes() -> np.ndarray:
    """Byte classes: lower, upper, digit, space, line end, stops, marks, symbols, bytes of other letters."""
    out = np.zeros(256, np.int64)
    for k, group in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".,;:", b"!?", b"'\"()-", b"#*$%&", b"|<>", range(128, 192), range(192, 256))):
        out[list(group)] = k + 1
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
WIDTH = 256 + N_CLASSES**2 + 1


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and where each text's begin; an empty text has one of zeros."""
    coded = [t.encode() for t in texts]
    counts = [max(1, -(-len(c) // PASSAGE)) for c in coded]
    at = np.cumsum([0, *counts])
    data = np.frombuffer(b"".join(coded), np.uint8)
    lengths = np.array(list(map(len, coded)), np.int64)
    start = np.cumsum(lengths) - lengths
    own = np.repeat(at[:-1] - start // PASSAGE, lengths) if len(data) else np.zeros(0, np.int64)
    own = own + (np.arange(len(data)) - np.repeat(start - start // PASSAGE * PASSAGE, lengths)) // PASSAGE
    own = own.astype(np.int64)
    kind = CLASS[data]
    out = np.empty((at[-1], WIDTH), np.float32)
    out[:, :256] = np.bincount(own * 256 + data, minlength=at[-1] * 256).reshape(-1, 256)
    same = own[1:] == own[:-1]
    pair = (own[:-1] * N_CLASSES + kind[:-1]) * N_CLASSES + kind[1:]
    out[:, 256:-1] = np.bincount(pair[same], minlength=at[-1] * N_CLASSES**2).reshape(-1, N_CLASSES**2)
    out[:, :-1] /= np.maximum(1, np.bincount(own, minlength=at[-1]))[:, None]
    words, first, _, where, _ = words_of(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    stands = at[text] + (where - (start + np.arange(len(texts)))[text]) // PASSAGE
    again = np.concatenate([[False], (words[1:] == words[:-1]) & (text[1:] == text[:-1])]) if len(words) else np.zeros(0, bool)
    out[:, -1] = np.bincount(stands, again, at[-1]) / np.maximum(1, np.bincount(stands, minlength=at[-1]))
    return np.sqrt(out), at


def _forward(m: dict, x: np.ndarray, at: np.ndarray) -> tuple:
    h = np.tanh(x @ m["E"] + m["e"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    a = (t * g) @ m["w"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, at[:-1]), np.diff(at)))
    a /= np.repeat(np.add.reduceat(a, at[:-1]), np.diff(at))
    z = np.add.reduceat(h * a[:, None], at[:-1])
    return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["b"], -30, 30)))


def score(model: dict, texts: list[str]) -> np.ndarray:
    """Scores to six places, in double precision: equal whatever batch a text stands in."""
    if not texts:
        return np.zeros(0)
    x, at = passages(texts)
    return np.round(_forward({k: v.astype(np.float64) for k, v in model.items()}, x.astype(np.float64), at)[-1], 6)


def gradients(m: dict, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Of the mean weighed cross-entropy of these bags, by parameter."""
    h, t, g, a, z, p = _forward(m, x, at)
    sizes = np.diff(at)
    d = (p - y).astype(np.float32) * weight / len(y)
    dz = d[:, None] * m["c"]
    each = np.repeat(dz, sizes, 0)
    da = (each * h).sum(1)
    da = a * (da - np.repeat(np.add.reduceat(da * a, at[:-1]), sizes))
    dt, dg = da[:, None] * m["w"] * g * (1 - t * t), da[:, None] * m["w"] * t * g * (1 - g)
    dh = (each * a[:, None] + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ d, "b": d.sum(keepdims=True)}


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.01, seed: int = 7) -> dict:
    """Adam on the mean cross-entropy, classes weighed alike, in bags of 64. Without a bag the
    model stays as it was drawn; with one class only it learns that one."""
    rng = np.random.default_rng(seed)
    shape = {"E": (WIDTH, HIDDEN), "e": HIDDEN, "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": ATTENTION, "c": HIDDEN, "b": 1}
    m = {k: (rng.normal(0, 0.2, s) if k not in "eb" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    step = 0
    for epoch in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 64):
            bags = order[k : k + 64]
            sizes = at[bags + 1] - at[bags]
            own = np.concatenate([[0], np.cumsum(sizes)])
            xs = x[np.repeat(at[bags] - own[:-1], sizes) + np.arange(own[-1])]
            grads = gradients(m, xs, own, y[bags], weight[bags])
            step += 1
            for name, grad in grads.items():
                grad = grad + 1e-4 * m[name]
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad * grad
                m[name] -= (rate * (1 - epoch / epochs) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _encode(batches):
    for batch in sliced(batches):
        x, at = passages(batch.column(1).to_pylist())
        rows = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            rows.append(x[a:b].astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_passages: int = MAX_PASSAGES) -> dict:
    """Fit on rows of ``labels`` (doc_id, quality) that aren't held out and have a document.

    Labels that are null or whose id is null are left out; of several for one id the
    largest counts, and of several texts the least. Without any, the model scores about 0.5.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
    chosen = own.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = materialise(chosen, "labelled")  # at most max_labelled ids, so they may be broadcast
    texts = materialise(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "labelled_texts")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over max_labelled rows at most, without their texts
    sized = texts.select("doc_id", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).alias("n")).withColumn("total", F.sum("n").over(before))
    fits = sized.filter((F.col("total") <= max_passages) | (F.col("total") == F.col("n"))).select("doc_id")
    encoded = texts.join(F.broadcast(fits), "doc_id", "left_semi").mapInArrow(_encode, "doc_id long, x binary")
    rows = encoded.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toArrow().to_pydict()
    parts = [np.frombuffer(x, np.float16).reshape(-1, WIDTH).astype(np.float32) for x in rows["x"]]
    x = np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)
    return fit(x, np.cumsum([0, *map(len, parts)]), (np.array(rows["quality"]) > 0).astype(np.float32))


def _score(shared):
    def run(batches):
        for batch in sliced(batches, limit=500_000):
            scores = score(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), *batch.columns[2:]], ["doc_id", "score", *batch.schema.names[2:]])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, max_passages: int = MAX_PASSAGES, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, with ``carry`` also the whole ``row``.

    A null or empty text is one empty passage and has a score as any other; repeated rows
    have equal scores; a null id isn't held out; an empty table gives no rows. Only texts
    are inputs of a score; other columns are ignored.
    """
    df = id_text(docs, id_col, text_col, carry)
    model = docs.sparkSession.sparkContext.broadcast(train(df.select("doc_id", "text"), labels, max_labelled, max_passages))
    kinds = StructType([*SCORED, *df.schema.fields[2:]])
    out = df.mapInArrow(_score(model), kinds)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *df.columns[2:])
