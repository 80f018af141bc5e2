"""A prepared keyword index of passages, as written tables.

Tokenising is paid once, not for each question. Each file of postings is sorted by term, so
a question reads the pages of its own terms only, a few of every file; how many passages have
a term stands in a table of its own, sorted likewise. ``prepare`` makes an index of one snapshot;
``segments.SegmentedIndex`` follows edits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.constants import B, K1, STOP_WORDS
from passagework.functions.text import fingerprint, spaced
from passagework.storage import fresh_path

#: Question terms are pushed to the scan as literals up to this many; their rows are
#: broadcast up to ``BROADCAST_TERMS``, and joined by shuffle beyond.
PUSHED_TERMS, BROADCAST_TERMS = 1_000, 100_000
#: Weights are added up as whole numbers of this many parts, so that a sum doesn't depend on
#: the order in which tasks send them: 4e-15 apart, and room for hundreds of terms.
PARTS = 1 << 48
#: Counted words that a task gathers before it hands them on.
CHUNK = 1 << 19


@dataclass(frozen=True)
class Index:
    keys: tuple[str, ...]
    postings: DataFrame  # term, keys, len, tf
    passages: DataFrame  # keys, fp
    terms: DataFrame  # term, df
    n: int
    total: int

    @property
    def avg_len(self) -> float:
        return max(1.0, self.total / max(1, self.n))

    def bm25(self, terms: DataFrame) -> DataFrame:
        """qid, keys, lexical_score of every passage that has a term of (qid, term)."""
        asked = [r.term for r in terms.select("term").limit(PUSHED_TERMS + 1).collect()]
        few = len(asked) <= PUSHED_TERMS  # rows, so terms are few, too
        if not few:
            asked = [r.term for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
            few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        small = F.broadcast if few else lambda df: df
        if len(asked) <= PUSHED_TERMS:
            own = F.col("term").isin(sorted(set(asked)))
            weighed = terms.join(F.broadcast(self.terms.filter(own)), "term")  # a row for each term asked
            found = self.postings.filter(own).join(small(weighed), "term")
        else:
            found = self.postings.join(small(terms.join(self.terms, "term")), "term")
        idf = F.log1p((F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * ((1 - B) * 1.0 + B * F.col("len") / F.lit(self.avg_len)))
        parts = F.round(weight * float(PARTS)).cast("long")
        scored = found.withColumn("parts", parts).groupBy("qid", *self.keys).agg((F.sum("parts") / float(PARTS)).alias("s"), F.count("*").alias("matched"))
        return scored.select("qid", *self.keys, (F.col("s") * (1 + F.log(F.col("matched").cast("double")))).alias("lexical_score"))


def postings_of(tokenised: DataFrame, keys: list[str]) -> DataFrame:
    """term, keys, len, tf from (keys, runs, len). What else a passage has is not repeated for
    each of its words."""
    return tokenised.select(*keys, "len", F.explode("runs").alias("run")).select("run.term", *keys, "len", "run.tf")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """keys, fp, len, runs of (keys, fp, spaced text): words of a text counted, stop words left out."""
    left_out = ("", *STOP_WORDS)
    for batch in batches:
        start, lens, ends, terms, counts = 0, [], [0], [], []
        for k, text in enumerate(batch.columns[-1], 1):
            found = Counter((text.as_py() or "").split(" "))
            for word in left_out:
                found.pop(word, None)
            terms += found.keys()
            counts += found.values()
            lens.append(found.total())
            ends.append(len(terms))
            if len(terms) > CHUNK or k == batch.num_rows:
                pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([*batch.slice(start, k - start).columns[:-1], pa.array(lens, pa.int32()), runs], [*batch.schema.names[:-1], "len", "runs"])
                start, lens, ends, terms, counts = k, [], [0], [], []


def write_tokens(passages: DataFrame, keys: list[str], text: str, path: str) -> DataFrame:
    """keys, fp, len, runs of every passage, written. ``runs`` has each word once with how
    often it is there; words are made in the JVM and counted in their task, none is shuffled."""
    spark = passages.sparkSession
    cores = spark.sparkContext.defaultParallelism
    narrow = passages.select(*keys, F.col(text).alias("text"))
    if narrow.rdd.getNumPartitions() < cores:  # few splits would leave tokenising to few tasks
        narrow = narrow.repartition(cores)
    rows = narrow.select(*keys, F.unhex(F.md5(fingerprint("text"))).alias("fp"), spaced("text").alias("w"))
    schema = rows.drop("w").selectExpr("*", "0 AS len", "array(struct('' AS term, 0L AS tf)) AS runs").schema
    rows.mapInArrow(_counted, schema).write.parquet(path)
    return spark.read.parquet(path)


def write_postings(postings: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings, those of each task sorted by term, and how many there are of each. They stay
    in the task that has their passages, so a frequent term is in no single one."""
    spark = postings.sparkSession
    postings.sortWithinPartitions("term").write.parquet(f"{path}/postings")
    done = spark.read.parquet(f"{path}/postings")
    done.groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    return done, spark.read.parquet(f"{path}/terms")


def counts_of(tokenised: DataFrame) -> tuple[int, int]:
    """How many passages there are, and how many words they have."""
    n, total = tokenised.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    return int(n), int(total)


def prepare(passages: DataFrame, keys: list[str], text: str = "text") -> Index:
    """Index of (keys, text) as they are now. Keys tell passages apart; rows with a null
    text have no terms but count."""
    path = fresh_path(passages.sparkSession, "index")
    tokenised = write_tokens(passages, keys, text, f"{path}/tokens")
    postings, terms = write_postings(postings_of(tokenised, keys), path)
    return Index(tuple(keys), postings, tokenised.select(*keys, "fp"), terms, *counts_of(tokenised))
