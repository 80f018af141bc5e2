"""Mixing sources to target weights by whole repetitions and one hash-seeded Bernoulli copy.

Words are counted per document and summed per source. A source's target is its share by
weight of all words, at most ``MOST`` times its own; what is above is shared out again by
weight among the others until none is above. Its rate is target over size: each of its
documents is taken floor(rate) times, and once more where a number in [0, 1) made of a
hash of the document and a seed lies below the rate's fraction.

Each draw has the right expectation, but a source of few documents, or with a few very
long ones, can end far from its target by chance. So ``SEEDS`` seeds are summed in the one
pass that reads the sizes, and each source takes the seed that comes nearest. Sums are of
whole numbers and hashes depend on the document alone, so reruns agree on any cluster.

DataFrame functions only. The table of sizes is written once (no texts), so what comes
after the count never reads a text again; sources are a table, joined by their name, and
AQE broadcasts it or splits a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.numbering import numbered

from .common import materialise

WEIGHTS = (1, 2, 3)
MOST = 3
SEEDS = 32
_RANGE = 1 << 31


def word_count(text: Column) -> Column:
    """Runs of other characters than U+0020 and U+0009 to U+000D; of null none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """The source as a string that orders nulls last, and two numbers that every draw is made of."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(text_col, F.lit(""))))))
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long").bitwiseAND(_RANGE - 1)
    source = F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), source_col))
    return docs.select(source.alias("source_key"), number(1).alias("h1"), number(9).alias("h2"), *more)


def _copies(seed: int | Column) -> Column:
    """How often a document is taken: its source's ``rate``, and its own draw under the seed."""
    whole = F.floor("rate")
    draw = (F.col("h1") + F.col("h2") * seed).bitwiseAND(_RANGE - 1) / F.lit(float(_RANGE))
    return whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``target`` of each row of (weight, source_size): its share by weight of all sizes, no
    more than ``most`` times its own. Every round caps what is above and raises the rest's
    share, until none is above; a round is one aggregate of one row. Without any size all
    targets are 0."""
    cap = F.col("source_size") * most
    total, free = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    unit, above = (total or 0) / (free or 1), 0
    while total:
        over = F.col("weight") * F.lit(unit) > cap
        n, capped, free = sources.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == above or not free:
            break
        unit, above = (total - capped) / free, n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(unit)), cap.cast("double")))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seeds: int = SEEDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Two tables: of documents (id, source_key, h1, h2, size) and of sources (source_key,
    weight, source_size, target, rate, seed).

    Sources in order of code points, null last, have ``weights`` in turn. A null text has
    size 0, as has an empty one; a source without words has target and rate 0; a document
    without an id draws by its text; repeated rows draw alike and each counts; an empty
    table gives two empty ones; other columns are ignored.
    """
    sized = materialise(_keyed(docs, id_col, text_col, source_col, F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    sums = materialise(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), "mix-sources")
    placed = materialise(numbered(sums, [], ["source_key"], "place"), "mix-placed")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int")).cast("long")
    aimed = with_targets(placed.withColumn("weight", weight), most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = materialise(aimed.select("source_key", "weight", "source_size", "target", rate.alias("rate")), "mix-targets")
    drawn = sized.join(aimed.select("source_key", "rate"), "source_key").groupBy("source_key").agg(F.array(*(F.sum(_copies(k) * F.col("size")) for k in range(seeds))).alias("taken"))
    off = F.transform("taken", lambda t, k: F.struct(F.abs(t - F.col("target")).alias("off"), k.alias("seed")))
    chosen = aimed.join(drawn, "source_key").withColumn("seed", F.array_min(off)["seed"]).drop("taken")
    return sized, materialise(chosen, "mix-plan")


def planned(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, copies of every row of ``docs``; see ``plan`` for odd rows."""
    sized, sources = plan(docs, **how)
    return sized.join(sources, "source_key").select(F.col("id").alias("doc_id"), "size", "source_size", "target", _copies(F.col("seed")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed rows: each row of ``docs`` with all its columns as often as it is taken."""
    _, sources = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    rows = _keyed(docs, id_col, text_col, source_col, F.struct("*").alias("row")).join(sources, "source_key")
    return rows.select("row", F.explode(F.array_repeat(F.lit(True), _copies(F.col("seed")).cast("int")))).select("row.*")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT & {_RANGE - 1} AS h1, ('0x' || substr(md5(doc_id::VARCHAR), 9, 8))::BIGINT & {_RANGE - 1} AS h2 FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
total AS (SELECT sum(source_size)::BIGINT AS words FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source) AS k, 3.0::DOUBLE * source_size / weight AS most FROM s),
p AS (SELECT k, most, (words - coalesce(3 * sum(source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER rest)::DOUBLE AS unit
      FROM r, total WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u AS (SELECT coalesce(arg_min(unit, k) FILTER (unit <= most), 0) AS unit FROM p),
t AS (SELECT source, source_size, least(weight * unit, 3.0::DOUBLE * source_size)::DOUBLE AS target FROM s, u),
rate AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
drawn AS (SELECT doc_id, d.source, size, source_size, target, seed, (floor(rate) + CASE WHEN ((h1 + h2 * seed) & {_RANGE - 1})::DOUBLE / {_RANGE} < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size AS taken
          FROM d JOIN rate ON d.source IS NOT DISTINCT FROM rate.source, range({SEEDS}) x(seed)),
sums AS (SELECT source, seed, abs(sum(taken)::DOUBLE - any_value(target)) AS off FROM drawn GROUP BY source, seed),
best AS (SELECT source, arg_min(seed, (off, seed)) AS seed FROM sums GROUP BY source)
SELECT doc_id, size, source_size, target, taken FROM drawn JOIN best ON drawn.source IS NOT DISTINCT FROM best.source AND drawn.seed = best.seed"""
