"""From a question to its passages: retrieval, overlap removal, scores, selection, statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions.identity import old_score_hash, score_hash
from passagework.functions.spec import QuerySpec, Settings
from passagework.functions.text import display_text, inclusion_fingerprint, model_text, span
from passagework.operators import context as contexts
from passagework.operators import inclusions, judge, ranges, ranking, score_store, widening
from passagework.operators.index import Index
from passagework.operators.partial import PartialSelection
from passagework.storage import fresh_path, written

SCORES = "map<string,double>"


@dataclass(frozen=True)
class Answer:
    shown: DataFrame  # id, position, score, contribution, scores, manual, path, line_start, line_end, text
    below: DataFrame  # judged, but under the threshold
    skipped: DataFrame  # too long to be judged
    missing: DataFrame | None  # inclusions without their one passage
    store: DataFrame  # scores to keep: those read, now used last, and the new ones
    statistics: DataFrame  # one row
    candidates: DataFrame  # what retrieval found, with its ranks and scores


def retrieve(index: Index, questions: DataFrame, candidates: int, vectors: DataFrame | None = None, queries: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """Per question of (qid, question) at most ``candidates`` passages in order, and whether
    there were more (``truncated``): keyword and vector ranks fused, or keywords alone where
    there are no vectors. Each list is as wide as ``pool_width`` says."""
    limit = ranking.clamp_candidates(candidates)
    width = ranking.pool_width(limit)
    lexical = ranking.lexical(index, ranking.question_terms(questions), width, digits)
    if vectors is None:
        ranked = lexical.withColumn("retrieval_score", F.lit(None).cast("double"))
    else:
        (key,) = index.keys
        semantic = ranking.vector_topk(vectors, queries, width, key, digits=digits)
        ranked = ranking.fuse(lexical, semantic, index.passages, key, limit + 1, digits)
    return ranking.bounded(ranked.filter(F.col("rank") <= limit + 1), limit)


def read_context(spec: QuerySpec, notes: DataFrame, source: str = "") -> str:
    """The text of what the question's links name; raises if one leads nowhere or all are too long."""
    if not spec.context_paths:
        return ""
    links = notes.sparkSession.createDataFrame([(source, k, p) for k, p in enumerate(spec.context_paths)], "source string, nth int, link string")
    row = contexts.contexts(links, notes).first()
    if row.status != contexts.OK:
        raise ValueError(f"the context of this question can't be used: {row.status}")
    return row.context


def _fetched(passages: DataFrame, found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The passages that were found, 1,000 at most, by their keys as literals: a scan reads
    only what may have them."""
    rows = found.select(keys[0]).distinct().limit(ranking.MAX_CANDIDATES + 1).collect()
    return passages.filter(F.col(keys[0]).isin([r[0] for r in rows])).join(F.broadcast(found), list(keys))


def _included(passages: DataFrame, entries: DataFrame) -> DataFrame:
    """Fingerprints of the passages of those notes that have an inclusion."""
    own = passages.join(entries.select("path").distinct(), "path", "left_semi")
    return own.select("id", "path", inclusion_fingerprint("text").alias("fingerprint"))


def answer(
    passages: DataFrame, index: Index, spec: QuerySpec, scorer: Callable | None, store: DataFrame, *, candidates: int = 100, threshold: float = Settings.threshold, limit: int = Settings.result_limit,
    namespace: str = "offline", notes: DataFrame | None = None, source: str = "", entries: DataFrame | None = None, vectors: DataFrame | None = None, queries: DataFrame | None = None, clock: int = 0,
    on_partial: Callable[[DataFrame, int, int], None] | None = None, rounds: int = 4,
) -> Answer:
    """The answer to one saved question over ``passages`` (id, path, line_start, line_end,
    text, render_text, heading_path, and for widening kind, parent_id, section_id) and their index.

    The question's own limit, threshold, neighbours and context count before the caller's.
    At most ``candidates`` passages go on, 1,000 at most, so what follows is small whatever
    the collection. Of overlapping ones the better stays. Passages whose display is too long
    aren't judged. Scores that the store has are read, under their older key if need be,
    the others are asked for once per hash, and all come back in ``store``. Without a scorer
    passages are in retrieval order, and nothing counts as checked. ``entries`` are
    inclusions by hand (path, fingerprint, score, contribution, scores, nth). What is shown is
    widened by the question's neighbours, and a passage that an earlier one contains then is
    left out, unless it was included by hand.

    With ``on_partial`` the scorer is asked in ``rounds``, and after the known scores and
    after each round it hears what would be shown by then (id, score, contribution, position)
    and how many passages were judged and passed.
    """
    limit = limit if spec.limit is None else spec.limit
    threshold = threshold if spec.threshold is None else spec.threshold
    context = read_context(spec, notes, source) if spec.context_paths and notes is not None else ""
    spark = passages.sparkSession
    question = spark.createDataFrame([(0, spec.question)], "qid long, question string")
    found = written(retrieve(index, question, candidates, vectors, queries).drop("qid", "fp"), "retrieved")
    rows = _fetched(passages, found, index.keys).withColumns({"model_text": model_text("heading_path"), "display": display_text()})
    places = {**{c: F.col(c) for c in ("id", "path", "line_start", "line_end")}, "headings": F.col("heading_path"), "text": F.col("model_text")}
    rows = rows.withColumns({"hash": score_hash(spec, F.col("model_text"), namespace, context), "old_hash": old_score_hash(spec, places, namespace, context)})
    found = written(rows, "candidates")
    order = [-F.coalesce("retrieval_score", "lexical_score"), span(), F.col("id")]
    apart = written(ranges.drop_overlaps(found, order, ["path"]), "apart")
    blank = {"score": F.lit(None).cast("double"), "contribution": F.lit(None).cast("string"), "scores": F.lit(None).cast(SCORES)}
    if scorer is None:
        passed = judge.unjudged(apart, ["id"], limit).withColumn("scores", F.create_map().cast(SCORES))
        below, skipped, kept_store = passed.limit(0), apart.limit(0), store
        cost = spark.range(1).select(*(F.lit(0).cast("long").alias(c) for c in ("requests", "retries", "input_tokens")), F.lit(0.0).alias("request_ms"))
        shared = spark.range(1).select(F.lit(0).cast("long").alias("shared"))
        counted = apart.withColumns(blank).withColumns({"cached": F.lit(False), "skipped": F.lit(False), "checked": F.lit(False)})
    else:
        short, skipped = judge.split_oversize(apart, "display")
        hits, rest = score_store.lookup(short, store)
        promoted = written(score_store.promote(rest.select("hash", "old_hash").distinct(), store), "promoted")
        known, pending = score_store.lookup(rest, promoted)
        asked = _asked(spark, spec, context, scorer, hits.unionByName(known), pending, threshold, limit, on_partial, rounds)
        too_large = pending.join(asked.filter("answers IS NULL").select("hash"), "hash", "left_semi")
        fresh = written(judge.validated(asked.filter("answers IS NOT NULL"), spec.criteria.mode).select("hash", "score", "contribution", "scores"), "scores")
        hits, skipped = hits.unionByName(known), skipped.unionByName(too_large.select(skipped.columns))
        cost = judge.costs(asked)
        shared = pending.agg((F.count("*") - F.countDistinct("hash")).alias("shared"))
        judged = hits.withColumn("cached", F.lit(True)).unionByName(pending.join(fresh, "hash").withColumn("cached", F.lit(False)))
        judged = written(judged, "judged")
        passed, below = judge.select(judged, threshold, spec.criteria.mode, ["id"], limit)
        new = fresh.withColumn("accessed", F.lit(clock).cast("long")).unionByName(promoted.withColumn("accessed", F.lit(clock).cast("long")))
        kept_store = score_store.upsert(score_store.touched(store, hits, clock), new)
        left_out = skipped.withColumns(blank).withColumns({"cached": F.lit(False), "skipped": F.lit(True), "checked": F.lit(False)})
        counted = judged.withColumns({"skipped": F.lit(False), "checked": F.lit(True)}).unionByName(left_out)
    place = Window.orderBy(*(judge.selection_order(spec.criteria.mode, ["id"]) if scorer else [F.desc("score"), F.col("id")]))  # ``limit`` rows at most
    selected = passed.withColumn("position", (F.row_number().over(place) - 1).cast("long")).withColumn("manual", F.lit(False))
    missing = None
    if entries is not None:
        matched, missing = inclusions.match(entries, _included(passages, entries))
        selected, below = inclusions.apply(selected, below, matched)
    shown = _shown(passages, selected.select("id", "position", "score", "contribution", "scores", "manual"), spec.adjacent)
    counts = judge.run_statistics(counted, threshold)
    more = found.agg(F.count("*").alias("retrieved"), F.coalesce(F.max("truncated"), F.lit(False)).alias("truncated"), F.countDistinct("hash").alias("hashes"))
    extra = {"overlap_removed": F.col("retrieved") - F.col("shortlisted"), "searchable": F.lit(index.n).cast("long"), "window_limit": F.lit(ranking.clamp_candidates(candidates)).cast("long"), "context_chars": F.lit(len(context.encode("utf-16-le")) // 2).cast("long"), "threshold": F.lit(float(threshold))}
    return Answer(shown, below, skipped, missing, kept_store, counts.crossJoin(more).crossJoin(cost).crossJoin(shared).withColumns(extra), found)  # a row each


def _asked(spark: SparkSession, spec: QuerySpec, context: str, scorer: Callable, known: DataFrame, pending: DataFrame, threshold: float, limit: int, on_partial: Callable | None, rounds: int) -> DataFrame:
    """What the scorer says of the pending passages, written; in rounds, if someone listens."""
    if on_partial is None:
        return written(judge.ask(pending, spec.question, spec.criteria, scorer, context), "asked")
    so_far = PartialSelection(spark, fresh_path(spark, "partial"), ["id"], threshold, spec.criteria.mode, limit, on_partial)
    so_far.merge(known, 0)
    parts = []
    for k in range(rounds):
        some = pending.filter(F.pmod(F.xxhash64("hash"), F.lit(rounds)) == k)
        part = written(judge.ask(some, spec.question, spec.criteria, scorer, context), "asked")
        said = judge.validated(part.filter("answers IS NOT NULL"), spec.criteria.mode).select("hash", "score", "contribution")
        so_far.merge(some.join(said, "hash"), k + 1)
        parts.append(part.withColumn("request", F.col("request") * rounds + k))  # each round numbers its own
    return reduce(DataFrame.unionByName, parts)


def _shown(passages: DataFrame, selected: DataFrame, adjacent: int) -> DataFrame:
    """The selection as a reader sees it: widened, and without what is inside an earlier passage."""
    chosen = written(selected, "selected")
    ids = F.broadcast(chosen.select("id").distinct())  # what a reader is shown: a page of them, and inclusions
    own = passages.join(ids, "id", "left_semi")
    if adjacent:
        places = widening.expand(passages, own.select("path", "id"), adjacent)
    else:
        places = own.select("id", "path", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), display_text().alias("text"))
    return ranges.drop_covered(chosen.join(places, "id"), ["path"])
