"""Rubric scoring: batches, an injected scorer, validation, threshold and order.

A scorer is a callable (question, criteria, context, texts) -> list of answers, each a dict
of question name to {"score": number} or {"choice": string}, or a ``Reply`` of these and what
they cost. It runs in the executors, so it must be picklable and give equal answers when a
task is repeated; nothing but the driver writes scores down. What a run cost is counted from
rows that stand beside the answers, not in accumulators, so a repeated task counts once.
"""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.constants import CONTRIBUTIONS, MAX_PASSAGE_CHARS, MAX_REQUESTS, PAGE_ROWS
from passagework.functions.spec import Criteria
from passagework.functions.text import utf16_length
from passagework.operators.numbering import numbered

ANSWERS = "map<string,struct<score:double,choice:string>>"
NAMES = {"generic": ("relevant",), "default": ("definition", "condition", "distinction")}


class Throttled(Exception):
    """The scorer asks to come back later."""


class TooLarge(Exception):
    """The scorer can't take these texts; they count as skipped."""


class Reply(NamedTuple):
    answers: list[dict]
    input_tokens: int = 0


class Gate:
    """How many requests a worker has in flight: half as many after a throttle, at most once
    in ``calm`` seconds, and one more after as many successes as it lets through by then."""

    def __init__(self, most: int, calm: float = 1.0, grow_after: float = 5.0, clock: Callable[[], float] = time.monotonic):
        self.most = self.limit = most
        self.calm, self.grow_after, self.clock = calm, grow_after, clock
        self.running = self.successes = 0
        self.throttled = float("-inf")
        self.free = threading.Condition()

    def __enter__(self) -> Gate:
        with self.free:
            self.free.wait_for(lambda: self.running < self.limit)
            self.running += 1
        return self

    def __exit__(self, kind, *_) -> None:
        with self.free:
            self.running -= 1
            if kind is None and self.clock() - self.throttled >= self.grow_after:
                self.successes += 1
                if self.successes >= self.limit:
                    self.limit, self.successes = min(self.most, self.limit + 1), 0
            self.free.notify_all()

    def throttle(self) -> None:
        with self.free:
            now = self.clock()
            if now - self.throttled >= self.calm:
                self.limit = max(1, self.limit // 2)
            self.throttled, self.successes = now, 0


def rubric(question: str, criteria: Criteria) -> dict[str, dict]:
    """The named questions to ask of a passage."""
    if criteria.mode == "generic":
        ask = criteria.instructions or f"Is there an answer to “{question}” in the passage?"
        return {"relevant": {"type": "score", "ask": ask, "true": criteria.true or "It gives substance on the question.", "false": criteria.false or "It names the topic at most."}}
    sides = {"definition": "say what the subject is", "condition": "state when the subject applies", "distinction": "tell the subject from something near it"}
    out = {k: {"type": "score", "ask": f"On “{question}”: does the passage {v}?", "true": "It does.", "false": "It does not."} for k, v in sides.items()}
    return out | {"contribution": {"type": "choice", "ask": f"What does the passage give to “{question}”?", "choices": list(CONTRIBUTIONS)}}


def with_retries(call: Callable, attempts: int = 4, first_delay: float = 0.25, sleep: Callable = time.sleep, jitter: Callable = random.random, told: Callable[[], None] = lambda: None):
    """``call`` again after each ``Throttled``, waiting twice as long each time, half of it by
    chance; ``told`` hears of each."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Throttled:
                told()
                if k + 1 == attempts:
                    raise
                delay = first_delay * 2**k
                sleep(delay / 2 + jitter() * delay / 2)

    return run


def overlap_scorer(question: str, criteria: Criteria, context: str, texts: list[str]) -> list[dict]:
    """Offline: the share of the question's words that the passage has."""
    asked = set(question.lower().split())
    share = [len(asked & set(t.lower().split())) / max(1, len(asked)) for t in texts]
    if criteria.mode == "generic":
        return [{"relevant": {"score": round(s, 6)}} for s in share]
    return [{**{n: {"score": round(s, 6)} for n in NAMES["default"]}, "contribution": {"choice": "other"}} for s in share]


def split_oversize(candidates: DataFrame, text: str = "shown_text", most: int = MAX_PASSAGE_CHARS) -> tuple[DataFrame, DataFrame]:
    """(those that can be judged, those that are longer in UTF-16 units)."""
    long = utf16_length(text) > most
    return candidates.filter(~long), candidates.filter(long)


def batched(pending: DataFrame, size: int, bucket: list[str], order: list[str]) -> DataFrame:
    """``batch_id`` and ``slot`` within each bucket, whatever the buckets' sizes."""
    return numbered(pending, bucket, order, "nth").withColumn("batch_id", F.floor(F.col("nth") / size).cast("long")).withColumn("slot", (F.col("nth") % size).cast("long")).drop("nth")


ASKED = "hash string, answers string, request long, retries long, request_ms double, input_tokens long"


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each batch_id, which stand together, whatever frames they come in."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for _, part in frame.groupby("batch_id", sort=False):
            if held and held[-1].batch_id.iloc[0] != part.batch_id.iloc[0]:
                yield int(held[0].batch_id.iloc[0]), pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield int(held[0].batch_id.iloc[0]), pd.concat(held)


def _sent(scorer: Callable, gate: Gate, question: str, criteria: Criteria, context: str, texts: list[str]) -> tuple[list[str | None], int, float, int]:
    """Answers as JSON (none of what is too large), retries, milliseconds and tokens of one request."""
    retries = 0

    def again() -> None:
        nonlocal retries
        retries += 1
        gate.throttle()

    with gate:
        began = time.perf_counter()
        try:
            found = with_retries(scorer, told=again)(question, criteria, context, texts)
        except TooLarge:
            return [None] * len(texts), retries, 1000 * (time.perf_counter() - began), 0
        reply = found if isinstance(found, Reply) else Reply(found)
        return [json.dumps(r) for r in reply.answers], retries, 1000 * (time.perf_counter() - began), reply.input_tokens


def ask(pending: DataFrame, question: str, criteria: Criteria, scorer: Callable, context: str = "", size: int = 10, in_flight: int = MAX_REQUESTS, parallel: int = 4) -> DataFrame:
    """hash, answers and the request that gave them: equal hashes are asked once, ``size``
    texts a request, and at most ``in_flight`` requests at a time in ``parallel`` tasks.

    Batches are cut from the hashes in order, so the number of requests is the same
    whatever the tasks. The answers of what the scorer can't take are null.
    """
    width = max(1, in_flight // parallel)

    def run(frames):
        gate = Gate(width)
        with ThreadPoolExecutor(width) as pool:
            waiting = []
            for batch, part in _batches(frames):
                waiting.append((batch, part, pool.submit(_sent, scorer, gate, question, criteria, context, list(part.model_text))))
                if len(waiting) >= 2 * width:
                    yield _rows_of(*waiting.pop(0))
            for one in waiting:
                yield _rows_of(*one)

    once = pending.select("hash", "model_text").dropDuplicates(["hash"])
    dealt = batched(once, size, [], ["hash"]).repartition(parallel, "batch_id").sortWithinPartitions("batch_id", "hash")
    return dealt.mapInPandas(run, ASKED).withColumn("answers", F.from_json("answers", ANSWERS))


def _rows_of(batch: int, part: pd.DataFrame, sent) -> pd.DataFrame:
    answers, retries, took, tokens = sent.result()
    return pd.DataFrame({"hash": list(part["hash"]), "answers": answers, "request": batch, "retries": retries, "request_ms": took, "input_tokens": tokens})


def costs(asked: DataFrame) -> DataFrame:
    """One row of a run's requests, retries, tokens and time, from what ``ask`` gave, written."""
    each = asked.select("request", "retries", "input_tokens", "request_ms").distinct()
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return each.agg(F.count("*").alias("requests"), add("retries"), add("input_tokens"), add("request_ms"))


def split_answers(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Batched answers (keys ``id.name``) by passage; ids that weren't asked about are left out."""
    rows = answers.select(F.explode("answers").alias("k", "v")).filter(F.instr("k", ".") > 1)
    rows = rows.select(F.substring_index("k", ".", 1).alias("id"), F.expr("substring(k, instr(k, '.') + 1)").alias("name"), "v")
    by_id = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("answers"))
    return passages.join(by_id, "id", "left").withColumn("answers", F.coalesce("answers", F.create_map().cast(ANSWERS)))


def validated(answers: DataFrame, mode: str) -> DataFrame:
    """score, contribution and scores from ``answers``; a missing or impossible answer raises."""
    names = NAMES["generic" if mode == "generic" else "default"]

    def checked(name: str) -> Column:
        v = F.try_element_at(F.col("answers"), F.lit(name))["score"]
        good = v.isNotNull() & ~F.isnan(v) & v.between(0, 1)
        return F.when(good, v).otherwise(F.raise_error(F.lit(f"the scorer gave no valid score for {name}")).cast("double"))

    scores = F.create_map(*(x for n in names for x in (F.lit(n), checked(n))))
    choice = F.try_element_at(F.col("answers"), F.lit("contribution"))["choice"]
    known = F.when(choice.isin(*CONTRIBUTIONS), choice).otherwise(F.raise_error(F.lit("the scorer gave no valid contribution")).cast("string"))
    out = answers.withColumn("scores", scores).withColumn("contribution", F.lit("other") if mode == "generic" else known)
    return out.withColumn("score", F.array_max(F.map_values("scores"))).drop("answers")


def contribution_rank(contribution: str = "contribution") -> Column:
    out = F.lit(len(CONTRIBUTIONS))
    for k, name in reversed(list(enumerate(CONTRIBUTIONS))):
        out = F.when(F.col(contribution) == name, k).otherwise(out)
    return out


def selection_order(mode: str, keys: list[str]) -> list[Column]:
    """Definitions, conditions, distinctions, others, then score; or by score alone."""
    return [*([contribution_rank()] if mode != "generic" else []), F.desc("score"), *map(F.col, keys)]


def threshold_split(judged: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(those at or above the threshold, those below)."""
    return judged.filter(F.col("score") >= threshold), judged.filter(F.col("score") < threshold)


def select(judged: DataFrame, threshold: float, mode: str, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` that pass, in order; those below in order of score)."""
    passed, below = threshold_split(judged, threshold)
    return passed.orderBy(*selection_order(mode, keys)).limit(limit), below.orderBy(F.desc("score"), *keys)


def page(below: DataFrame, keys: list[str], offset: int, rows: int = PAGE_ROWS) -> DataFrame:
    return below.orderBy(F.desc("score"), *keys).offset(offset).limit(rows)


def unjudged(candidates: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Without a scorer: retrieval order, no threshold, every contribution ``other``."""
    score = F.coalesce("retrieval_score", "lexical_score")
    return candidates.withColumn("score", score).withColumn("contribution", F.lit("other")).orderBy(F.desc("score"), *keys).limit(limit)


def run_statistics(judged: DataFrame, threshold: float) -> DataFrame:
    """One row of counts over a run's rows (score, cached, skipped, and ``checked`` where
    not all others were judged)."""
    seen = F.col("checked") if "checked" in judged.columns else ~F.col("skipped")
    return judged.agg(
        F.count("*").alias("shortlisted"), F.count_if(F.col("skipped")).alias("skipped"), F.count_if(seen).alias("checked"),
        F.count_if(seen & F.col("cached")).alias("cached"), F.count_if(seen & ~F.col("cached")).alias("requested"),
        F.count_if(seen & (F.col("score") >= threshold)).alias("passed"),
    )
