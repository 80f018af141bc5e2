"""A keyword index that follows edits, as immutable segments and tombstones.

Each batch of changes becomes a segment of its own: the tokens, postings and term counts of
its new texts, and nothing else is written again. A passage that the batch replaces or
deletes stays where it is; a tombstone names it and its segment, beside the terms that it
no longer counts for, so document frequencies and lengths are those of a rebuild. A reader
takes the segments of the newest commit, leaves out what tombstones name, and so sees one
state however many batches come after.

``FANOUT`` segments of about one size are merged into one, and all of them once half of what
they hold is dead; so a passage is written again log(n) times, and there are fewer than
``FANOUT`` segments for each size. Commits are numbered by batch and written last: one that
is cut off leaves nothing that is read, and a batch that comes again changes nothing. What
the last two commits don't have is removed before the next batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators.index import PUSHED_TERMS, Index, counts_of, postings_of, write_postings, write_tokens
from passagework.storage import complete_folders, folders, remove, written
from passagework.streaming.live import latest

FANOUT = 4
#: A batch of more passages finds what it replaces by a shuffle of the older ones' words.
BROADCAST_KEYS = 1_000_000
COMMIT = "segment string, n long, total long, dead_n long, dead_total long, tombs array<long>"


class SegmentedIndex:
    """The index of (keys, text) under ``path``, kept by one writer.

    ``order`` are the columns that tell which of a batch's rows of one key is the last; a
    batch has the keys, these, ``op`` (``delete`` or another) and ``text``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], text: str = "text", fanout: int = FANOUT):
        self.spark, self.path, self.keys, self.order, self.text, self.fanout = spark, path.rstrip("/"), keys, order, text, fanout

    # What is there.

    def _commits(self) -> list[tuple[int, int]]:
        """The batch and the number of merges after it of each commit, in order."""
        names = [n for n in complete_folders(self.spark, self.path) if n.startswith("commit-")]
        return sorted(tuple(map(int, n.split("-")[1:])) for n in names)

    def _segments(self, commit: tuple[int, int] | None = None) -> list:
        """Name, counts and batches of tombstones of each segment: a few for each size."""
        commit = commit or max(self._commits(), default=None)
        return self.spark.read.schema(COMMIT).parquet(f"{self.path}/commit-{commit[0]}-{commit[1]}").orderBy("segment").collect() if commit else []

    def _union(self, names: list[str], table: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/{s}/{table}").withColumn("segment", F.lit(s)) for s in names))

    def _tombstones(self, segments: list, table: str) -> DataFrame | None:
        """Rows of ``dead`` or ``dead_terms`` about the given segments."""
        batches = sorted({b for s in segments for b in s.tombs})
        parts = [self.spark.read.parquet(f"{self.path}/tomb-{b}/{table}") for b in batches]
        return reduce(DataFrame.unionByName, parts).filter(F.col("segment").isin([s.segment for s in segments])) if parts else None

    def _alive(self, names: list[str], table: str, dead: DataFrame | None) -> DataFrame:
        rows = self._union(names, table)
        return rows if dead is None else rows.join(dead, ["segment", *self.keys], "left_anti")

    def index(self) -> Index | None:
        """What the last commit has, to be asked; None before the first."""
        segments = self._segments()
        if not segments:
            return None
        names = [s.segment for s in segments]
        dead, gone = self._tombstones(segments, "dead"), self._tombstones(segments, "dead_terms")
        terms = self._union(names, "terms").select("term", "df")
        if gone is not None:
            terms = terms.unionByName(gone.select("term", (-F.col("df")).alias("df")))
        terms = terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        n, total = (sum(getattr(s, c) - getattr(s, f"dead_{c}") for s in segments) for c in ("n", "total"))
        postings = self._alive(names, "postings", dead).drop("segment")
        return Index(tuple(self.keys), postings, self._alive(names, "tokens", dead).select(*self.keys, "fp"), terms, n, total)

    def killed(self, batch: int) -> DataFrame | None:
        """segment and keys of the passages that a batch replaced or deleted, while its
        commit is one of the last two; None if there was nothing before."""
        return self.spark.read.parquet(f"{self.path}/tomb-{batch}/dead") if "dead" in complete_folders(self.spark, f"{self.path}/tomb-{batch}") else None

    # Changes.

    def _touched(self, keys: DataFrame) -> Column | None:
        """Few keys, by their first column, as a condition that is pushed to the scans."""
        few = keys.select(self.keys[0]).distinct().limit(PUSHED_TERMS + 1).collect()
        return F.col(self.keys[0]).isin([r[0] for r in few]) if len(few) <= PUSHED_TERMS else None

    def apply(self, changes: DataFrame, batch: int | None = None) -> None:
        """Take in a batch; without a number it is the next one. Reads the texts of the batch
        only, and of older segments what the batch's keys have there."""
        commits = self._commits()
        last = commits[-1][0] if commits else -1
        batch = last + 1 if batch is None else batch
        if batch <= last:
            return
        self._vacuum(commits[-2:])
        rows = written(latest(changes.select(*self.keys, *self.order, "op", self.text), list(self.keys), self.order), "changes")
        before = self._segments()
        after = {s.segment: s.asDict() for s in before}
        keys = rows.select(*self.keys)
        if before:
            old = self._alive(list(after), "tokens", self._tombstones(before, "dead"))
            where = self._touched(keys)
            if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:  # else all that is there would be shuffled with its words
                keys = F.broadcast(keys)
            found = (old.filter(where) if where is not None else old).join(keys, list(self.keys), "left_semi")
            killed = written(found.select("segment", *self.keys, "len", "runs"), "killed")
            killed.select("segment", *self.keys).write.parquet(f"{self.path}/tomb-{batch}/dead")
            each = killed.select("segment", F.explode("runs.term").alias("term"))
            each.groupBy("segment", "term").agg(F.count("*").alias("df")).write.parquet(f"{self.path}/tomb-{batch}/dead_terms")
            for r in killed.groupBy("segment").agg(F.count("*").alias("n"), F.sum("len").alias("total")).collect():
                s = after[r.segment]
                s |= {"dead_n": s["dead_n"] + r.n, "dead_total": s["dead_total"] + r.total, "tombs": [*s["tombs"], batch]}
        tokenised = write_tokens(rows.filter("op <> 'delete'"), self.keys, self.text, f"{self.path}/seg-{batch}/tokens")
        n, total = counts_of(tokenised)
        if n:
            write_postings(postings_of(tokenised, self.keys), f"{self.path}/seg-{batch}")
            after[f"seg-{batch}"] = self._row(f"seg-{batch}", n, total)
        self._commit(batch, 0, after)
        self._merge(batch)

    @staticmethod
    def _row(name: str, n: int, total: int) -> dict:
        return {"segment": name, "n": n, "total": total, "dead_n": 0, "dead_total": 0, "tombs": []}

    def _vacuum(self, kept: list[tuple[int, int]]) -> None:
        """Remove what no kept commit has, also what a batch that was cut off has left."""
        rows = [s for c in kept for s in self._segments(c)]
        names = {s.segment for s in rows} | {f"tomb-{b}" for s in rows for b in s.tombs} | {f"commit-{b}-{k}" for b, k in kept}
        for n in folders(self.spark, self.path):
            if n not in names:
                remove(self.spark, f"{self.path}/{n}")

    def _commit(self, batch: int, merges: int, segments: dict) -> None:
        rows = [tuple(s[c.split()[0]] for c in COMMIT.split(", ")) for s in segments.values()]
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.parquet(f"{self.path}/commit-{batch}-{merges}")

    def _tier(self, n: int) -> int:
        tier = 0
        while n >= self.fanout:
            n, tier = n // self.fanout, tier + 1
        return tier

    def _chosen(self, segments: list) -> list:
        """The segments to merge now, if any."""
        if len(segments) > 1 and 2 * sum(s.dead_n for s in segments) > sum(s.n for s in segments):
            return segments
        tiers: dict[int, list] = {}
        for s in segments:
            tiers.setdefault(self._tier(s.n - s.dead_n), []).append(s)
        return next((some for _, some in sorted(tiers.items()) if len(some) >= self.fanout), [])

    def _merge(self, batch: int) -> None:
        """Each merge is a commit of the same batch: it holds what was there."""
        merges = 0
        while some := self._chosen(segments := self._segments()):
            merges += 1
            names, dead, name = [s.segment for s in some], self._tombstones(some, "dead"), f"seg-{batch}-{merges}"
            self._alive(names, "tokens", dead).drop("segment").write.parquet(f"{self.path}/{name}/tokens")
            n, total = counts_of(self.spark.read.parquet(f"{self.path}/{name}/tokens"))
            kept = {s.segment: s.asDict() for s in segments if s.segment not in names}
            if n:
                write_postings(self._alive(names, "postings", dead).drop("segment"), f"{self.path}/{name}")
                kept[name] = self._row(name, n, total)
            self._commit(batch, merges, kept)
