"""Standing questions: the best passages of many questions, kept while passages change.

Scores use the statistics (number of passages, average length, document frequencies) of an
epoch, the first batch or the last ``rebase``. So a passage's score for a question doesn't
depend on other passages, and a batch is worked off by itself: its new texts are in an index
segment of their own, whose postings meet the questions' terms; its replaced and deleted
passages are in the segment's tombstones. A question whose terms are in neither isn't touched.

A question's state is its first ``k`` passages and whether there are more. What ranks before
the old last one is known to be right; only a question that lost passages, has more, and
didn't get enough better ones is asked anew, over the whole index. State and index lie in the
shared folder: a restart goes on, and a batch that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.operators.index import Index
from passagework.operators.ranking import question_terms
from passagework.operators.segments import SegmentedIndex
from passagework.storage import complete_folders, written
from passagework.streaming.live import LiveSnapshot, run_to_end


class StandingQuestions:
    """The first ``k`` passages by score, then key, of questions (qid, question) over a
    stream of changes (keys, ``order``, op, text). ``questions`` are taken when ``path`` is new."""

    def __init__(self, spark: SparkSession, path: str, questions: DataFrame, k: int, keys: list[str], order: list[str], text: str = "text"):
        self.spark, self.path, self.k, self.keys = spark, path.rstrip("/"), k, keys
        self.index = SegmentedIndex(spark, f"{self.path}/index", keys, order, text)
        self.state = LiveSnapshot(spark, "qid", ["batch"], path=f"{self.path}/state")
        if "terms" not in complete_folders(spark, self.path):
            asked = question_terms(questions)
            questions.select("qid").distinct().join(asked, "qid", "left").write.mode("overwrite").parquet(f"{self.path}/terms")
        self.questions = spark.read.parquet(f"{self.path}/terms")  # qid, term; a null term where a question has none

    # Statistics.

    def _epochs(self) -> list[int]:
        return sorted(int(n.partition("-")[2]) for n in complete_folders(self.spark, self.path) if n.startswith("epoch-"))

    def _set_epoch(self, batch: int) -> None:
        """The questions' terms with their document frequencies now (0 if there are none)."""
        now = self.index.index()
        terms = self.questions.select("term").filter("term IS NOT NULL").distinct()
        found = terms.join(now.terms, "term", "left") if now else terms.withColumn("df", F.lit(0))
        counts = (now.n, now.total) if now else (0, 0)
        found.select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"), F.lit(counts[0]).cast("long").alias("n"), F.lit(counts[1]).cast("long").alias("total")).write.mode("overwrite").parquet(f"{self.path}/epoch-{batch}")

    def _asked(self, postings: DataFrame, questions: DataFrame, most: int) -> DataFrame:
        """qid, item, nth of the first ``most`` passages of each question, scored by the epoch."""
        epoch = self.spark.read.parquet(f"{self.path}/epoch-{self._epochs()[-1]}")
        row = epoch.select("n", "total").first()
        index = Index(tuple(self.keys), postings, postings, epoch.select("term", "df"), row.n if row else 0, row.total if row else 0)
        scored = index.bm25(questions.filter("term IS NOT NULL").select("qid", "term"))
        nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("lexical_score"), *self.keys))
        return scored.withColumn("nth", nth).filter(F.col("nth") <= most).select("qid", self._item(), "nth")

    def _item(self):
        return F.struct((-F.col("lexical_score")).alias("loss"), *self.keys).alias("item")

    # Batches.

    def merge(self, changes: DataFrame, batch: int) -> None:
        """Take in a batch; one that is in the state already changes nothing."""
        self.index.apply(changes, batch)
        seen = self.state._parts()
        if self.index.index() is None or batch <= max([-1, *seen[0], *seen[1]]):  # nothing to ask yet, or nothing new
            return
        if not self._epochs():
            self._set_epoch(batch)
        self.state.merge(self._all(batch) if batch == self._epochs()[-1] else self._changed(batch), batch)

    def rebase(self) -> None:
        """Take the statistics as they are now and ask all questions with them."""
        last = self.index._commits()[-1][0]
        self._set_epoch(last)
        self.state.merge(self._all(last).withColumn("batch", F.lit(last + 0.5)), last)

    def _lists(self, items: DataFrame, batch: int) -> DataFrame:
        """State rows from (qid, item) with as many items as are known, ``k`` + 1 if there are more."""
        grouped = items.groupBy("qid").agg(F.array_sort(F.collect_list("item")).alias("items"))
        return grouped.select("qid", F.lit(float(batch)).alias("batch"), F.lit("upsert").alias("op"), F.slice("items", 1, self.k).alias("items"), (F.size("items") > self.k).alias("more"))

    def _all(self, batch: int) -> DataFrame:
        live, every = self.index.index(), self.questions.select("qid").distinct()
        return self._padded(self._lists(self._asked(live.postings, self.questions, self.k + 1), batch), every, batch)

    def _padded(self, lists: DataFrame, every: DataFrame, batch: int) -> DataFrame:
        """A list for each of ``every``, an empty one where nothing was found."""
        joined = every.join(lists, "qid", "left")
        empty = F.array().cast(lists.schema["items"].dataType)
        return joined.select("qid", F.lit(float(batch)).alias("batch"), F.lit("upsert").alias("op"), F.coalesce("items", empty).alias("items"), F.coalesce("more", F.lit(False)).alias("more"))

    def _changed(self, batch: int) -> DataFrame:
        """New lists of the questions that the batch's segment or tombstones touch."""
        state = self.state.rows()
        folders = complete_folders(self.spark, f"{self.index.path}/seg-{batch}")
        fresh = self._asked(self.spark.read.parquet(f"{self.index.path}/seg-{batch}/postings"), self.questions, self.k + 1).select("qid", "item") if "postings" in folders else None
        old = state.select("qid", F.explode("items").alias("item"))
        gone = self.index.killed(batch)
        lost = old.filter("false") if gone is None else old.join(gone.select(*(F.col(c).alias(f"k_{c}") for c in self.keys)), [F.col("item")[c] == F.col(f"k_{c}") for c in self.keys], "left_semi")
        touched = lost.select("qid") if fresh is None else lost.select("qid").unionByName(fresh.select("qid"))
        touched = written(touched.distinct(), "touched")
        kept = old.join(touched, "qid", "left_semi")
        kept = kept if gone is None else kept.join(gone.select(*(F.col(c).alias(f"k_{c}") for c in self.keys)), [F.col("item")[c] == F.col(f"k_{c}") for c in self.keys], "left_anti")
        rows = kept if fresh is None else kept.unionByName(fresh)
        before = state.join(touched, "qid", "left_semi").select("qid", "more", F.try_element_at("items", F.lit(-1)).alias("last"))
        both = before.join(rows.groupBy("qid").agg(F.array_sort(F.collect_list("item")).alias("found")), "qid", "left")
        both = both.withColumn("found", F.coalesce("found", F.array().cast(state.schema["items"].dataType)))
        sure = F.filter("found", lambda x: ~F.col("more") | (x <= F.col("last")))
        tried = written(both.withColumn("sure", sure).withColumn("again", F.col("more") & (F.size("sure") < self.k)), "tried")
        done = tried.filter(~F.col("again")).select("qid", F.lit(float(batch)).alias("batch"), F.lit("upsert").alias("op"), F.slice("sure", 1, self.k).alias("items"), (F.col("more") | (F.size("found") > self.k)).alias("more"))
        again = tried.filter("again").select("qid")
        if again.isEmpty():
            return done
        refilled = self._asked(self.index.index().postings, self.questions.join(again, "qid", "left_semi"), self.k + 1)
        return done.unionByName(self._padded(self._lists(refilled, batch), again, batch))

    def follow(self, stream: DataFrame) -> None:
        """Take in all that the stream has and this hasn't."""
        run_to_end(stream, self.merge, checkpoint=f"{self.path}/_stream")

    def changed(self, batch: int) -> DataFrame:
        """qid of the questions whose lists a batch wrote: what a reader refreshes."""
        return self.state.rows().filter(F.floor("batch") == batch).select("qid")

    def results(self) -> DataFrame:
        """qid, rank from 1, keys, lexical_score."""
        rows = self.state.rows().select("qid", F.posexplode("items").alias("at", "item"))
        return rows.select("qid", (F.col("at") + 1).cast("long").alias("rank"), *(F.col("item")[c].alias(c) for c in self.keys), (-F.col("item")["loss"]).alias("lexical_score"))
