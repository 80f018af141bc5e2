"""Notes from folders of Markdown files, the difference between two snapshots, and a folder
as a source of changes."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyarrow.fs import FileType
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import excluded, has_question_fence
from passagework.storage import complete_folders, remove, store_of, written

#: Up to this many changed files are read by their names; more by a scan of the folder.
NAMED_FILES = 10_000
#: What opening a note costs, in bytes read meanwhile: Spark's own 4 MB would give a task few notes.
NOTE_COST = "32k"


def _below(file_path: Column, root: str) -> Column:
    """A file's path below the folder, as it is on disk."""
    inside = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    return F.substring_index(inside, root.split("://")[-1].removeprefix("file:").rstrip("/") + "/", -1)


def read_notes(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """path (below ``root``), mtime, text of every note that isn't excluded; the exclusion is
    a condition on file names, so it stands before any parsing."""
    df = spark.read.text(root, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    rows = df.select(_below(F.col("_metadata.file_path"), root).alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"))
    return rows.filter(~excluded("path", exclude or []))


def write_notes(notes: DataFrame, root: str) -> None:
    """A file below ``root`` for each (path, text), without a text an empty one. The tasks that
    hold the rows write them; a note gets its new text in one step, so a task may run again."""

    def put(rows: Iterable[Row]) -> None:
        files, base = store_of(root)
        made = set()
        for r in rows:
            at = f"{base}/{r.path}"
            folder = at.rpartition("/")[0]
            if folder not in made:
                files.create_dir(folder)
                made.add(folder)
            new = f"{at}.{uuid.uuid4().hex}.new"
            with files.open_output_stream(new) as out:
                out.write(r.data or b"")
            files.move(new, at)

    notes.select("path", F.col("text").cast("binary").alias("data")).foreachPartition(put)


def remove_notes(notes: DataFrame, root: str) -> None:
    """Delete the files of these (path) below ``root``, by the tasks that hold the rows."""

    def drop(rows: Iterable[Row]) -> None:
        files, base = store_of(root)
        for r in rows:
            if files.get_file_info(f"{base}/{r.path}").type == FileType.File:
                files.delete_file(f"{base}/{r.path}")

    notes.select("path").foreachPartition(drop)


def searchable(passages: DataFrame) -> DataFrame:
    """Passages without an opening fence of a question."""
    return passages.filter(~has_question_fence("text"))


def difference(indexed: DataFrame, current: DataFrame, key: str = "id", content: str = "content_hash") -> DataFrame:
    """key, change: ``removed``, ``added`` or ``changed``, by content."""
    old = indexed.select(key, F.col(content).alias("was"))
    new = current.select(key, F.col(content).alias("now"))
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return old.join(new, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


class NoteFolder:
    """A folder of notes as a stream of changes, kept under ``path``.

    A poll lists the folder (names, times and sizes, by Spark's own readers, so it may be in
    any store), writes the listing, and compares it with the one before: what is new or has
    another time or size is read and comes as ``upsert``, what is gone or excluded now as
    ``delete``; a renamed note is both. The consumer gets these rows with the listing's
    number and must take a number twice; only then the listing is marked as done. So a
    crash at any point gives the same batch again. A file that changed or vanished between the
    listing and the read is left out: the next listing has it as a change. Folders are listed
    and notes read many to a task, also by what the consumer reads meanwhile in this session.
    """

    def __init__(self, spark: SparkSession, root: str, path: str, exclude: Callable[[], list[str]] = list, pattern: str = "*.md", name: Callable[[Column], Column] | None = None):
        self.spark, self.root, self.path = spark, root.rstrip("/"), path.rstrip("/")
        self.exclude, self.pattern, self.name = exclude, pattern, name or (lambda below: below)

    def _number(self, kind: str) -> int:
        return max((int(n.rpartition("-")[2]) for n in complete_folders(self.spark, self.path) if n.startswith(f"{kind}-")), default=-1)

    @contextmanager
    def _small_files(self) -> Iterator[None]:
        """For a poll the session's reads take many small files to a task, list many folders in
        one and keep no listing for later; these are no options of a read."""
        conf = self.spark.conf
        ours = {"spark.sql.files.openCostInBytes": NOTE_COST, "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * self.spark.sparkContext.defaultParallelism), "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
        before = {k: conf.get(k) for k in ours}
        try:
            for k, v in ours.items():
                conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                conf.set(k, v)

    def _list(self, to: str) -> None:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", self.pattern).option("recursiveFileLookup", "true").load(self.root)
        rows = files.select(F.col("path").alias("file"), F.col("_metadata.file_path").alias("at"), self.name(_below(F.col("_metadata.file_path"), self.root)).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
        rows.filter(~excluded("path", self.exclude())).write.mode("overwrite").parquet(to)

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """path, text of the wanted files, if they are still as listed. A scan of the folder
        opens no file that is older than all of these."""
        few = [r.file for r in wanted.select("file").limit(NAMED_FILES + 1).collect()]
        named = 0 < len(few) <= NAMED_FILES and not any(re.search(r"[*?\[\]{}\\]", f) for f in few)  # these would be patterns
        reader = self.spark.read.format("binaryFile").option("ignoreMissingFiles", "true")  # whole text is read under a lock of its worker
        whole = lambda: reader.load(self.root, pathGlobFilter=self.pattern, recursiveFileLookup=True)
        folder = lambda: whole().filter(F.col("_metadata.file_modification_time") >= F.lit(wanted.agg(F.min("mtime")).first()[0]))
        try:
            read = reader.load(few) if named else folder()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            read = folder()  # one of them is gone since the listing
        seen = read.select(F.col("_metadata.file_path").alias("at"), F.col("modificationTime").alias("read_mtime"), F.col("length").alias("read_size"), F.col("content").cast("string").alias("text"))
        return wanted.join(seen, "at").filter("mtime = read_mtime AND size = read_size").select("path", "text")

    def poll(self, merge: Callable[[DataFrame, int], None]) -> int:
        """List, compare and hand over (path, version, op, text) with the listing's number;
        returns it. Rows of one poll have one version, which grows."""
        with self._small_files():
            number = self._poll(merge)
        gc.collect()  # what py4j held in cycles: the driver would keep this poll's listings through the next
        return number

    def _poll(self, merge: Callable[[DataFrame, int], None]) -> int:
        done, listed = self._number("done"), self._number("listing")
        number = done + 1
        at = lambda kind, n: f"{self.path}/{kind}-{n}"
        if listed < number:
            self._list(at("listing", number))
            gc.collect()
        now = self.spark.read.parquet(at("listing", number))
        before = self.spark.read.parquet(at("listing", done)) if done >= 0 else now.filter("false")
        both = now.join(before.select("path", F.col("mtime").alias("was"), F.col("size").alias("was_size")), "path", "full_outer")
        changed = written(both.filter("mtime IS NULL OR was IS NULL OR mtime != was OR size != was_size"), "changed")
        version = F.lit(number).cast("long").alias("version")
        gone = changed.filter("mtime IS NULL").select("path", version, F.lit("delete").alias("op"), F.lit(None).cast("string").alias("text"))
        new = changed.filter("mtime IS NOT NULL")
        rows = gone if new.isEmpty() else gone.unionByName(self._texts(new).select("path", version, F.lit("upsert").alias("op"), "text"))
        merge(rows, number)
        self.spark.range(0).write.mode("overwrite").parquet(at("done", number))
        for n in range(max(0, done - 1), done):  # the one before the last is needed no more
            remove(self.spark, at("listing", n))
            remove(self.spark, at("done", n))
        return number
