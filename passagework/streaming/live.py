"""Change feeds: debounced events, latest versions, and a snapshot that follows them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagework.storage import complete_folders, fresh_path, remove


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, file or folder, as a stream of its rows."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", name).parquet(folder)


def debounced(events: DataFrame, key: str, at: str, quiet: str) -> DataFrame:
    """key, first_at, last_at, n per burst: events of a key follow each other in less than ``quiet``."""
    bursts = events.groupBy(key, F.session_window(at, quiet).alias("w")).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))
    return bursts.drop("w")


def latest(changes: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The last change of each key; a stale one never replaces a later one."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = F.struct(*order, *(c for c in changes.columns if c not in (*keys, *order)))
    return changes.groupBy(*keys).agg(F.max(rows).alias("row")).select(*keys, "row.*").select(changes.columns)


def run_to_end(stream: DataFrame, batch: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Feed all that is there to ``batch``, and wait. With a ``checkpoint`` of its own, a
    later run goes on where this one ended."""
    at = checkpoint or fresh_path(stream.sparkSession, "stream")
    q = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()


def collect_table(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has said at its end, as a written table: each batch is a folder, so a
    batch that is replayed replaces itself."""
    spark = stream.sparkSession
    base, done = fresh_path(spark, "stream-result"), {}

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/{n}")
        done[n] = f"{base}/{n}"

    run_to_end(stream, keep, mode)
    paths = list(done.values())
    return spark.read.schema(stream.schema).parquet(*paths[-1:] if mode == "complete" else paths) if paths else spark.createDataFrame([], stream.schema)


class LiveSnapshot:
    """The latest row of each key over all batches; ``op`` ``delete`` is a tombstone that
    outlives the row, so that an older write can't bring it back.

    A batch is written alone, as ``delta-<batch>``; after every ``compact`` deltas they
    are folded into ``base-<batch>``. A reader takes the newest base and the deltas after
    it, at most ``compact`` of them. With a ``path``, the snapshot outlives the process:
    what is there is found again, and ``follow`` keeps the stream's place beside it. A
    batch that comes again replaces itself, or is left out if it is in the base already.
    A fold removes what the base before last held, so a reader may go on during one fold.
    """

    def __init__(self, spark: SparkSession, key: str, order: list[str], on_change: Callable[[DataFrame], None] | None = None, path: str | None = None, compact: int = 16, schema: StructType | str | None = None):
        self.spark, self.key, self.order, self.on_change, self.compact, self.schema = spark, key, order, on_change, compact, schema
        self.path = path or fresh_path(spark, "snapshot")

    def _parts(self) -> tuple[dict[int, str], dict[int, str]]:
        names = complete_folders(self.spark, self.path)
        return tuple({int(n.partition("-")[2]): n for n in names if n.startswith(kind)} for kind in ("base-", "delta-"))

    def _current(self) -> list[str]:
        bases, deltas = self._parts()
        last = max(bases, default=-1)
        return ([bases[last]] if bases else []) + [deltas[n] for n in sorted(deltas) if n > last]

    def _read(self) -> DataFrame | None:
        names = self._current()
        return latest(self.spark.read.parquet(*(f"{self.path}/{n}" for n in names)), self.key, self.order) if names else None

    def merge(self, changes: DataFrame, batch: int | None = None) -> None:
        """Take in a batch; without a number it is the next one."""
        bases, deltas = self._parts()
        last = max(bases, default=-1)
        batch = max([last, *deltas]) + 1 if batch is None else batch
        if batch > last:
            latest(changes, self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/delta-{batch}")
            if len([n for n in deltas if n > last and n != batch]) + 1 >= self.compact:
                self._fold(bases, deltas)
        if self.on_change:
            self.on_change(self.rows())

    def _fold(self, bases: dict[int, str], deltas: dict[int, str]) -> None:
        newest = max(self._parts()[1])
        self._read().write.mode("overwrite").parquet(f"{self.path}/base-{newest}")
        last = max(bases, default=-1)
        for n, name in [*bases.items(), *deltas.items()]:
            if n < last or n == last and name.startswith("delta-"):
                remove(self.spark, f"{self.path}/{name}")

    def follow(self, stream: DataFrame) -> None:
        """Take in all that the stream has and this snapshot hasn't."""
        self.schema = self.schema or stream.schema
        run_to_end(stream, self.merge, checkpoint=f"{self.path}/_stream")

    def rows(self) -> DataFrame:
        """What is there now; before the first batch nothing, with ``schema``'s columns."""
        found = self._read()
        if found is None:
            return self.spark.createDataFrame([], self.schema or f"{self.key} string").drop("op")
        return found.filter("op <> 'delete'").drop("op")
