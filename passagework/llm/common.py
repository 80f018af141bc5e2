"""Shared helpers: text columns, Arrow batches and the shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.storage import fresh_path

#: Bytes of text that one worker handles at a time; larger Arrow batches are sliced.
CHUNK_BYTES = 4_000_000


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A written table outlives any executor, so a lost one costs a re-read only.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for df in tables:
        jvm, files = df.sparkSession._jvm, df.inputFiles()
        if files:
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Only the id and the text, a null text as the empty one, and with ``carry`` the whole
    row as the struct ``row``.

    Extra columns are pruned or inside the struct, so none can clash with an operator's own.
    """
    row = [F.struct("*").alias("row")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row)


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of one column, or of one row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        sizes = batch.column(column).nbytes
        if sizes <= limit:
            yield batch
            continue
        x = batch.column(column)
        sizes = pc.multiply(pc.list_value_length(x), 8) if pa.types.is_list(x.type) else pc.binary_length(x)
        start = taken = 0
        for i, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
            if i > start and taken + n > limit:
                yield batch.slice(start, i - start)
                start, taken = i, 0
            taken += n
        yield batch.slice(start)
