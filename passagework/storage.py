"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A local session without it gets a temporary folder; on a
    cluster, whose executors wouldn't see one, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='passagework-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and a lost executor costs a
    re-read only."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, path: str, complete: bool = False) -> list[str]:
    """Names of the folders in ``path``; or just of those whose write has ended."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(make(path)):
        return []
    done = lambda at: not complete or files.exists(make(at, "_SUCCESS"))
    return [x.getPath().getName() for x in files.listStatus(make(path)) if x.isDirectory() and done(x.getPath())]


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    return folders(spark, path, complete=True)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _local(path: str) -> str | None:
    """A path of this machine or of a mount, or None of another store's."""
    scheme, mark, rest = path.partition("://")
    return path.removeprefix("file:") if not mark else rest if scheme == "file" else None


def store_of(path: str) -> tuple[FileSystem, str]:
    """The store that a path is in, and its path there, as a task reaches it without the JVM."""
    own = _local(path)
    return FileSystem.from_uri(path) if own is None else (LocalFileSystem(), own)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, line ends as they are; None without the file."""
    if (own := _local(path)) is not None:
        if not os.path.exists(own):
            return None
        with open(own, encoding="utf-8", newline="") as f:
            return f.read()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return None
    stream = files.open(hadoop)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one; whether it was written."""
    if (own := _local(path)) is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        try:
            with open(own, "x", encoding="utf-8", newline="") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(hadoop):
        return False
    stream = files.create(hadoop, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file's new text in its place in one step."""
    if (own := _local(path)) is not None:
        with open(f"{own}.new", "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(f"{own}.new", own)
        return
    make = spark._jvm.org.apache.hadoop.fs.Path
    remove(spark, f"{path}.new")
    create_text(spark, f"{path}.new", text)
    overwrite = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    how = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = overwrite
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(path).toUri(), spark._jsc.hadoopConfiguration()).rename(make(f"{path}.new"), make(path), how)
