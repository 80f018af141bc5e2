"""Files that must be as they were published: weights and vocabularies by size and digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OK, MISSING, SIZE, DIGEST = "ok", "missing", "another size", "another digest"


def check_assets(spark: SparkSession, root: str, expected: dict[str, tuple[int, str]]) -> DataFrame:
    """name, status of each expected file (bytes, SHA-256) below ``root``. Sizes come from
    the listing; only files of the right size are read, each by one task."""
    wanted = spark.createDataFrame([(n, *x) for n, x in expected.items()], "name string, bytes long, sha256 string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    listed = files.select(F.substring_index("path", base, -1).alias("name"), F.col("length"))
    sized = wanted.join(listed, "name", "left")
    right = sized.filter("length = bytes").select("name").collect()  # the names that the caller has given
    digests = files.select(F.substring_index("path", base, -1).alias("name"), F.sha2("content", 256).alias("found")).filter(F.col("name").isin([r.name for r in right]))
    status = F.when(F.col("length").isNull(), MISSING).when(F.col("length") != F.col("bytes"), SIZE).when(F.col("found") != F.col("sha256"), DIGEST).otherwise(OK)
    return sized.join(digests, "name", "left").select("name", status.alias("status"))


def require_assets(spark: SparkSession, root: str, expected: dict[str, tuple[int, str]]) -> None:
    """Raise unless every file is as expected."""
    wrong = check_assets(spark, root, expected).filter(F.col("status") != OK).orderBy("name").collect()
    if wrong:
        raise ValueError(", ".join(f"{r.name}: {r.status}" for r in wrong))
