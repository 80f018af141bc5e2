"""The stream of versions: a batch each, in no single file."""

from pyspark.sql import functions as F

from passagework.plans import note_queries
from passagework.plans.queries import load
from passagework.streaming.live import run_to_end

SF = "/root/testdata/sf0.001"


def test_a_version_is_a_batch_of_several_files(spark, tmp_path):
    load(spark, SF, "documents").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    seen, at = [], f"file://{tmp_path}/checkpoint"

    def batch(df, n):
        seen.append((n, df.select(F.input_file_name()).distinct().count(), df.select("version").distinct().collect()))

    note_queries.follow_versions(spark, str(tmp_path), lambda stream: run_to_end(stream, batch, checkpoint=at))
    assert [(n, [r.version for r in v]) for n, _, v in seen] == [(0, [0]), (1, [1]), (2, [2])]
    assert all(files > 1 for _, files, _ in seen)
