"""The line sink: no second copy, no half file."""

import os

import pytest
from pyspark.sql import functions as F

from fleetlens.sources import linesink


@pytest.fixture(autouse=True)
def registered(spark):
    spark.dataSource.register(linesink.LineSink)


def lines(spark, path):
    return sorted(r["value"] for r in spark.read.text(f"{path}/part-*.txt").collect())


def test_batches_are_appended(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).repartition(5).select(F.concat(F.lit("a v="), F.col("id")).alias("line"))
    for _ in range(2):
        df.write.format("line_sink").mode("append").save(path)
    assert lines(spark, path) == sorted([f"a v={i}" for i in range(100)] * 2)
    assert os.listdir(f"{path}/_pending") == [] and len(os.listdir(f"{path}/_manifest")) == 2
    with pytest.raises(Exception, match="appends"):
        df.write.format("line_sink").mode("overwrite").save(path)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("line_sink").mode("append").save(path)
    found = [f for _, _, files in os.walk(path) for f in files if not f.endswith(".crc")]
    assert [f for f in found if f.startswith("part-")] == []


def test_an_attempt_that_is_not_reported_does_not_count(tmp_path):
    """Two attempts of one task, as after a lost executor: only the reported one is kept."""
    path = str(tmp_path / "out")
    writer = linesink.BatchWriter(path, "job")
    lost, kept = writer.write(iter([("x 1",), ("x 2",)])), writer.write(iter([("x 1",), ("x 2",), (None,)]))
    assert lost.file != kept.file
    writer.commit([kept, None])
    assert sorted(os.listdir(path)) == ["_manifest", "_pending", "part-job-00000.txt"] and os.listdir(f"{path}/_pending") == []
    assert open(f"{path}/part-job-00000.txt").read() == "x 1\nx 2\n"


def test_a_repeated_micro_batch_is_thrown_away(spark, tmp_path):
    path = str(tmp_path / "out")
    writer = linesink.StreamWriter(path, "s")
    for _ in range(2):
        writer.commit([writer.write(iter([("x 1",)]))], 7)
    assert [f for f in sorted(os.listdir(path)) if f.startswith("part")] == ["part-000000000007-00000.txt"]
    assert lines(spark, path) == ["x 1"]


def test_stream(spark, tmp_path):
    path, folder = str(tmp_path / "out"), str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select(F.col("id").cast("string").alias("line")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(folder)
    for _ in range(2):
        running = stream.writeStream.format("line_sink").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(path)
        running.awaitTermination()
    assert lines(spark, path) == sorted(map(str, range(30)))
