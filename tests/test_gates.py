"""Expectations of a stream: the bad batch halts it or is diverted, others pass."""

import pytest
from pyspark.sql import functions as F

from fleetlens.streaming import flows, gates

SCHEMA = "id bigint, v bigint"


def rules():
    return {"positive": F.col("v") > 0, "known": F.col("v").isNotNull()}


LEAST = {"positive": 0.8, "known": 0.5}


def landed(spark, folder, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame([(10 * i + k, v) for k, v in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.schema(SCHEMA).parquet(path).collect())


@pytest.fixture
def stream(spark, tmp_path):
    return landed(spark, str(tmp_path / "in"), [1, 1, 1, 1, -1], [2, 2], [3, None, None, 3], [4, 4])


def test_a_bad_batch_halts_the_stream(spark, stream, tmp_path):
    out, held, checkpoint = (str(tmp_path / n) for n in ("out", "held", "checkpoint"))
    write = gates.gated(rules(), LEAST, flows.to_folder_per_batch(out), held)
    assert gates.ended_at_gate(flows.each_batch(stream, write, checkpoint))
    assert ids(spark, out) == [0, 1, 2, 3, 4, 10, 11]
    # started anew, it meets the same batch first; with a lower limit it goes on from there
    assert gates.ended_at_gate(flows.each_batch(stream, write, checkpoint))
    assert ids(spark, out) == [0, 1, 2, 3, 4, 10, 11]
    lower = gates.gated(rules(), {"positive": 0.5, "known": 0.5}, flows.to_folder_per_batch(out), held)
    assert not gates.ended_at_gate(flows.each_batch(stream, lower, checkpoint))
    assert ids(spark, out) == [0, 1, 2, 3, 4, 10, 11, 20, 21, 22, 23, 30, 31]


def test_a_bad_batch_is_diverted(spark, stream, tmp_path):
    out, side = str(tmp_path / "out"), str(tmp_path / "side")
    write = gates.gated(rules(), LEAST, flows.to_folder_per_batch(out), str(tmp_path / "held"), flows.to_folder_per_batch(side))
    assert not gates.ended_at_gate(flows.each_batch(stream, write, str(tmp_path / "checkpoint")))
    assert ids(spark, out) == [0, 1, 2, 3, 4, 10, 11, 30, 31] and ids(spark, side) == [20, 21, 22, 23]


def test_other_errors_are_raised(spark, stream, tmp_path):
    def write(batch, batch_id):
        raise ValueError("something else")

    with pytest.raises(Exception, match="something else"):
        gates.ended_at_gate(flows.each_batch(stream, write, str(tmp_path / "checkpoint")))
