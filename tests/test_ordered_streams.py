"""Streams in event-time order: late rows, selection in the stream, forgotten keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import series
from fleetlens.streaming import flows, ordered, state

SCHEMA = "device string, iface string, ts_us bigint, tie bigint, counter bigint, state string, failed boolean, kind string"
SECOND = 1_000_000


def row(device, ts, tie, counter=0, kind="sample", iface="e1"):
    return (device, iface, ts * SECOND, tie, counter, "up", False, kind)


def land(spark, folder, *files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(spark, stream, tmp_path):
    state.use_state_store(spark)
    out, side = str(tmp_path / "out"), str(tmp_path / "side")
    flows.each_batch(stream, ordered.to_folders(out, side), str(tmp_path / "checkpoint")).awaitTermination()
    return spark.read.parquet(out), spark.read.parquet(side)


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def table(spark):
    rng, rows, ts, counters = random.Random(3), [], 0, Counter()
    for tie in range(400):
        ts += rng.choice([0, 1, 3, 90])
        key = (rng.choice(["a", "a", "b", "c"]), rng.choice(["e1", "e2"]))
        counters[key] = 0 if rng.random() < 0.04 else counters[key] + rng.choice([0, 5, 800])
        rows.append((*key, ts * SECOND, tie, counters[key], rng.choice(["up", "down", "down"]), rng.random() < 0.6, "sample"))
    rng.shuffle(rows)
    beat = [(None, None, (ts + 100_000) * SECOND, None, None, None, None, "heartbeat")]
    return rows, [rows[:150], rows[150:300], rows[300:], beat]


@pytest.mark.parametrize("bucket", [60 * SECOND, 10**12])
def test_shuffled_files_give_the_results_of_the_batch(spark, table, tmp_path, bucket):
    rows, files = table
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = land(spark, str(tmp_path / "in"), *files)
    got, side = drained(spark, ordered.ordered_rates(stream, "90000 seconds", bucket_us=bucket), tmp_path / "a")
    want = series.poll_records(batch, octets=("counter",), order=("ts_us", "tie"))
    assert bag(got, "tie", "delta_octets", "bps", "peak_bps") == bag(want, "tie", "delta_counter", "counter_bps", "counter_peak_bps")
    assert side.count() == 0
    if bucket == 10**12:
        got, _ = drained(spark, ordered.ordered_changes(stream, "90000 seconds", bucket), tmp_path / "b")
        want = series.state_changes(batch, "state", ("device",), ("ts_us", "tie"))
        assert bag(got, "tie", "prev_state", "state") == bag(want, "tie", "prev_state", "state")
        got, _ = drained(spark, ordered.ordered_pauses(stream, "90000 seconds", bucket_us=bucket), tmp_path / "c")
        assert bag(got, "tie") == bag(series.pauses(batch, F.col("failed"), ("device",), ("ts_us", "tie")), "tie")


def test_every_dropped_row_is_in_the_side_table(spark, tmp_path):
    stream = land(
        spark, str(tmp_path / "in"),
        [row("a", 10, 1, 100), row("a", 20, 2, 200), row("a", 20, 2, 999)],
        [row("x", 1000, 1)], [row("x", 1001, 2)],  # the watermark passes 20
        [row("a", 15, 9, 1), row("a", 20, 2, 200), row("a", 30, 3, 300)],  # 30 is behind the watermark, but in its place
        [row("x", 5000, 3)], [row("x", 9000, 4)],
    )
    got, side = drained(spark, ordered.ordered_rates(stream, "100 seconds"), tmp_path)
    assert bag(got.filter("device = 'a'"), "ts_us", "delta_octets") == Counter({(10 * SECOND, 0): 1, (20 * SECOND, 100): 1, (30 * SECOND, 100): 1})
    assert bag(side, "ts_us", "tie", "reason") == Counter({(20 * SECOND, 2, "repeated"): 1, (15 * SECOND, 9, "late"): 1, (20 * SECOND, 2, "late"): 1})


def test_deselected_and_selected_again(spark, tmp_path):
    files = [
        [row("a", 10, 1, 100), row("a", 20, 2, 250), row("b", 10, 1, 7)],
        [row("a", 40, 5, 400), row("a", 30, 4, kind="deselected")],
        [row("x", 1000, 1)], [row("x", 1001, 2)],
    ]
    stream = land(spark, str(tmp_path / "in"), *files)
    got, _ = drained(spark, ordered.ordered_rates(stream, "100 seconds"), tmp_path)
    assert bag(got.filter("device = 'a'"), "ts_us", "delta_octets") == Counter({(10 * SECOND, 0): 1, (20 * SECOND, 150): 1})
    known = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "last").load()
    assert {r["key"]["device"] for r in known.collect()} == {"b"}
    stream = land(spark, str(tmp_path / "in"), [row("a", 950, 6, 500, "selected"), row("a", 960, 7, 500), row("a", 970, 8, 900)], [row("x", 2000, 3)], [row("x", 2001, 4)])
    got, _ = drained(spark, ordered.ordered_rates(stream, "100 seconds"), tmp_path)
    later = got.filter(f"device = 'a' and ts_us > {900 * SECOND}")
    assert bag(later, "ts_us", "delta_octets") == Counter({(960 * SECOND, 0): 1, (970 * SECOND, 400): 1})


def test_keys_that_nothing_names_are_forgotten(spark, tmp_path):
    stream = land(spark, str(tmp_path / "in"), [row("a", 10, 1, 100), row("b", 10, 1, 5)], [row("b", 900, 2, 9)], [row("b", 1500, 3, 9)], [row("b", 1501, 4, 9)])
    drained(spark, ordered.ordered_rates(stream, "10 seconds", idle_ms=700_000), tmp_path)
    for name in ("last", "place"):
        known = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", name).load()
        assert {r["key"]["device"] for r in known.collect()} == {"b"}


def test_heartbeat_and_controls_without_numbers_beside_samples_of_other_keys(spark, tmp_path):
    devices = [f"d{i}" for i in range(40)]
    beat = (None, None, 5000 * SECOND, None, None, None, None, "heartbeat")
    big = 2**53 + 1
    files = [
        [*(row(d, ts, tie, big + tie) for d in devices for ts, tie in ((10, 1), (20, 2))), beat],
        [*(row(d, 30, 3, None, "deselected") for d in devices[:20]), *(row(d, 40, 4, big + 9) for d in devices), beat],
        [row("x", 9000, 1)], [row("x", 9001, 2)],
    ]
    stream = land(spark, str(tmp_path / "in"), *files)
    got, side = drained(spark, ordered.ordered_rates(stream, "4000 seconds"), tmp_path)
    want = Counter({(1, 0): 40, (2, 1): 40, (4, 7): 20})
    assert bag(got.filter("device != 'x'"), "tie", "delta_octets") == want
    assert side.count() == 0


def test_keys_that_share_groups(spark, table, tmp_path):
    """As many state calls as groups, not keys; the results are those of the batch."""
    rows, files = table
    rows = [(f"{r[0]}{r[3] % 9}", *r[1:]) for r in rows]
    stream = land(spark, str(tmp_path / "in"), *[[(f"{r[0]}{r[3] % 9}", *r[1:]) for r in f] for f in files[:3]], files[3])
    got, side = drained(spark, ordered.ordered_rates(stream, "90000 seconds", bucket_us=3600 * SECOND, groups=3), tmp_path / "a")
    want = series.poll_records(spark.createDataFrame(rows, SCHEMA), octets=("counter",), order=("ts_us", "tie"))
    columns = ("device", "iface", "tie")
    assert bag(got, *columns, "delta_octets", "bps", "peak_bps") == bag(want, *columns, "delta_counter", "counter_bps", "counter_peak_bps")
    assert side.count() == 0
    known = spark.read.format("statestore").option("path", str(tmp_path / "a" / "checkpoint")).option("stateVarName", "last").load()
    assert known.count() == len({r[:2] for r in rows}) and {r["key"]["key_group"] for r in known.collect()} <= {0, 1, 2}
