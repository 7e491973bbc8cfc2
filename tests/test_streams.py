"""Streams over several micro-batches equal their batch twins."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import series
from fleetlens.streaming import flows, state

ORDER = ("ts_us", "tie")


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Samples in six files in time order, and the table of all of them."""
    state.use_state_store(spark)
    rng = random.Random(3)
    rows, ts = [], 0
    counters = Counter()
    for tie in range(600):
        ts += rng.choice([0, 1, 700_000, 9_000_000])
        device = rng.choice(["a", "a", "b", "c"])
        key = (device, rng.choice(["e1", "e2"]))
        counters[key] = 0 if rng.random() < 0.04 else counters[key] + rng.choice([0, 5, 800])
        rows.append((*key, ts, tie, counters[key], rng.choice(["up", "down", "down"]), rng.random() < 0.6))
    schema = "device string, iface string, ts_us bigint, tie bigint, counter bigint, state string, failed boolean"
    folder = tmp_path_factory.mktemp("landed")
    for i in range(6):
        part = spark.createDataFrame(rows[i * 100:(i + 1) * 100], schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))
    return stream, spark.read.parquet(str(folder)).cache()


def drained(spark, stream, tmp_path):
    running = flows.each_batch(stream, flows.to_folder_per_batch(str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    running.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_rates(spark, landed, tmp_path):
    stream, table = landed
    got = drained(spark, state.stream_rates(stream), tmp_path)
    assert got.select("batch_id").distinct().count() == 6
    batch = series.poll_records(table, octets=("counter",), order=ORDER)
    expected = bag(batch, "tie", "delta_counter", "counter_bps", "counter_peak_bps")
    assert bag(got, "tie", "delta_octets", "bps", "peak_bps") == expected


def test_changes_and_pauses(spark, landed, tmp_path):
    stream, table = landed
    got = drained(spark, state.stream_changes(stream), tmp_path / "a")
    expected = series.state_changes(table, "state", ("device",), ORDER)
    assert bag(got, "tie", "prev_state", "state") == bag(expected, "tie", "prev_state", "state")
    got = drained(spark, state.stream_pauses(stream), tmp_path / "b")
    assert bag(got, "tie") == bag(series.pauses(table, F.col("failed"), ("device",), ORDER), "tie")


def test_late_and_repeated_samples_change_nothing(spark, tmp_path):
    state.use_state_store(spark)
    schema = "device string, iface string, ts_us bigint, tie bigint, counter bigint"
    folder = str(tmp_path / "in")
    for rows in ([("a", "e", 10, 1, 100), ("a", "e", 20, 2, 200)], [("a", "e", 15, 9, 1), ("a", "e", 20, 2, 200), ("a", "e", 30, 3, 300)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drained(spark, state.stream_rates(stream), tmp_path)
    assert bag(got, "ts_us", "delta_octets") == Counter({(10, 0): 1, (20, 100): 1, (30, 100): 1})


def test_state_with_time_to_live(spark, tmp_path):
    state.use_state_store(spark)
    schema = "device string, iface string, ts_us bigint, tie bigint, counter bigint"
    spark.createDataFrame([("a", "e", 10, 1, 100), ("a", "e", 20, 2, 200)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rows = []
    running = flows.each_batch(
        state.stream_rates(stream, ttl_ms=3_600_000), lambda batch, _: rows.extend(batch.collect()), str(tmp_path / "c"), once=False
    )
    deadline = time.time() + 60
    while len(rows) < 2 and time.time() < deadline:
        time.sleep(0.5)
    running.stop()
    assert sorted((r.ts_us, r.delta_octets) for r in rows) == [(10, 0), (20, 100)]


def test_restart_reads_only_new_files(spark, tmp_path):
    from fleetlens.sources import snapshots

    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))

    def land(device, idle):
        spark.sql(
            f"""select timestamp'2024-01-01 00:00:00' as collected_at, 'system' as module, '{device}' as device, true as success,
                named_struct('resource_usage', named_struct('cpu_idle', {idle})) as data"""
        ).write.mode("append").json(landing)

    land("a", 80)
    flows.ingest(spark, landing, out, checkpoint).awaitTermination()
    land("b", 90)
    flows.ingest(spark, landing, out, checkpoint).awaitTermination()
    rows = spark.read.parquet(out).filter("field = 'cpu_total_used'").collect()
    assert sorted((r.device, r.v_dbl, r.batch_id) for r in rows) == [("a", 20.0, 0), ("b", 10.0, 1)]
    assert snapshots.read_envelopes(spark, landing).count() == 2


def test_selection_is_read_again(spark, tmp_path):
    """The selection changes between two micro-batches of one running query."""
    schema = "device string, v bigint"
    folder, chosen, out = (str(tmp_path / n) for n in ("in", "chosen", "out"))
    for v in (1, 2, 3):
        spark.createDataFrame([("a", v), ("b", v)], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([("b",)], "device string").write.parquet(chosen)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    to_folder = flows.to_folder_per_batch(out)

    def write(batch, batch_id):
        to_folder(batch, batch_id)
        if batch_id == 0:
            spark.createDataFrame([("a",)], "device string").write.mode("overwrite").parquet(chosen)

    picked = flows.selecting(lambda session: session.read.parquet(chosen), ["device"], write)
    flows.each_batch(stream, picked, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted((r.batch_id, r.device) for r in got) == [(0, "b"), (1, "a"), (2, "a")]


@pytest.mark.parametrize("files", [1, 1000])
def test_host_names_do_not_depend_on_the_grouping_of_files(spark, tmp_path, files):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    for module, data in (
        ("system", "named_struct('system_info', named_struct('system', named_struct('hostname', 'core-1')))"),
        ("vpn", "named_struct('vpn_flows', named_struct('num_ipsec', 1, 'total', 2))"),
    ):
        spark.sql(
            f"select timestamp'2024-01-01 00:00:00' as collected_at, '{module}' as module, 'fw1' as device, true as success, {data} as data"
        ).coalesce(1).write.mode("append").json(landing)
    stored = spark.sql("select timestamp'2024-01-01 00:00:00' as collected_at, 'fw1' as device, 'core-1' as reported")
    for hosts, name in ((None, "fw1"), (stored, "core-1")):
        target = f"{out}-{name}"
        flows.ingest(spark, landing, target, f"{checkpoint}-{name}", files_per_trigger=files, hosts=hosts).awaitTermination()
        rows = spark.read.parquet(target).filter("measurement = 'vpn_flows'").collect()
        assert rows and {r.tags["hostname"] for r in rows} == {name}
