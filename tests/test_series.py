"""Ordered operators on hot keys: slices must not change any result."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import joins, series
from fleetlens.plans import slicing
from fleetlens.plans.numbering import number_within

KEYS = ("device", "iface")
ORDER = ("ts_us", "tie")


@pytest.fixture(scope="module")
def samples(spark):
    """One interface with a third of all rows, uneven gaps, resets, zeros and equal times."""
    rng = random.Random(7)
    rows, tie = [], 0
    for device, iface, n in [("a", "e1", 300)] + [(f"d{i}", "e1", rng.randint(1, 40)) for i in range(20)] + [("a", None, 60)]:
        ts, counter = 1_000_000, 0
        for _ in range(n):
            ts += rng.choice([0, 1, 1000, 5_000_000, 40_000_000_000])
            counter = 0 if rng.random() < 0.05 else counter + rng.choice([0, 10, 999])
            rows.append((device, iface, ts, tie, counter, rng.choice(["up", "down", "up"])))
            tie += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "device string, iface string, ts_us bigint, tie bigint, counter bigint, state string").cache()


def bag(df):
    return Counter(df.select(*sorted(df.columns)).collect())


def plain_rates(rows):
    """Row-by-row computation of rates, peaks and the change flag."""
    out, last = Counter(), {}
    for r in sorted(rows, key=lambda r: (r.ts_us, r.tie)):
        key = (r.device, r.iface)
        prev = last.get(key)
        delta, bps, old = 0, 0.0, 0.0
        history = prev[2] if prev else []
        if prev:
            old = prev[2][-1]
            if prev[1] != 0 and r.counter >= prev[1]:
                delta = r.counter - prev[1]
            elapsed = r.ts_us - prev[0]
            bps = delta * 8 * 1_000_000.0 / elapsed if elapsed > 0 else 0.0
        history = (history + [bps])[-70:]
        last[key] = (r.ts_us, r.counter, history)
        out[(r.tie, delta, bps, max(history), abs(bps - old) / max(old, 1) > 0.01, prev is None)] += 1
    return out


@pytest.mark.parametrize("max_rows", [10**9, 100, 25, 3])
def test_poll_records(samples, max_rows):
    got = series.poll_records(samples, octets=("counter",), order=ORDER, max_rows=max_rows)
    mine = Counter(
        tuple(r) for r in got.select("tie", "delta_counter", "counter_bps", "counter_peak_bps", "changed", "is_first").collect()
    )
    assert mine == plain_rates(samples.collect())


@pytest.mark.parametrize("max_rows", [60, 7])
def test_slices_do_not_change_results(samples, max_rows):
    down = F.col("state") == "down"
    for run in (
        lambda m: series.state_changes(samples, "state", KEYS, ORDER, m),
        lambda m: series.sustained(samples, F.col("state") == "up", 4, KEYS, ORDER, m),
        lambda m: series.pauses(samples, down, KEYS, ORDER, 2, m),
        lambda m: series.failure_streaks(samples, down, KEYS, ORDER, 1, m),
        lambda m: series.with_epochs(samples, down, KEYS, ORDER, m),
        lambda m: series.with_latest(samples, F.when(down, F.col("counter")), "seen", KEYS, ORDER, m),
        lambda m: series.derivative(samples, KEYS, "counter", ORDER, m),
    ):
        assert bag(run(max_rows).drop("_slice")) == bag(run(10**9).drop("_slice"))


def test_validity_lookup_against_brute_force(samples):
    notes = samples.filter("state = 'down'").select("device", "ts_us", "tie", F.col("counter").alias("name"), (F.col("ts_us") + 30_000_000_000).alias("until"))
    events = samples.filter("state = 'up'").select("device", "ts_us", "tie")
    for max_rows in (10**9, 9):
        got = joins.valid_lookup(events, notes, "device", "ts_us", "tie", "name", "until", max_rows)
        noted = notes.collect()
        expected = Counter()
        for e in events.collect():
            before = [n for n in noted if n.device == e.device and n.ts_us <= e.ts_us]
            latest = max(before, key=lambda n: (n.ts_us, n.tie), default=None)
            expected[(e.tie, latest.name if latest and e.ts_us < latest.until else None)] += 1
        assert Counter(tuple(r) for r in got.select("tie", "name").collect()) == expected


def test_newest_and_graph(samples):
    rates = series.counter_rates(samples, octets=("counter",), order=ORDER)
    history = series.poll_history(rates, KEYS, ORDER).groupBy(*KEYS).count().collect()
    assert max(r["count"] for r in history) == 70
    graph = series.area_graph(rates, "counter_bps", "counter_bps", KEYS, ORDER).collect()
    assert all(len(r.levels) == 70 for r in graph)
    assert all(0 <= v <= 24 for r in graph for v in r.levels if v is not None)
    short = [r for r in graph if r.levels[0] is None]
    assert short and all(r.levels[-1] is not None for r in short)


def test_errors_clamp_on_their_own(spark):
    rows = [("a", "e", 0, 5, 5), ("a", "e", 10, 1, 2), ("a", "e", 20, 4, 2)]
    df = spark.createDataFrame(rows, "device string, iface string, ts_us bigint, errors bigint, drops bigint")
    got = series.counter_rates(df, octets=(), events=("errors", "drops")).orderBy("ts_us").collect()
    assert [(r.delta_errors, r.delta_drops) for r in got] == [(0, 0), (0, 0), (3, 0)]


def test_numbering_across_blocks(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id * 7 % 1000 as pos", "cast(id as string) as v")
    sparse = df.withColumn("pos", F.col("pos") * 86_400_000_000 + 7)
    for got in (number_within(df, ["g"], ["pos", "v"], block=64, stretch=3), number_within(sparse, ["g"], ["pos", "v"])):
        rows = got.collect()
        for g in range(3):
            ordered = sorted((r for r in rows if r.g == g), key=lambda r: (r.pos, r.v))
            assert [r.number for r in ordered] == list(range(1, len(ordered) + 1))


def test_slices_are_cut_by_rows_not_by_time(spark):
    """One clock that is years off, and very many rows of one instant."""
    off = spark.range(10_000).selectExpr("'a' as k", "if(id = 5, -9e17, id) as t")
    one = spark.range(10_000).selectExpr("'b' as k", "cast(7 as double) as t").selectExpr("k", "t")
    rows = off.unionByName(one).selectExpr("k", "cast(t as bigint) as ts_us", "monotonically_increasing_id() as tie").cache()
    for order in (("ts_us", "tie"), ("ts_us",)):
        sizes = slicing.slice_hot(rows, ["k"], order, 500).groupBy("k", slicing.SLICE).count().collect()
        assert max(r["count"] for r in sizes) <= 1000 and len(sizes) >= 30
    spans = (
        slicing.slice_hot(rows, ["k"], ("ts_us", "tie"), 500).groupBy("k", slicing.SLICE)
        .agg(F.min(F.struct("ts_us", "tie")).alias("a"), F.max(F.struct("ts_us", "tie")).alias("b")).orderBy("k", slicing.SLICE).collect()
    )
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]) if x["k"] == y["k"])


def rows_read(spark, run):
    """Rows that the stages of ``run`` read from files."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    store = spark.sparkContext._jsc.sc().statusStore()
    run()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(10_000)
    total = 0
    for job in spark.sparkContext.statusTracker().getJobIdsForGroup(group):
        for stage in spark.sparkContext.statusTracker().getJobInfo(job).stageIds:
            try:
                total += store.lastStageAttempt(stage).inputRecords()
            except Exception:  # a stage that was skipped has no attempt
                pass
    return total


@pytest.mark.parametrize(
    "run",
    [
        lambda s: series.poll_records(s, octets=("counter",), order=ORDER),
        lambda s: series.failure_streaks(s, F.col("state") == "down", KEYS, ORDER),
        lambda s: series.with_latest(s, F.col("counter"), "seen", KEYS, ORDER),
        lambda s: series.counter_rates(series.with_epochs(s, F.col("state") == "down", KEYS, ORDER), ("counter",), keys=(*KEYS, "epoch"), order=ORDER),
    ],
)
def test_the_source_is_read_twice(spark, samples, tmp_path, run):
    samples.write.parquet(str(tmp_path / "samples"))
    stored = spark.read.parquet(str(tmp_path / "samples"))
    n = samples.count()
    assert 0 < rows_read(spark, lambda: run(stored).write.format("noop").mode("overwrite").save()) <= 2 * n
