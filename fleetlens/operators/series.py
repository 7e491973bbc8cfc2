"""Time series of cumulative counters, states and polls.

Samples carry key columns (device, interface), ``ts_us`` (BIGINT microseconds) and counters.
``order`` starts with ``ts_us``; further columns break ties. Every look-back runs on sliced keys
(see ``plans.slicing``), so one interface may hold any share of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.slicing import (
    MAX_ROWS,
    SLICE,
    last_known,
    running_sum,
    slice_hot,
    sliced,
    with_halo,
    without_halo,
)

KEYS = ("device", "iface")
ORDER = ("ts_us",)
# Samples kept per interface, levels of the area graph, nominal poll seconds,
# smallest graph peak and head room, smallest change that counts, failures before a pause.
HISTORY = 70
GRAPH_LEVELS = 24
NOMINAL_SECONDS = 10
GRAPH_FLOOR = 1000
GRAPH_HEADROOM = 1.1
SIGNIFICANT = 0.01
PAUSE_AFTER = 3


def increase(current: Column, previous: Column, zero_is_unknown: bool = True) -> Column:
    """Growth since the previous sample; 0 for the first one, after a reset, and from an unknown 0."""
    unknown = previous.isNull() | (current < previous)
    if zero_is_unknown:
        unknown = unknown | (previous == 0)
    return F.when(unknown, F.lit(0).cast("bigint")).otherwise(current - previous)


def per_second(amount: Column, elapsed_us: Column) -> Column:
    return F.when(elapsed_us > 0, amount * F.lit(1_000_000.0) / elapsed_us).otherwise(F.lit(0.0))


def _rates(
    haloed: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    octets: Sequence[str],
    packets: Sequence[str],
    events: Sequence[str],
    nominal_seconds: float,
    zero_is_unknown: bool,
) -> DataFrame:
    w = sliced(keys, order)
    lagged = {c: F.lag(c).over(w) for c in ("ts_us", *octets, *packets, *events)}
    out = haloed.select(
        "*",
        lagged["ts_us"].isNull().alias("is_first"),
        F.coalesce(F.col("ts_us") - lagged["ts_us"], F.lit(int(nominal_seconds * 1_000_000))).alias("elapsed_us"),
        *[increase(F.col(c), lagged[c], zero_is_unknown).alias(f"delta_{c}") for c in (*octets, *packets)],
        *[increase(F.col(c), lagged[c], False).alias(f"delta_{c}") for c in events],
    )
    return out.select(
        "*",
        *[per_second(F.col(f"delta_{c}") * 8, F.col("elapsed_us")).alias(f"{c}_bps") for c in octets],
        *[per_second(F.col(f"delta_{c}"), F.col("elapsed_us")).alias(f"{c}_pps") for c in packets],
    )


def counter_rates(
    samples: DataFrame,
    octets: Sequence[str] = ("ibytes", "obytes"),
    packets: Sequence[str] = (),
    events: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    nominal_seconds: float = NOMINAL_SECONDS,
    zero_is_unknown: bool = True,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Deltas and rates per sample: octet counters in bits per second, packet counters per second,
    event counters (errors, drops) as plain increases. Elapsed time is that of the key itself."""
    cut = slice_hot(samples, keys, order, max_rows)
    haloed = with_halo(cut, keys, order, 1)
    return without_halo(
        _rates(haloed, keys, order, octets, packets, events, nominal_seconds, zero_is_unknown)
    )


def poll_records(
    samples: DataFrame,
    octets: Sequence[str] = ("ibytes", "obytes"),
    packets: Sequence[str] = (),
    events: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    nominal_seconds: float = NOMINAL_SECONDS,
    zero_is_unknown: bool = True,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """``counter_rates`` plus rolling peaks over the last 70 rates and the significant-change flag.

    One shuffle and one sort serve all of it: both window steps share partitioning and order.
    """
    cut = slice_hot(samples, keys, order, max_rows)
    haloed = with_halo(cut, keys, order, HISTORY)
    rated = _rates(haloed, keys, order, octets, packets, events, nominal_seconds, zero_is_unknown)
    w = sliced(keys, order)
    recent = w.rowsBetween(-(HISTORY - 1), 0)
    changed = F.lit(False)
    for c in octets:
        before = F.coalesce(F.lag(f"{c}_bps").over(w), F.lit(0.0))
        changed = changed | (
            F.abs(F.col(f"{c}_bps") - before) / F.greatest(before, F.lit(1.0)) > SIGNIFICANT
        )
    return without_halo(
        rated.select(
            "*",
            *[F.max(f"{c}_bps").over(recent).alias(f"{c}_peak_bps") for c in octets],
            changed.alias("changed"),
        )
    )


def newest(
    df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, depth: int = HISTORY
) -> DataFrame:
    """The newest ``depth`` rows of each key with their rank, newest first.

    The rank filter is applied before the shuffle too, so a key of any size sends at most
    ``depth`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= depth)


def poll_history(rates: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Newest 70 records per interface without the first poll, which has no delta."""
    return newest(rates.filter(~F.col("is_first")), keys, order)


def area_graph(
    rates: DataFrame,
    value: str,
    other: str,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    width: int = HISTORY,
    levels: int = GRAPH_LEVELS,
) -> DataFrame:
    """Scale and level list per key: the last ``width`` values scaled to 0..``levels``, newest at the
    right, missing ones null rather than 0."""
    recent = newest(rates, keys, order, width)
    packed = recent.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(-F.col("recency"), F.col(value).alias("v")))).alias("_points"),
        F.max(value).alias("_peak"),
        F.max(other).alias("_other"),
    )
    scale = F.greatest(F.col("_peak"), F.col("_other"), F.lit(float(GRAPH_FLOOR))) * GRAPH_HEADROOM
    scaled = F.transform(
        "_points",
        lambda p: F.least(F.greatest(p["v"] / F.col("scale_max") * levels, F.lit(0.0)), F.lit(float(levels))),
    )
    padding = F.array_repeat(F.lit(None).cast("double"), F.lit(width) - F.size("_points"))
    return packed.withColumn("scale_max", scale).select(
        *keys, "scale_max", F.concat(padding, scaled).alias("levels")
    )


def derivative(
    points: DataFrame,
    keys: Sequence[str],
    value: str,
    order: Sequence[str] = ORDER,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Non-negative growth per second of any cumulative field; rows without a predecessor or after
    a reset are left out."""
    cut = slice_hot(points, keys, order, max_rows)
    w = sliced(keys, order)
    stepped = without_halo(
        with_halo(cut, keys, order, 1).select(
            "*",
            (F.col(value) - F.lag(value).over(w)).alias("_grown"),
            (F.col("ts_us") - F.lag("ts_us").over(w)).alias("_elapsed"),
        )
    )
    return (
        stepped.filter((F.col("_grown") >= 0) & (F.col("_elapsed") > 0))
        .withColumn("per_second", per_second(F.col("_grown"), F.col("_elapsed")))
        .drop("_grown", "_elapsed")
    )


def with_previous(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str] = ORDER,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add ``prev_<column>`` from the row before, per key."""
    cut = slice_hot(df, keys, order, max_rows)
    w = sliced(keys, order)
    return without_halo(
        with_halo(cut, keys, order, 1).select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])
    )


def state_changes(
    df: DataFrame, state: str, keys: Sequence[str], order: Sequence[str] = ORDER, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Rows whose state differs from the one before, with the old state."""
    return with_previous(df, [state], keys, order, max_rows).filter(F.col(f"prev_{state}") != F.col(state))


def counter_rises(
    df: DataFrame, counter: str, keys: Sequence[str], order: Sequence[str] = ORDER, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Rows in which a flap counter grew."""
    return with_previous(df, [counter], keys, order, max_rows).filter(F.col(counter) > F.col(f"prev_{counter}"))


def reboots(
    df: DataFrame,
    uptime: str = "uptime_seconds",
    keys: Sequence[str] = ("device",),
    order: Sequence[str] = ORDER,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Rows whose uptime is below the previous one."""
    return with_previous(df, [uptime], keys, order, max_rows).filter(F.col(f"prev_{uptime}") > F.col(uptime))


def sustained(
    df: DataFrame,
    condition: Column,
    samples: int,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Rows at which ``condition`` has held for ``samples`` consecutive samples."""
    flagged = df.withColumn("_hit", F.coalesce(condition, F.lit(False)).cast("int"))
    cut = slice_hot(flagged, keys, order, max_rows)
    frame = sliced(keys, order).rowsBetween(-(samples - 1), 0)
    held = with_halo(cut, keys, order, samples - 1) if samples > 1 else cut.withColumn("_halo", F.lit(False))
    return (
        without_halo(held.withColumn("_run", F.sum("_hit").over(frame)))
        .filter(F.col("_run") == samples)
        .drop("_hit", "_run")
    )


def pauses(
    polls: DataFrame,
    failed: Column,
    keys: Sequence[str] = ("device",),
    order: Sequence[str] = ORDER,
    after: int = PAUSE_AFTER,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Polls at which a run of failures reaches exactly ``after``: the moment polling is paused."""
    flagged = polls.withColumn("_bad", F.coalesce(failed, F.lit(False)).cast("int"))
    cut = slice_hot(flagged, keys, order, max_rows)
    w = sliced(keys, order)
    run = F.sum("_bad").over(w.rowsBetween(-(after - 1), 0))
    before = F.coalesce(F.lag("_bad", after).over(w), F.lit(0))
    return (
        without_halo(with_halo(cut, keys, order, after).select("*", run.alias("_run"), before.alias("_before")))
        .filter((F.col("_run") == after) & (F.col("_before") == 0))
        .drop("_bad", "_run", "_before")
    )


def failure_streaks(
    polls: DataFrame,
    failed: Column,
    keys: Sequence[str] = ("device",),
    order: Sequence[str] = ORDER,
    min_length: int = 1,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Runs of consecutive failures: start, end, length. A success ends the run.

    Successes are numbered by a running count; failures between two successes share that number,
    so a run of any length is one partially aggregated group.
    """
    flagged = polls.withColumn("_bad", F.coalesce(failed, F.lit(False)))
    cut = slice_hot(flagged, keys, order, max_rows)
    counted = running_sum(cut, keys, order, (~F.col("_bad")).cast("bigint"), "_run")
    return (
        counted.filter("_bad")
        .groupBy(*keys, "_run")
        .agg(
            F.min(order[0]).alias("start_us"), F.max(order[0]).alias("end_us"), F.count("*").alias("length")
        )
        .filter(F.col("length") >= min_length)
        .drop("_run")
    )


def with_epochs(
    samples: DataFrame,
    reset: Column,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Number the stretches between user resets; with ``epoch`` among the keys, rates restart.

    ``_slice`` stays, so that what follows on finer keys need not cut again."""
    cut = slice_hot(samples, keys, order, max_rows)
    flag = F.coalesce(reset, F.lit(False)).cast("bigint")
    return running_sum(cut, keys, order, flag, "epoch")


def with_latest(
    df: DataFrame,
    value: Column,
    name: str,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row."""
    cut = slice_hot(df, keys, order, max_rows)
    return last_known(cut, keys, order, value, name).drop(SLICE)
