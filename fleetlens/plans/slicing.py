"""Exact ordered computations over keys of any size.

A window partitioned by a device or interface sorts all rows of that key in one task, which does
not hold once one key carries a large share of the table. Here a key above ``max_rows`` is cut
into consecutive slices of about as many rows, each its own window partition, and what a slice needs
from earlier ones travels as a small summary:

* ``slice_hot``     marks the slices (every other key keeps the single slice 0),
* ``with_halo``     copies the last ``depth`` rows before a slice into it, so any window function
                    that looks back at most ``depth`` rows is exact on the slice's own rows,
* ``running_sum``   adds the totals of earlier slices to a sum inside the slice,
* ``last_known``    carries the last non-null value of earlier slices into the slice.

Slices are cut by numbers of rows, at places in the full order, so neither a clock that is years off nor
many rows of one instant makes a slice larger. Summaries hold at most ``depth`` rows per slice of a
hot key; nothing is dropped. Without hot keys the plan is the plain window after one counting pass: the
source is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "_slice"
HALO = "_halo"
MAX_ROWS = 2_000_000
MAX_HOT = 100_000
#: Rows of a slice that are looked at to find where it ends.
PROBES = 256


def _hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> tuple[int, list]:
    """The limit and the keys above it with their rows: fewer than ``MAX_HOT``, whatever the table holds.

    A hot key has more than ``max_rows`` rows and more than a ``1 / MAX_HOT`` share of the table. One job counts; the
    total is observed on its way.
    """
    total = Observation()
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).observe(total, F.sum("_n").alias("rows"))
    largest = counted.filter(F.col("_n") > max_rows).orderBy(F.desc("_n")).limit(MAX_HOT).collect()
    limit = max(max_rows, (total.get["rows"] or 0) // MAX_HOT)
    return limit, [r for r in largest if r["_n"] > limit]


def _beside(df: DataFrame, few: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``df`` joined with a row for each of some hot keys, whose number is bounded (see ``_hot_keys``)."""
    named = few.withColumnsRenamed({k: f"_hot_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & df[k].eqNullSafe(named[f"_hot_{k}"])
    return df.join(F.broadcast(named), match, how).drop(*[f"_hot_{k}" for k in keys])


def _slice_ends(df: DataFrame, keys: Sequence[str], place: Column, seed: Column, limit: int, hot: list) -> DataFrame:
    """For each hot key the places at which its slices 2, 3 .. begin: rows chosen by hash, every so many of them."""
    step = max(1, limit // PROBES)
    schema = T.StructType([df.schema[k] for k in keys])
    few = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in hot], schema)
    chosen = _beside(df, few, keys, "inner").filter(F.pmod(seed, F.lit(step)) == 0).select(*keys, place.alias("_place"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_place"))
    ends = chosen.withColumn("_nth", nth).filter(F.col("_nth") % (limit // step) == 0)
    found = ends.groupBy(*keys).agg(F.sort_array(F.collect_list("_place")).alias("_ends"))
    # a place for each ``limit`` rows of the table at most: no more than MAX_HOT, kept so that all passes see the same
    return df.sparkSession.createDataFrame(found.collect(), found.schema)


def _places_before(ends: str, place: str) -> Column:
    """How many of the sorted places are not after ``place``, by halving."""
    halve = f"""case when s.low >= s.high then s
        when get({ends}, (s.low + s.high) div 2) <= {place}
        then named_struct('low', (s.low + s.high) div 2 + 1, 'high', s.high)
        else named_struct('low', s.low, 'high', (s.low + s.high) div 2) end"""
    return F.expr(
        f"aggregate(sequence(1, 2 + cast(log2(size({ends}) + 1) as int)), "
        f"named_struct('low', 0L, 'high', cast(size({ends}) as bigint)), (s, i) -> {halve}).low"
    )


def slice_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Add ``_slice``: 0 for ordinary keys, a slice number from 1 for hot ones.

    Slices follow ``order``; among rows equal in it, a hash of all columns decides, so many rows of one instant are
    cut too. Rows that already carry ``_slice``, cut on the same keys or some of them, are returned as they are. The
    counting runs at once: what it finds decides whether there is anything to cut.
    """
    if SLICE in df.columns:
        return df
    limit, hot = _hot_keys(df, keys, max_rows)
    if not hot:
        return df.withColumn(SLICE, F.lit(0).cast("bigint"))
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    place = F.struct(*order, F.xxhash64(*hashed).alias("_tie"))
    seed = F.xxhash64(F.lit("ends"), *hashed)
    ends = _slice_ends(df, keys, place, seed, limit, hot)
    placed = _beside(df.withColumn("_place", place), ends, keys, "left")
    number = F.when(F.col("_ends").isNotNull(), _places_before("_ends", "_place") + 1).otherwise(0)
    return placed.withColumn(SLICE, number.cast("bigint")).drop("_place", "_ends")


def sliced(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def _descending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() for c in order]


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], depth: int) -> DataFrame:
    """Sliced rows plus, in each slice, the ``depth`` rows before it, marked ``_halo``.

    The tails are cut with ``row_number() <= depth``, which Spark also applies before its shuffle,
    and ordinary keys (slice 0) send none.
    """
    rank = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*_descending(order)))
    tails = df.filter(F.col(SLICE) > 0).withColumn("_back", rank).filter(F.col("_back") <= depth)
    # Slices of a key in order, each with the number of tail rows up to and including it. A slice
    # with more rows than ``depth`` counts as ``depth``: enough to end every look-back.
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    ends = (
        tails.groupBy(*keys, SLICE)
        .agg(F.count("*").alias("_size"))
        .withColumn("_end", F.sum("_size").over(by_slice))
        .withColumn(
            "_ahead",
            F.collect_list(F.struct(F.col(SLICE).alias("to"), (F.col("_end") - F.col("_size")).alias("start"))).over(
                by_slice.rowsBetween(1, depth)
            ),
        )
        .select(
            *[F.col(k).alias(f"_e_{k}") for k in keys], F.col(SLICE).alias("_e_slice"), "_end", "_ahead"
        )
    )
    match = tails[SLICE] == ends["_e_slice"]
    for k in keys:
        match = match & tails[k].eqNullSafe(ends[f"_e_{k}"])
    halo = (
        tails.join(ends, match)
        .withColumn("_target", F.explode("_ahead"))
        .filter(F.col("_back") + F.col("_target.start") - F.col("_end") <= depth)
        .withColumn(SLICE, F.col("_target.to"))
        .select(*df.columns, F.lit(True).alias(HALO))
    )
    return df.withColumn(HALO, F.lit(False)).unionByName(halo)


def without_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO, SLICE)


def _slice_join(df: DataFrame, carried: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Bring one summary row per slice to the rows; their number is bounded (see ``slice_hot``)."""
    renamed = carried.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys], F.col(SLICE).alias("_c_slice"), *columns
    )
    match = df[SLICE] == renamed["_c_slice"]
    for k in keys:
        match = match & df[k].eqNullSafe(renamed[f"_c_{k}"])
    return df.join(F.broadcast(renamed), match, "left").drop("_c_slice", *[f"_c_{k}" for k in keys])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Add the inclusive running sum of ``value`` per key; ``df`` carries ``_slice``."""
    with_value = df.withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        with_value.filter(F.col(SLICE) > 0)
        .groupBy(*keys, SLICE)
        .agg(F.sum("_v").alias("_total"))
        .withColumn("_offset", F.sum("_total").over(before))
    )
    local = sliced(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    summed = with_value.withColumn("_local", F.sum("_v").over(local))
    return (
        _slice_join(summed, offsets, keys, ["_offset"])
        .withColumn(name, F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0)))
        .drop("_v", "_local", "_offset")
    )


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row; ``df`` carries ``_slice``."""
    with_value = df.withColumn("_v", value)
    ordering = F.struct(*[F.col(c) for c in order])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        with_value.filter(F.col(SLICE) > 0)
        .groupBy(*keys, SLICE)
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), ordering)).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
    )
    local = sliced(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    filled = with_value.withColumn("_local", F.last("_v", ignorenulls=True).over(local))
    return (
        _slice_join(filled, carried, keys, ["_carry"])
        .withColumn(name, F.coalesce(F.col("_local"), F.col("_carry")))
        .drop("_v", "_local", "_carry")
    )
