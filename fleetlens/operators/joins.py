"""Lookups that bring names, dimensions and counters together.

No join carries a broadcast hint: dimension sizes are data, so the planner (and AQE at run time)
picks broadcast below its size threshold and a shuffle join, with skew splitting, above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import casts
from fleetlens.operators import series
from fleetlens.plans.nulls import join_null_safe
from fleetlens.plans.slicing import MAX_ROWS


def filled(*choices: Column) -> Column:
    """First choice that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def host_names(collections: DataFrame) -> DataFrame:
    """Host name each device reports about itself, per collection time."""
    info = collections.filter((F.col("module") == "system") & (F.col("collection") == "system_info"))
    return (
        info.select("collected_at", "device", F.expr(casts.leaf_text("body", "system", "hostname")).alias("reported"))
        .filter(filled(F.col("reported")).isNotNull())
        .groupBy("collected_at", "device")
        .agg(F.max("reported").alias("reported"))
    )


def resolve_hosts(df: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Host name from the envelope, else reported by the device, else kept in the data, else the device name.

    Rows of snapshots carry both of the first two since they landed (``snapshots.envelopes``) and need no join; ``hosts``
    is for envelopes that landed one by one.
    """
    if hosts is None:
        found = filled(F.col("hostname"), F.col("data_hostname"), F.col("device"))
        return df.withColumn("hostname", found).drop("data_hostname")
    return (
        join_null_safe(df, hosts, ["collected_at", "device"], "left")
        .withColumn("hostname", filled(F.col("hostname"), F.col("reported"), F.col("data_hostname"), F.col("device")))
        .drop("reported", "data_hostname")
    )


def interface_dimension(
    logical: DataFrame, hardware: DataFrame, keys: Sequence[str], position: str, attributes: Sequence[str]
) -> DataFrame:
    """Logical interfaces with attributes of the hardware port of the same name, ``N/A`` without one.
    Of hardware entries with equal names the last one counts."""
    ports = hardware.groupBy(*keys).agg(*[F.max_by(a, position).alias(a) for a in attributes])
    joined = logical.join(ports, list(keys), "left")
    for a in attributes:
        joined = joined.withColumn(a, F.coalesce(F.col(a).cast("string"), F.lit("N/A")))
    return joined


def first_match(df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str]) -> DataFrame:
    """The first entry of each key in source order."""
    packed = F.min_by(F.struct(*[F.col(v) for v in values]), position).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, "_first.*")


def merged_counters(
    wanted: DataFrame,
    primary: DataFrame,
    secondary: DataFrame,
    keys: Sequence[str],
    position: str,
    values: Sequence[str],
) -> DataFrame:
    """Counters of the wanted keys: the first entry of the primary source, its gaps filled from the
    first entry of the secondary one."""
    first = first_match(primary, keys, position, values)
    second = first_match(secondary, keys, position, values).select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    joined = wanted.join(first, list(keys), "left").join(second, list(keys), "left")
    kept = [c for c in wanted.columns if c not in values]
    return joined.select(*kept, *[F.coalesce(v, f"_{v}").alias(v) for v in values])


def hardware_by_name(entries: DataFrame, name: str, interface: str) -> DataFrame:
    """Hardware entries under each name they answer to (own name and interface name)."""
    return entries.select(
        *[c for c in entries.columns if c not in (name, interface)],
        F.explode(F.array_distinct(F.filter(F.array(F.col(name), F.col(interface)), lambda n: n.isNotNull()))).alias(name),
    )


def known_selection(selection: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Selected ids that still exist."""
    return selection.join(known.select(*keys), list(keys), "left_semi")


def zip_by_position(entries: Column, sections: Column) -> Column:
    """Pairs (entry, section) by position; entries without a section keep null, extra sections go."""
    return F.transform(
        entries, lambda e, i: F.struct(i.alias("pos"), e.alias("entry"), F.get(sections, i).alias("section"))
    )


def valid_lookup(
    events: DataFrame,
    intervals: DataFrame,
    key: str,
    ts_us: str,
    tie: str,
    value: str,
    expires: str,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add to each event the latest ``value`` recorded for its key at or before it, while still valid.

    Both inputs carry ``key``, ``ts_us`` and ``tie``; intervals also ``value`` and ``expires``
    (microseconds, exclusive). Intervals are merged into the event order instead of joined by
    range, so no pair of rows is ever formed and a key of any size is cut into slices.
    """
    noted = intervals.select(
        key, ts_us, F.lit(0).alias("_kind"), tie, F.struct(F.col(expires).alias("until"), F.col(value).alias("value")).alias("_note")
    )
    both = (
        events.withColumn("_kind", F.lit(1))
        .unionByName(noted, allowMissingColumns=True)
    )
    carried = series.with_latest(both, F.col("_note"), "_latest", (key,), (ts_us, "_kind", tie), max_rows)
    return (
        carried.filter("_kind = 1")
        .withColumn(value, F.when(F.col(ts_us) < F.col("_latest.until"), F.col("_latest.value")))
        .drop("_kind", "_note", "_latest")
    )


def inventory(
    configured: DataFrame, live: DataFrame, key: str, attributes: dict[str, object]
) -> DataFrame:
    """Configured devices with live attributes first, then configured ones, then a default."""
    renamed = live.select(key, *[F.col(a).alias(f"_live_{a}") for a in attributes])
    joined = configured.join(renamed, key, "left")
    return joined.select(
        key,
        *[F.coalesce(F.col(f"_live_{a}"), F.col(a), F.lit(default)).alias(a) for a, default in attributes.items()],
    )


def substituted(df: DataFrame, dictionary: DataFrame, column: str, category: Column) -> DataFrame:
    """Replace values by their surrogate in (category, original, surrogate); others stay."""
    named = dictionary.select(
        F.col("category").alias("_category"), F.col("original").alias("_original"), "surrogate"
    )
    joined = df.withColumn("_wanted", category).join(
        named, (F.col("_wanted") == F.col("_category")) & (F.col(column) == F.col("_original")), "left"
    )
    return joined.withColumn(column, F.coalesce("surrogate", column)).drop(
        "_wanted", "_category", "_original", "surrogate"
    )
