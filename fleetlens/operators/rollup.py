"""Counts, ratios, buckets and other grouped summaries.

Everything aggregates on the map side first, so the size of a group does not matter; open-ended
names stay rows (or a map per row) instead of becoming columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from fleetlens.functions.naming import protocol_name, protocol_of_flags
from fleetlens.plans.nulls import join_null_safe

# Smallest category that becomes a measurement, protocols shown on their own.
MIN_CATEGORY = 5
SHOWN_PROTOCOLS = ("bgp", "static", "connected")


def time_buckets(df: DataFrame, keys: Sequence[str], seconds: int, ts_us: str = "ts_us") -> GroupedData:
    """Group by keys and the start of a fixed-width bucket (``bucket_us``)."""
    width = seconds * 1_000_000
    return df.withColumn("bucket_us", F.col(ts_us) - F.pmod(F.col(ts_us), F.lit(width))).groupBy(*keys, "bucket_us")


def last_interval(df: DataFrame, seconds: int, ts_us: str = "ts_us") -> DataFrame:
    """Rows newer than the newest row less ``seconds``. The bound is one value, computed once."""
    newest = df.agg((F.max(ts_us) - seconds * 1_000_000).alias("since"))
    return df.filter(F.col(ts_us) > newest.scalar())


def bucket_stats(df: DataFrame, value: str, keys: Sequence[str], seconds: int, ts_us: str = "ts_us") -> DataFrame:
    return time_buckets(df, keys, seconds, ts_us).agg(
        (F.sum(value).cast("double") / F.count(value)).alias("mean_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.sum(value).alias("sum_value"),
        F.count(value).alias("samples"),
        F.min_by(value, F.struct(ts_us, value)).alias("first_value"),
        F.max_by(value, F.struct(ts_us, value)).alias("last_value"),
    )


def fleet_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], **totals: Column) -> DataFrame:
    """Totals over the latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    latest = df.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return latest.agg(*[total.alias(name) for name, total in totals.items()])


def route_protocol(protocol: Column, flags: Column) -> Column:
    """Named protocol, else the one the flags stand for, as a field-safe name."""
    named = F.when(protocol.isNotNull() & (protocol != ""), protocol)
    return protocol_name(F.coalesce(named, protocol_of_flags(F.coalesce(flags, F.lit("")))))


def protocol_counts(routes: DataFrame, keys: Sequence[str], protocol: Column) -> DataFrame:
    """Routes per key and protocol, long form."""
    return routes.groupBy(*keys, protocol.alias("protocol")).agg(F.count("*").alias("routes"))


def protocol_fields(routes: DataFrame, keys: Sequence[str], protocol: Column) -> DataFrame:
    """One row per key with a ``routes_<protocol>`` map and the total; the protocol set is open."""
    return (
        protocol_counts(routes, keys, protocol)
        .groupBy(*keys)
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct(F.concat(F.lit("routes_"), F.col("protocol")), F.col("routes")))
            ).alias("routes_by_protocol"),
            F.sum("routes").alias("routes_total"),
        )
    )


def shown_protocols(routes: DataFrame, keys: Sequence[str], protocol: Column) -> DataFrame:
    """Total, the three protocols shown on their own, and all the rest."""
    return routes.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *[F.count_if(protocol == p).alias(p) for p in SHOWN_PROTOCOLS],
        F.count_if(~protocol.isin(*SHOWN_PROTOCOLS)).alias("other"),
    )


def row_totals(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def category_counters(
    entries: DataFrame,
    keys: Sequence[str],
    category: Column,
    name: Column,
    values: Sequence[str],
    position: str,
    min_entries: int = MIN_CATEGORY,
) -> DataFrame:
    """Counter entries of categories with at least ``min_entries`` entries, one row per counter.

    Entries are first reduced to one per name (the last one counts, unnamed ones only count towards
    the size), so what is joined back is one small row per (key, category).
    """
    named = entries.withColumn("category", F.coalesce(category, F.lit("other"))).withColumn("counter", name)
    reduced = named.groupBy(*keys, "category", "counter").agg(
        F.count("*").alias("_entries"), *[F.max_by(v, position).alias(v) for v in values]
    )
    sizes = (
        reduced.groupBy(*keys, "category")
        .agg(F.sum("_entries").alias("_size"))
        .filter(F.col("_size") >= min_entries)
        .drop("_size")
    )
    kept = reduced.filter(F.coalesce(F.col("counter"), F.lit("")) != "").drop("_entries")
    return join_null_safe(kept, sizes, [*keys, "category"])


def peer_states(peers: DataFrame, state: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Peers by state class, with the strict established/down split."""
    lower = F.lower(F.coalesce(state, F.lit("Unknown")))
    established = F.contains(lower, F.lit("established"))
    active = ~established & F.contains(lower, F.lit("active"))
    return peers.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(established).alias("established"),
        F.count_if(active).alias("active"),
        F.count_if(~established & ~active).alias("inactive"),
        (F.count("*") - F.count_if(F.coalesce(state == "Established", F.lit(False)))).alias("down"),
    )


def success_ratio(envelopes: DataFrame, keys: Sequence[str], success: Column) -> DataFrame:
    """Successful share per key and its class."""
    ok = F.count_if(F.coalesce(success, F.lit(False)))
    return envelopes.groupBy(*keys).agg(
        ok.alias("ok"),
        F.count("*").alias("total"),
        F.when(ok == F.count("*"), "all").when(ok > 0, "some").otherwise("none").alias("status"),
    )


def conversion_stats(points: DataFrame, failures: DataFrame, module: str = "module") -> DataFrame:
    """Lines and errors per module with the overall totals under ``all``."""
    lines = points.groupBy(module).agg(F.count("*").alias("lines"), F.lit(0).cast("bigint").alias("errors"))
    errors = failures.groupBy(module).agg(F.lit(0).cast("bigint").alias("lines"), F.count("*").alias("errors"))
    return (
        lines.unionByName(errors)
        .rollup(module)
        .agg(F.sum("lines").alias("lines"), F.sum("errors").alias("errors"))
        .withColumn(module, F.coalesce(module, F.lit("all")))
    )


def enabled_counts(devices: DataFrame, enabled: Column, keys: Sequence[str] = ()) -> DataFrame:
    return devices.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(enabled).alias("enabled"), F.count_if(~enabled).alias("disabled")
    )


def core_balance(cores: DataFrame, keys: Sequence[str], core: str, load: str) -> DataFrame:
    """Imbalance, mean and hottest core per key; of equally hot cores the lowest id."""
    return cores.groupBy(*keys).agg(
        (F.max(load) - F.min(load)).alias("imbalance"),
        F.avg(load).alias("mean_load"),
        F.max(F.struct(F.col(load).alias("load"), (-F.col(core)).alias("neg_core"))).alias("_hot"),
    ).select(*keys, "imbalance", "mean_load", (-F.col("_hot.neg_core")).alias("hottest_core"))


def error_total(rx: Column, tx: Column) -> Column:
    return F.coalesce(rx, F.lit(0)) + F.coalesce(tx, F.lit(0))


def counts_with_total(df: DataFrame, key: str, name: str = "n", total_label: str = "total") -> DataFrame:
    """Count per key plus one row for all of them."""
    return (
        df.rollup(key).agg(F.count("*").alias(name)).withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit(total_label)))
    )


def points_per_collection(points: DataFrame, collection: str = "collected_at") -> DataFrame:
    """Points per measurement, device and collection."""
    return points.groupBy("measurement", "device", collection).agg(F.count("*").alias("points"))
