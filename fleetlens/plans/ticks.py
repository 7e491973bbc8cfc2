"""Telemetry views derived from the event table, the way a collector would have landed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.plans.slicing import running_sum, slice_hot
from fleetlens.session import prepare

WRAP = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str, per_core: int = 1) -> DataFrame:
    """Rows over at least ``per_core`` partitions for each core, for work that is heavy per row.

    Only a table smaller than the cluster is shuffled (a single small file gives one partition); a
    large one already comes in many splits and is returned as it is. Splits of a file may hold very different numbers of
    rows, so tables of which few columns are read ask for more than one partition a core. The filter lets every row pass
    and stays behind the shuffle, so no later filter, whose expressions are the heavy work, moves before it.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism * per_core
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys).filter(F.spark_partition_id() >= 0)


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls: device, interface, time, amount."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device"),
        F.col("event_type").alias("iface"),
        micros("ts").alias("ts_us"),
        "event_id",
        F.round(F.col("value") * 100).cast("bigint").alias("octets"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative octet counter per (device, iface) that wraps at 50,000; hot keys already sliced."""
    keys, order = ("device", "iface"), ("ts_us", "event_id")
    cut = slice_hot(polls(spark, sf_dir), keys, order)
    return (
        running_sum(cut, keys, order, F.col("octets"), "_total")
        .withColumn("c_octets", F.col("_total") % WRAP)
        .drop("_total")
    )
