"""Writing and reading points, reports and collection tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.lineproto import line


def lines(points: DataFrame, prefix: str = "", ts_ns: Column | None = None, strict: bool = False) -> DataFrame:
    """Line text of every point; the timestamp is the collection time unless given."""
    stamp = ts_ns if ts_ns is not None else F.unix_micros("collected_at") * 1000
    text = line(F.concat(F.lit(prefix), F.col("measurement")), F.col("tags"), F.col("fields"), stamp, strict)
    return points.select(text.alias("line")).filter(F.col("line").isNotNull())


def write_lines(points: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    lines(points, **options).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_points(
    df: DataFrame, path: str, mode: str = "overwrite", partitions: Sequence[str] = ("measurement", "dt")
) -> None:
    """Points or long metrics as Parquet by measurement and day.

    ``overwrite`` replaces the folders that ``df`` has rows for and leaves all others.
    The rebalance hint gathers each folder's rows into few files and lets AQE split the folder of a
    measurement that holds most of the rows over many tasks.
    """
    with_day = df if "dt" in df.columns else df.withColumn("dt", F.to_date("collected_at"))
    writer = with_day.hint("rebalance", *partitions).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).parquet(path)


def read_points(
    spark: SparkSession, path: str, measurements: Sequence[str] | None = None, since: str | None = None
) -> DataFrame:
    """Points of some measurements and days; both filters prune folders."""
    df = spark.read.parquet(path)
    if measurements is not None:
        df = df.filter(F.col("measurement").isin(*measurements))
    if since is not None:
        df = df.filter(F.col("dt") >= F.lit(since).cast("date"))
    return df


def write_collections(df: DataFrame, path: str, mode: str = "append", gather: bool = True) -> None:
    """Collection rows by module and collection, so a measurement reads only its own folder.

    ``gather`` puts a collection's rows into few files, cut by their bytes. Without it every task writes its own rows, so
    those who read a folder, whose work is by the row, find files for all cores.
    """
    keys = ("module", "collection")
    (df.hint("rebalance", *keys) if gather else df).write.mode(mode).partitionBy(*keys).parquet(path)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
