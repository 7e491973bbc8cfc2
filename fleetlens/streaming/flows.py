"""Continuous ingest, rollups, selection and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators import joins, project
from fleetlens.operators.specs import KNOWN_COLLECTIONS
from fleetlens.sources import snapshots, store


def bucket_means(
    stream: DataFrame, value: str, keys: Sequence[str], width: str = "5 minutes", delay: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Tumbling-window totals and mean per key; rows later than ``delay`` are dropped.

    State is one row per open window and key, filled by partial aggregation before the shuffle.
    """
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return (
        stamped.groupBy(F.window(ts, width).alias("bucket"), *keys)
        .agg(F.count("*").alias("samples"), F.sum(value).alias("total"))
        .select(
            *keys,
            F.unix_micros("bucket.start").alias("bucket_us"),
            "samples",
            "total",
            (F.col("total").cast("double") / F.col("samples")).alias("mean_value"),
        )
    )


def without_repeats(stream: DataFrame, keys: Sequence[str], delay: str, ts: str = "ts") -> DataFrame:
    """Samples repeated within ``delay`` are passed once."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return stamped.dropDuplicatesWithinWatermark([*keys, ts])


def selected_only(batch: DataFrame, selection: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of selected keys."""
    return batch.join(selection.select(*keys).distinct(), list(keys), "left_semi")


def selecting(
    read_selection: Callable[[SparkSession], DataFrame], keys: Sequence[str], write: Callable[[DataFrame, int], None]
):
    """Writer that passes on the rows of keys selected now: the selection is read anew for every micro-batch."""

    def pick(batch: DataFrame, batch_id: int) -> None:
        write(selected_only(batch, read_selection(batch.sparkSession), keys), batch_id)

    return pick


def points_of(collections: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Points of the collection rows of a micro-batch, by the batch functions.

    Which known collections occur is looked up first, so the plan holds only passes that have something to read. A
    host name is the envelope's own, that kept in its data, one of the stored table ``hosts`` (collected_at,
    device, reported), or the device's: never one that happens to be in the same micro-batch, so the points are the
    same however files are grouped.
    """
    known = sorted(KNOWN_COLLECTIONS)
    present = {row[0] for row in collections.select("collection").filter(F.col("collection").isin(known)).distinct().collect()}
    reported = hosts if hosts is not None else joins.host_names(collections.limit(0))
    return project.with_hostname(project.points(collections, present=present), reported)


def with_points(
    envelopes: DataFrame, use: Callable[[DataFrame], None], hosts: DataFrame | None = None, several: bool = True
) -> None:
    """``use`` the points of a micro-batch of envelopes, which is parsed once.

    Points are kept while ``use`` goes on if it reads them ``several`` times; they are many times larger than the
    collections, so whoever reads them once takes them as they are made.
    """
    collections = snapshots.collections(envelopes).persist()
    try:
        points = points_of(collections, hosts)
        if several:
            points.persist()
        try:
            use(points)
        finally:
            if several:
                points.unpersist()
    finally:
        collections.unpersist()


def each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = True
) -> StreamingQuery:
    """Run ``write(batch, batch_id)`` per micro-batch; ``once`` stops after what is there now."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_folder_per_batch(path: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Writer that replaces the folder of its batch, so a repeated batch is not written twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Points or metrics by measurement, day and batch; a repeated batch replaces its own folders only."""
    dated = df.withColumn("dt", F.to_date("collected_at")).withColumn("batch_id", F.lit(batch_id))
    store.write_points(dated, path, partitions=("measurement", "dt", "batch_id"))


def to_lines_and_metrics(line_path: str, metric_path: str, prefix: str = "", hosts: DataFrame | None = None):
    """Line text and Parquet metrics of the same envelopes: lines by batch, metrics by measurement, day and batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        def both(points: DataFrame) -> None:
            store.write_lines(points, f"{line_path}/batch_id={batch_id}", prefix=prefix)
            write_batch(project.long_metrics(points), metric_path, batch_id)

        with_points(batch, both, hosts)

    return write


def ingest(
    spark: SparkSession, landing: str, target: str, checkpoint: str, once: bool = True, files_per_trigger: int = 1000,
    hosts: DataFrame | None = None,
) -> StreamingQuery:
    """Landed envelope files to long metrics, exactly once per file."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with_points(batch, lambda points: write_batch(project.long_metrics(points), target, batch_id), hosts, several=False)

    stream = snapshots.read_envelopes(spark, landing, streaming=True, files_per_trigger=files_per_trigger)
    return each_batch(stream, write, checkpoint, once=once)
