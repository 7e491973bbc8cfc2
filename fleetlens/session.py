"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options that change results or plans; safe to call on a shared session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # Landed bodies are read whole, so columns split from them on writing would only be put together again.
    spark.conf.set("spark.sql.variant.inferShreddingSchema", "false")
    # Read as it is; the older form of times has to be computed for every row.
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables that cut lineage and for streaming state.

    The cluster names it in ``spark.checkpoint.dir``; a temporary folder is used only where that
    is unset, which is the single-machine test case.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    fallback = os.path.join(tempfile.gettempdir(), "fleetlens-work")
    spark.conf.set("fleetlens.work.dir", fallback)
    return fallback


def run_dir(spark: SparkSession, label: str) -> str:
    """A folder of this run's own below the shared one."""
    import uuid

    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context.

    Functions that run in Python workers are pickled by name, so a worker must be able to import the package. Clusters
    with the package installed, or given it by ``--py-files``, need no call.
    """
    import shutil

    context = spark.sparkContext
    if getattr(context, "_fleetlens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="fleetlens-")
    archive = shutil.make_archive(
        os.path.join(folder, "fleetlens"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    context._fleetlens_shipped = True


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fleetlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
