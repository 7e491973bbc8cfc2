"""Tables in the shared folder that cut lineage, and joins that broadcast ids only behind a check of their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import run_dir

#: Ids (long) that may be sent to every executor: about 24 MB as a hash table.
BROADCAST_IDS = 1_000_000
#: Bytes of rows that Spark hands to a Python worker at once; both hold each heap several times over. Spark's own bound is
#: 64 MB or 10,000 rows, which is 33 MB of the given documents.
HEAP = 4 << 20


def small_heaps(spark: SparkSession) -> None:
    """Rows go to Python workers ``HEAP`` bytes at a time from now on (a single row may be larger)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", HEAP)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the folder that all executors share, and read again."""
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_side(ids: DataFrame, most: int | None = None) -> DataFrame:
    """A table of ids for one side of a join; hinted for broadcast if its counted rows are ``most`` at most
    (BROADCAST_IDS unless given)."""
    return F.broadcast(ids) if ids.count() <= (BROADCAST_IDS if most is None else most) else ids
