"""Consecutive numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block, and blocks in a stretch.
BLOCK = 1_000_000
STRETCH = 1_000_000


def number_within(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "number", block: int = BLOCK,
    stretch: int = STRETCH,
) -> DataFrame:
    """Number the rows of each group 1, 2, 3, … by ``order``.

    The first order column is a whole number (a first-seen position). Positions are cut into
    blocks of fixed width and blocks into stretches; rows are numbered inside (group, block), and the sizes of earlier
    blocks of the stretch and of earlier stretches are added. So neither a group nor the whole table meets in one
    task, be positions dense or as far apart as timestamps, and the result does not depend on task retries.
    """
    blocked = df.withColumn("_block", F.expr(f"{order[0]} div {block}"))
    sizes = blocked.groupBy(*groups, "_block").agg(F.count("*").alias("_size")).withColumn("_stretch", F.expr(f"_block div {stretch}"))
    before = Window.unboundedPreceding, -1
    in_stretch = Window.partitionBy(*groups, "_stretch").orderBy("_block").rowsBetween(*before)
    in_group = Window.partitionBy(*groups).orderBy("_stretch").rowsBetween(*before)
    stretches = (
        sizes.groupBy(*groups, "_stretch").agg(F.sum("_size").alias("_all"))
        .withColumn("_ahead", F.coalesce(F.sum("_all").over(in_group), F.lit(0))).drop("_all")
    )
    offsets = (
        sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(in_stretch), F.lit(0)))
        .join(stretches, [*groups, "_stretch"])
        .select(*groups, "_block", (F.col("_offset") + F.col("_ahead")).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*groups, "_block").orderBy(*order))
    return (
        blocked.withColumn("_inside", inside)
        .join(offsets, [*groups, "_block"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_block", "_inside", "_offset")
    )
