"""Top entries, first examples, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.naming import natural_key

# Categories and entries shown per report, interfaces shown per device.
SHOWN_CATEGORIES = 5
SHOWN_ENTRIES = 10
SHOWN_INTERFACES = 5


def in_natural_order(df: DataFrame, *names: str) -> DataFrame:
    """Total order by names in which digit runs count as numbers (a distributed range sort)."""
    return df.orderBy(*[natural_key(F.col(n)) for n in names])


def first_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, name: str = "place"
) -> DataFrame:
    """The first ``n`` rows of each group. The limit also runs before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def shown_counters(df: DataFrame, keys: Sequence[str], category: str, position: str) -> DataFrame:
    """First five categories by name, first ten entries of each in source order."""
    names = df.select(*keys, category).distinct()
    shown = first_per_group(names, keys, [F.col(category)], SHOWN_CATEGORIES, "category_place").drop("category_place")
    kept = df.join(shown, [*keys, category], "left_semi")
    return first_per_group(kept, [*keys, category], [F.col(position)], SHOWN_ENTRIES)


def top_by_value(df: DataFrame, groups: Sequence[str], value: str, tie: str, n: int) -> DataFrame:
    return first_per_group(df, groups, [F.col(value).desc(), F.col(tie)], n)


def first_examples(df: DataFrame, groups: Sequence[str], position: str, values: Sequence[str]) -> DataFrame:
    """First example per group in source order."""
    packed = F.min_by(F.struct(*[F.col(v) for v in values]), position).alias("_first")
    return df.groupBy(*groups).agg(packed).select(*groups, "_first.*")


def union_in_order(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts with their place, so output can be ordered by module."""
    out = None
    for place, part in enumerate(parts):
        numbered = part.withColumn("module_place", F.lit(place))
        out = numbered if out is None else out.unionByName(numbered)
    return out


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary rows, and fallback rows of keys the primary source does not cover."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), list(keys), "left_anti"))


def selection_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keep / add / remove for every id of either selection."""
    old = before.select(*keys).distinct().withColumn("_old", F.lit(True))
    new = after.select(*keys).distinct().withColumn("_new", F.lit(True))
    change = F.when(F.col("_old") & F.col("_new"), "keep").when(F.col("_new"), "add").otherwise("remove")
    return old.join(new, list(keys), "full").select(*keys, change.alias("change"))


def distinct_names(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()
