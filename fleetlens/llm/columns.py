"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The whole text as a string; null counts as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns packed into one struct, so that no working column can clash with a name of the input."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def unpacked(df: DataFrame, row: str) -> DataFrame:
    """The columns that ``whole_row`` packed, as they were."""
    return df.select(f"{row}.*")


def without_overlaps(spans: Column) -> Column:
    """Of an array of structs with ``first`` and ``last``, best ones first, those that overlap no better one that stays."""

    def taken(kept: Column, span: Column) -> Column:
        met = F.exists(kept, lambda k: (k["first"] <= span["last"]) & (span["first"] <= k["last"]))
        return F.when(met, kept).otherwise(F.concat(kept, F.array(span)))

    return F.aggregate(spans, F.slice(spans, 1, 0), taken)
