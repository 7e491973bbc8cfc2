"""Measurement catalog computed from the metrics themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import glossary
from fleetlens.operators.specs import MEASUREMENTS

# Most points per device and collection that still count as low and medium.
LOW_POINTS = 1
MEDIUM_POINTS = 100
LABELS = ("boolean", "float", "integer", "string")


def unit(key: Column) -> Column:
    """Unit of a field that the glossary does not know, by the end of its name; null where none is known."""
    out = F.lit(None).cast("string")
    for end, name in reversed(glossary.UNIT_BY_END):
        out = F.when(key.endswith(end), name).otherwise(out)
    return out


def words(key: Column) -> Column:
    """A name as words, which is what a field of an unknown measurement is described by."""
    return F.trim(F.regexp_replace(key, "[_-]+", " "))


def descriptions(spark: SparkSession) -> DataFrame:
    """The static table of all measurements of this library: what they hold, module, how often, notes."""
    rows = [
        (m.name, *glossary.MEASUREMENT_TEXTS[m.name], m.module, f"{len(m.fields) + len(m.computed)} fields of {m.collection}")
        for m in sorted(MEASUREMENTS.values(), key=lambda m: m.name)
    ]
    table = spark.createDataFrame(rows, "measurement string, description string, update_frequency string, category string, notes string")
    return table.select("measurement", "description", "category", "update_frequency", "notes")


def field_texts(spark: SparkSession) -> DataFrame:
    """Unit and description of every tag and field of this library's measurements: (measurement, role, key, unit, text)."""
    rows = []
    for m in MEASUREMENTS.values():
        tags = {t[0] for t in m.tags} | set(m.computed_tags) | ({m.key_tag} if m.key_tag else set())
        rows += [(m.name, "tag", name, None, glossary.text(name)) for name in sorted(tags | {"hostname"})]
        names = [f[0] for f in m.fields] + list(m.computed)
        rows += [(m.name, "field", name, glossary.unit(m.name, name), glossary.text(name)) for name in names]
    return spark.createDataFrame(rows, "measurement string, role string, key string, unit string, text string")


def value_profile(
    long: DataFrame, groups: Sequence[str], value: str, kind: Column, position: str
) -> DataFrame:
    """Per group: rows, distinct values, types seen, first example.

    Aggregated in two steps, first per (group, value), so a group of any size spreads over all
    tasks by its values. Types travel as bits, which keeps the first step a plain hash aggregate.
    """
    bit = F.lit(0)
    for place, label in enumerate(LABELS):
        bit = F.when(kind == label, 1 << place).otherwise(bit)
    per_value = long.groupBy(*groups, F.col(value).alias("_value")).agg(
        F.count("*").alias("_rows"), F.min(position).alias("_first"), F.bit_or(bit).alias("_kinds")
    )
    seen = F.array_compact(
        F.array(*[F.when(F.bit_or("_kinds").bitwiseAND(1 << p) > 0, label) for p, label in enumerate(LABELS)])
    )
    return per_value.groupBy(*groups).agg(
        F.sum("_rows").alias("rows"),
        F.count("_value").alias("distinct_values"),
        seen.alias("types"),
        F.min_by("_value", F.when(F.col("_value").isNotNull(), F.struct("_first", "_value"))).alias("example"),
    )


def type_conflicts(long: DataFrame, groups: Sequence[str], kind: Column) -> DataFrame:
    """Fields seen with more than one type."""
    seen = long.select(*groups, kind.alias("_kind")).filter(F.col("_kind").isNotNull()).distinct()
    return (
        seen.groupBy(*groups)
        .agg(F.count("*").alias("types"), F.array_join(F.array_sort(F.collect_set("_kind")), ",").alias("seen"))
        .filter(F.col("types") > 1)
    )


def cardinality_class(points: Column, medium: int = MEDIUM_POINTS) -> Column:
    return F.when(points <= LOW_POINTS, "low").when(points <= medium, "medium").otherwise("high")


def cardinality(points: DataFrame, name: str = "measurement", per: Sequence[str] = ("device", "collected_at")) -> DataFrame:
    """Largest number of points per device and collection, and its class."""
    counted = points.groupBy(name, *per).agg(F.count("*").alias("_n"))
    return counted.groupBy(name).agg(F.max("_n").alias("points_per_collection")).withColumn(
        "cardinality", cardinality_class(F.col("points_per_collection"))
    )


def catalog(points: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One row per measurement: category, tags and fields with type, first example, unit and words, cardinality, notes.

    The first example is that of the earliest collection, of equal ones the first device, then the smallest text.
    ``points`` are point rows (``project.points``); ``descriptions`` is the static table
    ``(measurement, description, category, update_frequency, notes)``.
    """
    stamped = points.withColumn("_pos", F.struct("collected_at", "device"))
    tag_rows = stamped.select(
        "measurement", "_pos", F.explode("tags").alias("key", "text")
    ).select("*", F.lit("tag").alias("role"), F.lit("string").alias("kind"))
    field_rows = stamped.select("measurement", "_pos", F.explode("fields").alias("key", "v")).select(
        "measurement",
        "_pos",
        "key",
        F.coalesce(
            F.col("v.v_bool").cast("string"), F.col("v.v_int").cast("string"), F.col("v.v_dbl").cast("string"), F.col("v.v_str")
        ).alias("text"),
        F.lit("field").alias("role"),
        F.when(F.col("v.v_bool").isNotNull(), "boolean")
        .when(F.col("v.v_int").isNotNull(), "integer")
        .when(F.col("v.v_dbl").isNotNull(), "float")
        .otherwise("string")
        .alias("kind"),
    )
    keys = value_profile(
        tag_rows.unionByName(field_rows), ("measurement", "role", "key"), "text", F.col("kind"), "_pos"
    )
    keys = keys.join(
        field_texts(points.sparkSession).withColumnsRenamed({"unit": "_unit", "text": "_text"}), ["measurement", "role", "key"], "left"
    )
    known = F.col("_text").isNotNull()
    found = F.when(known, F.col("_unit")).otherwise(F.when(F.col("role") == "field", unit(F.col("key"))))
    described = F.struct(
        F.col("key"), F.array_join("types", "|").alias("type"), F.col("example"), F.col("distinct_values"),
        found.alias("unit"), F.coalesce("_text", words(F.col("key"))).alias("description"),
    )
    gathered = keys.groupBy("measurement").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "tag", described))).alias("tags"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "field", described))).alias("fields"),
    )
    return gathered.join(cardinality(points), "measurement", "left").join(descriptions, "measurement", "left")


def summary(catalog_rows: DataFrame) -> DataFrame:
    """Totals per category and over all of them: measurements, tags, fields, cardinality histogram."""
    return (
        catalog_rows.rollup("category")
        .agg(
            F.count("*").alias("measurements"),
            F.sum(F.size("tags")).alias("tags"),
            F.sum(F.size("fields")).alias("fields"),
            *[F.count_if(F.col("cardinality") == c).alias(f"{c}_cardinality") for c in ("low", "medium", "high")],
        )
        .withColumn("category", F.coalesce("category", F.lit("all")))
    )


def written(catalog_rows: DataFrame, path: str) -> None:
    catalog_rows.write.mode("overwrite").json(path)
