"""Text encoding of points: ``measurement,tag=value field=value timestamp``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(value: Column) -> Column:
    """Commas, equal signs and spaces of names and tag values get a backslash."""
    return F.regexp_replace(value, "([,= ])", r"\\$1")


def float_text(value: Column) -> Column:
    """Shortest round-trip text of a double: ``12345678.9``, ``0.0001``, ``1e+16``, ``inf``."""
    raw = value.cast("string")
    plain = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    exponent = F.substring_index(raw, "E", -1)
    digits = F.lpad(F.regexp_replace(exponent, "^-", ""), 2, "0")
    wide_digits = F.when(F.length(F.regexp_replace(exponent, "^-", "")) > 2, F.regexp_replace(exponent, "^-", ""))
    sign = F.when(exponent.startswith("-"), "-").otherwise("+")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.coalesce(wide_digits, digits))
    size = F.abs(value)
    return (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .when(size == 0, raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def field_text(value: Column, strict: bool = False) -> Column:
    """Literal of a typed field value struct; strings escape quotes, ``strict`` also ``\\`` and newlines."""
    text = value["v_str"]
    if strict:
        text = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), "\n", r"\\n")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.coalesce(
        F.when(value["v_bool"], "true").when(~value["v_bool"], "false"),
        F.concat(value["v_int"].cast("string"), F.lit("i")),
        float_text(value["v_dbl"]),
        quoted,
    )


def live_tags(tags: Column) -> Column:
    """Tags without null or empty values."""
    return F.map_filter(tags, lambda _, value: value.isNotNull() & (value != ""))


def live_fields(fields: Column) -> Column:
    """Fields that carry a value."""
    return F.map_filter(
        fields,
        lambda _, v: F.coalesce(
            v["v_bool"].cast("string"), v["v_int"].cast("string"), v["v_dbl"].cast("string"), v["v_str"]
        ).isNotNull(),
    )


def sorted_pairs(entries: Column) -> Column:
    """Map entries in key order."""
    return F.array_sort(F.map_entries(entries))


def line(
    measurement: Column, tags: Column, fields: Column, ts_ns: Column, strict: bool = False
) -> Column:
    """One line per point, keys in order; null when no field carries a value."""
    tag_names = F.array_sort(F.map_keys(live_tags(tags)))
    field_names = F.array_sort(F.map_keys(live_fields(fields)))
    tag_text = F.array_join(
        F.transform(tag_names, lambda k: F.concat(F.lit(","), escaped(k), F.lit("="), escaped(tags[k]))), ""
    )
    fields_text = F.array_join(
        F.transform(
            field_names,
            lambda k: F.concat(escaped(k), F.lit("="), field_text(fields[k], strict)),
        ),
        ",",
    )
    return F.when(
        F.size(field_names) > 0,
        F.concat(escaped(measurement), tag_text, F.lit(" "), fields_text, F.lit(" "), ts_ns.cast("string")),
    )
