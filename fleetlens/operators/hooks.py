"""User code per envelope and SQL access to the expressions."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from fleetlens.functions import casts, netaddr

OUTCOME = "success boolean, data string, error string"


def per_envelope(df: DataFrame, operation: Callable[[dict], str | None], keys: list[str]) -> DataFrame:
    """Run ``operation`` on every row (as a dict); a failure becomes that row's error.

    Rows pass through in Arrow batches where they are: nothing is grouped or shuffled, so the
    share of one device does not matter.
    """

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for record in batch.to_dict("records"):
                own = [record[k] for k in keys]
                try:
                    out.append((*own, True, operation(record), None))
                except Exception as error:  # noqa: BLE001 - isolated per row by design
                    reason = traceback.format_exception_only(error)[-1].strip()
                    out.append((*own, False, None, reason))
            yield pd.DataFrame(out, columns=[*keys, "success", "data", "error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    return df.select(*keys, *[c for c in df.columns if c not in keys]).mapInPandas(run, f"{kept}, {OUTCOME}")


FIELD = "STRUCT<v_bool: BOOLEAN, v_int: BIGINT, v_dbl: DOUBLE, v_str: STRING>"


def _escaped(value: str) -> str:
    return rf"regexp_replace({value}, r'([,= ])', r'\\$1')"


def _double_literal(value: str) -> str:
    """Shortest text that reads back as the same double, with the exponent from 1e16 and below 1e-4."""
    text = f"cast({value} as string)"
    plain = f"regexp_replace(regexp_replace(cast(try_cast({text} as decimal(38,20)) as string), '0+$', ''), '[.]$', '.0')"
    power = f"cast(substring_index({text}, 'E', -1) as int)"
    wide = (
        f"concat(regexp_replace(substring_index({text}, 'E', 1), '[.]0$', ''), 'e', if({power} < 0, '-', '+'), "
        f"if(abs({power}) < 10, '0', ''), abs({power}))"
    )
    return (
        f"CASE WHEN isnan({value}) THEN 'nan' WHEN {value} = double('inf') THEN 'inf' WHEN {value} = double('-inf') THEN '-inf' "
        f"WHEN {value} = 0 THEN {text} WHEN abs({value}) >= 1e-4 AND abs({value}) < 1e16 THEN {plain} ELSE {wide} END"
    )


def _literal(value: str) -> str:
    return (
        f"coalesce(cast({value}.v_bool as string), concat({value}.v_int, 'i'), "
        f"CASE WHEN {value}.v_dbl IS NOT NULL THEN {_double_literal(value + '.v_dbl')} END, "
        f"concat('\"', replace({value}.v_str, '\"', '\\\\\"'), '\"'))"
    )


# The SQL text of the helpers that are offered as SQL functions.
SQL_FUNCTIONS = {
    "safe_int(x STRING) RETURNS BIGINT": casts.int_of_text("x"),
    "safe_float(x STRING) RETURNS DOUBLE": casts.float_of_text("x"),
    "size_gb(x STRING) RETURNS DOUBLE": casts.gigabytes_of_text("x"),
    "percent(x STRING) RETURNS DOUBLE": casts.percent_of_text("x"),
    "yes_no(x STRING) RETURNS BOOLEAN": casts.yes_no("x"),
    "escape_key(x STRING) RETURNS STRING": r"regexp_replace(x, r'([,= ])', r'\\$1')",
    "safe_key(x STRING) RETURNS STRING": r"regexp_replace(x, r'[^a-zA-Z0-9_\-]', '_')",
    "natural_key(x STRING) RETURNS STRING": (
        "array_join(transform(regexp_extract_all(x, r'([0-9]+|[^0-9]+)', 1), run -> "
        "CASE WHEN run RLIKE '^[0-9]' THEN concat(format_string('%010d', length(regexp_replace(run, r'^0+(?=[0-9])', ''))), "
        "regexp_replace(run, r'^0+(?=[0-9])', '')) ELSE run END), '')"
    ),
    "route_protocol(protocol STRING, flags STRING) RETURNS STRING": (
        "replace(trim(lower(coalesce(nullif(protocol, ''), CASE WHEN contains(flags, 'B') THEN 'bgp' "
        "WHEN contains(flags, 'S') THEN 'static' WHEN contains(flags, 'C') THEN 'connected' "
        "WHEN contains(flags, 'O') THEN 'ospf' WHEN contains(flags, 'R') THEN 'rip' ELSE 'other' END))), ' ', '_')"
    ),
    "documentation_ip(n BIGINT) RETURNS STRING": (
        "CASE WHEN n <= 762 THEN concat(element_at(array('192.0.2.', '198.51.100.', '203.0.113.'), "
        "cast((n - 1) div 254 + 1 as int)), (n - 1) % 254 + 1) "
        "WHEN n < 65536 THEN concat('198.18.', n div 256 % 256, '.', n % 256) "
        "ELSE concat_ws('.', (4026531840 + n) div 16777216 % 256, (4026531840 + n) div 65536 % 256, "
        "(4026531840 + n) div 256 % 256, (4026531840 + n) % 256) END"
    ),
    f"field_literal(v {FIELD}) RETURNS STRING": _literal("v"),
    f"line(measurement STRING, tags MAP<STRING, STRING>, fields MAP<STRING, {FIELD}>, ts BIGINT) RETURNS STRING": (
        f"CASE WHEN exists(map_values(fields), f -> {_literal('f')} IS NOT NULL) THEN concat("
        f"{_escaped('measurement')}, array_join(transform(array_sort(map_keys(map_filter(tags, (k, t) -> t <> ''))), "
        f"k -> concat(',', {_escaped('k')}, '=', {_escaped('tags[k]')})), ''), ' ', "
        f"array_join(transform(array_sort(map_keys(map_filter(fields, (k, f) -> {_literal('f')} IS NOT NULL))), "
        f"k -> concat({_escaped('k')}, '=', {_literal('fields[k]')})), ','), ' ', ts) END"
    ),
    "identity_ip(x STRING) RETURNS STRING": netaddr.identity_ip("x"),
    "remaining_percent(remain BIGINT, life BIGINT) RETURNS DOUBLE": casts.share_left("remain", "life"),
}


def register_sql_functions(spark: SparkSession, prefix: str = "fleet_") -> list[str]:
    """Create the helpers as temporary SQL functions; they are inlined by the optimizer."""
    names = []
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURN {body}")
        names.append(prefix + signature.split("(")[0])
    return names
