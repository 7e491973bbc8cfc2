"""Jobs that turn raw command output (text rows) into typed rows. All expressions run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import casts

# What the lines of a process summary begin with, and the metric of each label that follows a number.
PROCESS_LABELS = (
    (
        1,
        "Tasks",
        "bigint",
        {"total": "tasks_total", "running": "tasks_running", "sleeping": "tasks_sleeping", "stopped": "tasks_stopped", "zombie": "tasks_zombie"},
    ),
    (
        2,
        "%Cpu(s)",
        "double",
        {
            "us": "cpu_user", "sy": "cpu_system", "ni": "cpu_nice", "id": "cpu_idle", "wa": "cpu_iowait",
            "hi": "cpu_hardware_interrupt", "si": "cpu_software_interrupt", "st": "cpu_steal",
        },
    ),
    (
        3,
        "MiB Mem",
        "double",
        {"total": "memory_total_mib", "free": "memory_free_mib", "used": "memory_used_mib", "buff/cache": "memory_buff_cache_mib"},
    ),
    (
        4,
        "MiB Swap",
        "double",
        {"total": "swap_total_mib", "free": "swap_free_mib", "used": "swap_used_mib", "avail Mem": "memory_available_mib"},
    ),
)
UPTIME = ("uptime_days", "uptime_hours", "uptime_minutes")
LOADS = ("load_average_1min", "load_average_5min", "load_average_15min")
NAMED_NUMBER = r"^(.+?)\s*:\s*([0-9]+)$"
PORTAL_MESSAGES = {
    "total_messages_dp_to_mp": "Total messages DP => MP",
    "total_invalid_messages_dp_to_mp": "Total Invalid messages DP => MP",
    "failed_to_read_messages_dp_to_mp": "Failed to read messages DP => MP",
}
GATEWAY_STATISTICS = {
    "current_user": "current-user",
    "gateway_max_concurrent_tunnel": "gateway-max-concurrent-tunnel",
    "gateway_successful_ip_sec_connections": "gateway-successful-ip-sec-connections",
    "successful_gateway_connections": "successful-gateway-connections",
    "gateway_max_tunnel_setup_rate": "gateway-max-tunnel-setup-rate",
    "record_gateway_tunnel_count": "record-gateway-tunnel-count",
    "record_gateway_tunnel_count_last_check_time": "record-gateway-tunnel-count-last-check-time",
}


def _stripped(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\r\f\v"))


def lines(df: DataFrame, text: Column, keys: Sequence[str]) -> DataFrame:
    """One row per line of the stripped text: keys, ``line_no``, ``line`` (itself stripped)."""
    return df.select(*keys, F.posexplode(F.split(_stripped(text), "\n")).alias("line_no", "line")).withColumn(
        "line", _stripped(F.col("line"))
    )


def _all_or_none(values: dict[str, Column]) -> dict[str, Column]:
    """The values if every one of them is there, else nulls."""
    whole = F.lit(True)
    for value in values.values():
        whole = whole & value.isNotNull()
    return {name: F.when(whole, value) for name, value in values.items()}


def _labelled(line: Column, heading: str, kind: str, labels: dict[str, str]) -> dict[str, Column]:
    """Numbers of a line by the label after each; the line counts only if it has its heading and all labels."""
    rest = F.when(F.startswith(line, F.lit(heading)), F.substring_index(line, ":", -1))
    padded = F.regexp_replace(F.concat(F.lit(" "), rest, F.lit(" ")), "[,.] ", " ")
    values = {}
    for label, metric in labels.items():
        before = F.when(F.contains(padded, F.lit(f" {label} ")), F.trim(F.substring_index(padded, f" {label} ", 1)))
        values[metric] = F.substring_index(before, " ", -1).try_cast(kind)
    return _all_or_none(values)


def _first_line(line: Column) -> dict[str, Column]:
    """Days, hours and minutes after ``up``, and the three averages at the end."""
    since = F.split(F.trim(F.substring_index(line, " up ", -1)), ", *")
    days = F.when(F.contains(since[0], F.lit(" day")), F.substring_index(since[0], " ", 1))
    clock = F.split(F.get(since, F.lit(1)), ":")
    times = (days, F.get(clock, F.lit(0)), F.get(clock, F.lit(1)))
    loads = F.split(F.when(F.contains(line, F.lit("load average:")), F.substring_index(line, "load average:", -1)), ",")
    return _all_or_none({n: F.trim(v).try_cast("bigint") for n, v in zip(UPTIME, times)}) | _all_or_none(
        {n: F.trim(F.get(loads, F.lit(i))).try_cast("double") for i, n in enumerate(LOADS)}
    )


def process_summary(df: DataFrame, text: Column, keys: Sequence[str]) -> DataFrame:
    """Metrics of the five header lines of a process summary; shorter texts give no row."""
    split = df.select(*keys, F.split(_stripped(text), "\n").alias("_lines")).filter(F.size("_lines") >= 5)
    values = _first_line(F.col("_lines")[0])
    for number, heading, kind, labels in PROCESS_LABELS:
        values |= _labelled(F.col("_lines")[number], heading, kind, labels)
    parsed = split.select(*keys, *[v.alias(n) for n, v in values.items()])
    memory = F.when(
        F.col("memory_total_mib") > 0, F.col("memory_used_mib") / F.col("memory_total_mib") * 100
    )
    swap = F.when(F.col("swap_total_mib") > 0, F.col("swap_used_mib") / F.col("swap_total_mib") * 100).when(
        F.col("swap_total_mib").isNotNull(), F.lit(0.0)
    )
    return parsed.withColumns({"memory_usage_percent": memory, "swap_usage_percent": swap})


def disk_table(df: DataFrame, text: Column, keys: Sequence[str]) -> DataFrame:
    """Rows of a disk table after its header; of equal mount points the last one counts."""
    words = lines(df, text, keys).filter(F.col("line_no") > 0).withColumn("w", F.split("line", r"\s+"))
    rows = words.filter(F.size("w") >= 6).select(
        *keys,
        "line_no",
        F.col("w")[5].alias("mount_point"),
        F.col("w")[0].alias("device"),
        F.col("w")[1].alias("size"),
        F.col("w")[2].alias("used"),
        F.col("w")[3].alias("available"),
        F.regexp_replace(F.col("w")[4], "%+$", "").alias("use_percent"),
    )
    columns = ("device", "size", "used", "available", "use_percent")
    return rows.groupBy(*keys, "mount_point").agg(
        F.max_by(F.struct(*columns), "line_no").alias("_r")
    ).select(*keys, "mount_point", "_r.*")


def disk_entries(entries: DataFrame, entry: str, keys: Sequence[str], position: str = "pos") -> DataFrame:
    """Structured disk entries with ``N/A`` for what is missing; of equal mounts the last one counts."""
    names = (("device", "device"), ("size", "size"), ("used", "used"), ("available", "available"), ("use_percent", "use-percent"))
    rows = entries.select(
        *keys,
        position,
        F.expr(f"coalesce({casts.leaf_text(entry, 'mount-point')}, 'unknown')").alias("mount_point"),
        *[F.expr(f"coalesce({casts.leaf_text(entry, source)}, 'N/A')").alias(name) for name, source in names],
    )
    return rows.groupBy(*keys, "mount_point").agg(
        F.max_by(F.struct(*[n for n, _ in names]), position).alias("_r")
    ).select(*keys, "mount_point", "_r.*")


def uptime_seconds(text: Column) -> Column:
    """Seconds of days and a clock (``3 days, 04:05:06``) or of a clock alone; anything else is 0."""
    parts = F.split(text, ", ")
    words = F.split(parts[0], r"\s+")
    dated = (F.size(parts) == 2) & (F.size(words) == 2) & words[1].isin("day", "days")
    days = F.when(dated, words[0].try_cast("bigint")).when(F.size(parts) == 1, F.lit(0))
    clock = F.split(parts[F.size(parts) - 1], ":")
    time = [F.regexp_extract(F.get(clock, F.lit(i)), "^[0-9]+", 0).try_cast("bigint") for i in range(3)]
    return F.coalesce(days * 86400 + time[0] * 3600 + time[1] * 60 + time[2], F.lit(0))


def named_numbers(df: DataFrame, text: Column, keys: Sequence[str]) -> DataFrame:
    """``name : number`` lines; other lines are ignored, of equal names the last one counts."""
    rows = lines(df, text, keys).filter(F.col("line").rlike(NAMED_NUMBER))
    named = rows.select(
        *keys,
        "line_no",
        F.regexp_extract("line", NAMED_NUMBER, 1).alias("counter"),
        F.regexp_extract("line", NAMED_NUMBER, 2).try_cast("bigint").alias("value"),
    )
    return named.groupBy(*keys, "counter").agg(F.max_by("value", "line_no").alias("value"))


def _name_and_value(rows: DataFrame) -> DataFrame:
    at = F.locate(":", F.col("line"))
    return rows.filter(at > 0).withColumns(
        {
            "name": _stripped(F.substr("line", F.lit(1), at - 1)),
            "text": _stripped(F.substr("line", at + 1)),
        }
    )


def portal_messages(df: DataFrame, text: Column, keys: Sequence[str]) -> DataFrame:
    """Three named totals, 0 when absent; the last line of a name counts."""
    rows = _name_and_value(lines(df, text, keys))
    return rows.groupBy(*keys).agg(
        *[
            F.coalesce(
                F.max_by(
                    F.expr(casts.int_of_text("text")), F.when(F.contains(F.col("name"), F.lit(title)), F.col("line_no"))
                ),
                F.lit(0),
            ).alias(name)
            for name, title in PORTAL_MESSAGES.items()
        ]
    )


def portal_summary(df: DataFrame, text: Column, keys: Sequence[str]) -> DataFrame:
    """``name : value`` rows after the header line, values converted where they are numbers."""
    rows = _name_and_value(lines(df, text, keys).filter(F.col("line_no") > 0))
    return rows.select(*keys, "line_no", "name", F.expr(casts.converted_text("text")).alias("value"))


def _statistics(section: Column) -> dict[str, Column]:
    """Statistics of one text section, matched by exact name."""
    pairs = F.filter(
        F.transform(F.split(section, "\n"), lambda line: F.split(_stripped(line), r"\s*:\s*", 2)),
        lambda pair: F.size(pair) == 2,
    )

    def last_value(title: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda pair: _stripped(pair[0]) == title), F.lit(-1))[1]

    return {name: last_value(title) for name, title in GATEWAY_STATISTICS.items()}


def _between(text: Column, tag: str, missing: str) -> Column:
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(missing)


def gateway_summary_text(df: DataFrame, text: Column, keys: Sequence[str]) -> DataFrame:
    """Gateways of a summary text: a tagged block followed by its statistics lines."""
    sections = df.select(
        *keys, F.posexplode(F.split(text, "<Gateway>")).alias("gateway_no", "_section")
    ).filter(F.col("gateway_no") > 0)
    halves = F.split("_section", "</Gateway>")
    usable = sections.filter(F.size(halves) == 2).withColumns({"_block": halves[0], "_text": halves[1]})
    return usable.select(
        *keys,
        "gateway_no",
        _between(F.col("_block"), "name", "").alias("name"),
        _between(F.col("_block"), "CurrentUsers", "0").alias("current_users"),
        _between(F.col("_block"), "PreviousUsers", "0").alias("previous_users"),
        *[v.alias(n) for n, v in _statistics(F.col("_text")).items()],
    )


def gateway_sections(text: Column) -> Column:
    """Blocks of statistics lines, separated by blank lines."""
    return F.filter(F.split(_stripped(text), r"\n[ \t]*(?:\n[ \t]*)+"), lambda block: _stripped(block) != "")


def gateway_summary_entries(df: DataFrame, gateways: Column, text: Column, keys: Sequence[str]) -> DataFrame:
    """Structured gateways (VARIANT objects) paired by position with the text sections."""
    from fleetlens.operators.joins import zip_by_position

    pairs = df.select(*keys, F.explode(zip_by_position(gateways, gateway_sections(text))).alias("_pair"))
    return pairs.select(
        *keys,
        F.col("_pair.pos").alias("gateway_no"),
        F.expr(f"coalesce({casts.leaf_text('_pair.entry', 'name')}, '')").alias("name"),
        F.expr(f"coalesce({casts.leaf_text('_pair.entry', 'CurrentUsers')}, '0')").alias("current_users"),
        F.expr(f"coalesce({casts.leaf_text('_pair.entry', 'PreviousUsers')}, '0')").alias("previous_users"),
        *[v.alias(n) for n, v in _statistics(F.col("_pair.section")).items()],
    )
