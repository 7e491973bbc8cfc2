"""Health classes and rule-driven alerts over long metrics.

Rules are data. They are fixed lists of this library or a table of the user; the metric table is
scanned once, and only rows of measurements and fields that have rules meet the rule join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import series
from fleetlens.operators.rollup import core_balance
from fleetlens.plans.slicing import slice_hot, sliced, with_halo, without_halo

# Two cut-points per field (below the first ok, below the second warn).
CLASSES = (
    ("cpu_usage", "cpu_total_used", 70.0, 90.0, True),
    ("memory_usage", "memory_usage_percent", 70.0, 90.0, True),
    ("swap_usage", "swap_usage_percent", 30.0, 70.0, True),
    ("interface_counters_hw", "errors_total", 1.0, 100.0, True),
    ("ipsec_sa", "remaining_seconds", 900.0, 300.0, False),
)
TRANSITIONAL_STATES = ("Connect", "Active", "OpenSent", "OpenConfirm")
LEVELS = ("ok", "warn", "critical")

# Measurement, field (a pattern when it ends in *), operator, threshold, severity.
ALERTS = (
    ("cpu_usage", "cpu_total_used", ">", "80", "warn"),
    ("memory_usage", "memory_usage_percent", ">", "85", "warn"),
    ("swap_usage", "swap_usage_percent", ">", "25", "warn"),
    ("disk_usage", "use_percent", ">", "85", "warn"),
    ("task_stats", "tasks_zombie", ">", "0", "warn"),
    ("ha_status", "peer_conn_status", "!=", "up", "critical"),
    ("ha_status", "peer_conn_ha1_status", "!=", "up", "critical"),
    ("ha_status", "peer_conn_ha2_status", "!=", "up", "critical"),
    ("ha_status", "state_sync", "!=", "Complete", "critical"),
    ("ha_status", "running_sync", "!=", "synchronized", "critical"),
    ("ha_status", "*_compat", "=", "Mismatch", "critical"),
    ("cpu_dataplane_tasks", "task_*", ">", "80", "warn"),
    ("cpu_dataplane_tasks", "resource_*", ">", "85", "warn"),
    ("cpu_dataplane_cores", "cpu_utilization_avg", ">", "90", "critical"),
    ("env_thermal", "alarm", "=", "1", "critical"),
    ("env_fan", "alarm", "=", "1", "critical"),
    ("env_power", "alarm", "=", "1", "critical"),
    ("env_power_supply", "alarm", "=", "1", "critical"),
    ("env_power_supply", "inserted", "=", "0", "critical"),
    ("bgp_summary", "peers_down", ">", "0", "critical"),
    ("bgp_peer", "state_up", "=", "0", "critical"),
    ("bgp_path_monitor", "path_up", "=", "0", "critical"),
    ("ipsec_flow", "state_up", "=", "0", "critical"),
    ("ipsec_sa", "remaining_seconds", "<", "300", "warn"),
)
# Measurement, field, operator, the field it is held against and how much of it, severity.
PAIRS = (
    ("env_thermal", "temperature_c", ">", "max_temp_c", 0.9, "warn"),
    ("env_fan", "rpm", "<", "min_rpm", 1.0, "critical"),
    ("env_power", "volts", "<", "min_volts", 1.0, "critical"),
    ("env_power", "volts", ">", "max_volts", 1.0, "critical"),
)
# Measurement, field, threshold and samples in a row; fields whose change, or whose fall, is an alert.
SUSTAINED = (("cpu_usage", "cpu_total_used", 80.0, 3, "critical"),)
CHANGES = (("ha_status", "local_state", "critical"),)
FALLS = (("system_uptime", "uptime_seconds", "warn"),)
CORE_IMBALANCE = 50.0
HOT_SHARE = 0.9
CONTENT_DAYS = 7



def _asked(*rows: tuple[str, str]) -> dict[str, set[str]]:
    return {measurement: {name for m, name in rows if m == measurement} for measurement, _ in rows}


#: Measurements and their fields (or patterns of names) that the classes, and all alerts of the catalog, look at.
CLASSED = _asked(*[row[:2] for row in CLASSES], ("interface_counters_hw", "rx_error"), ("interface_counters_hw", "tx_error"))
WATCHED = _asked(
    *[row[:2] for row in (*ALERTS, *PAIRS, *SUSTAINED, *CHANGES, *FALLS)], *[(row[0], row[3]) for row in PAIRS],
    ("load_average", "load_15min"),
)

RULE_COLUMNS = "measurement string, field string, op string, threshold string, severity string"


def band(value: Column, low: float, high: float, rising: bool = True) -> Column:
    """ok / warn / critical by two cut-points; falling when small values are the bad ones."""
    if rising:
        return F.when(value < low, "ok").when(value < high, "warn").when(value.isNotNull(), "critical")
    return F.when(value < high, "critical").when(value < low, "warn").when(value.isNotNull(), "ok")


def cut_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "measurement string, field string, low double, high double, rising boolean")


def alert_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALERTS, RULE_COLUMNS)


def classified(metrics: DataFrame, cuts: DataFrame, value: Column) -> DataFrame:
    """Metrics that have cut-points, with their class."""
    joined = metrics.withColumn("_v", value).join(cuts, ["measurement", "field"])
    rising = F.when(F.col("_v") < F.col("low"), "ok").when(F.col("_v") < F.col("high"), "warn").otherwise("critical")
    falling = F.when(F.col("_v") < F.col("high"), "critical").when(F.col("_v") < F.col("low"), "warn").otherwise("ok")
    return (
        joined.filter(F.col("_v").isNotNull())
        .withColumn("level", F.when(F.col("rising"), rising).otherwise(falling))
        .drop("_v", "low", "high", "rising")
    )


def counter_level(severity: Column, value: Column) -> Column:
    calm = (value == 0) | (F.coalesce(severity, F.lit("info")) == "info")
    return F.when(calm, "ok").when(value < 1000, "warn").otherwise("critical")


def peer_level(state: Column) -> Column:
    return (
        F.when(state == "Established", "up").when(state.isin(*TRANSITIONAL_STATES), "transitional").otherwise("down")
    )


def _compare(op: Column, left: Column, right: Column) -> Column:
    return (
        F.when(op == ">", left > right)
        .when(op == ">=", left >= right)
        .when(op == "<", left < right)
        .when(op == "<=", left <= right)
        .when(op == "=", left == right)
        .when(op == "!=", left != right)
    )


def breached(number: Column, text: Column) -> Column:
    """Does the metric break the rule joined to it? Numbers compare as numbers, text as text."""
    limit = F.col("threshold").try_cast("double")
    numeric = number.isNotNull() & limit.isNotNull()
    verdict = F.when(numeric, _compare(F.col("op"), number, limit)).otherwise(
        _compare(F.col("op"), text, F.col("threshold"))
    )
    return F.coalesce(verdict, F.lit(False))


def alerts(metrics: DataFrame, rules: DataFrame, number: Column, text: Column) -> DataFrame:
    """Metric rows that break a rule.

    A rule's field may hold one ``*`` (``task_*``, ``*_compat``); it is split into the text before
    and after the star, so matching is two plain comparisons after the equi-join on the measurement.
    """
    starred = F.contains(F.col("field"), F.lit("*"))
    parts = rules.select(
        "measurement",
        F.when(starred, F.substring_index("field", "*", 1)).otherwise(F.col("field")).alias("_start"),
        F.when(starred, F.substring_index("field", "*", -1)).alias("_end"),
        "op",
        "threshold",
        "severity",
    )
    matches = F.when(F.col("_end").isNull(), F.col("field") == F.col("_start")).otherwise(
        F.col("field").startswith(F.col("_start"))
        & F.col("field").endswith(F.col("_end"))
        & (F.length("field") >= F.length("_start") + F.length("_end"))
    )
    joined = metrics.withColumns({"_number": number, "_text": text}).join(parts, "measurement")
    return (
        joined.filter(matches)
        .filter(breached(F.col("_number"), F.col("_text")))
        .drop("_number", "_text", "_start", "_end")
    )


ALERT_COLUMNS = ("collected_at", "device", "measurement", "field", "op", "threshold", "severity")


def _number(fields: str, name: Column | str) -> Column:
    value = F.try_element_at(F.col(fields), F.lit(name) if isinstance(name, str) else name)
    return F.coalesce(value["v_dbl"], value["v_int"].cast("double"))


def with_error_totals(points: DataFrame) -> DataFrame:
    """Points with ``errors_total``, the receive and send errors of an interface together."""
    total = _number("fields", "rx_error") + _number("fields", "tx_error")
    kind = points.schema["fields"].dataType
    added = F.create_map(
        F.lit("errors_total"),
        F.struct(*[(total if f.name == "v_dbl" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.valueType.fields]),
    )
    applies = (F.col("measurement") == "interface_counters_hw") & total.isNotNull()
    return points.withColumn("fields", F.when(applies, F.map_concat("fields", added)).otherwise(F.col("fields")))


def pair_alerts(points: DataFrame, pairs: Sequence[tuple] = PAIRS) -> DataFrame:
    """Points in which one field breaks a limit that another field of the same point gives."""
    rules = []
    for measurement, name, op, other, share, severity in pairs:
        limit = _number("fields", other) * share
        broken = _number("fields", name) > limit if op == ">" else _number("fields", name) < limit
        rules.append(
            F.when(
                (F.col("measurement") == measurement) & broken,
                F.struct(F.lit(name).alias("field"), F.lit(op).alias("op"), limit.cast("string").alias("threshold"), F.lit(severity).alias("severity")),
            )
        )
    found = points.filter(F.col("measurement").isin(*{p[0] for p in pairs})).select(
        "collected_at", "device", "measurement", F.explode(F.array_compact(F.array(*rules))).alias("_r")
    )
    return found.select("collected_at", "device", "measurement", "_r.*").select(*ALERT_COLUMNS)


def _rule_row(df: DataFrame, measurement: str, field: str, op: str, threshold: str, severity: str) -> DataFrame:
    return df.select(
        "collected_at", "device", F.lit(measurement).alias("measurement"), F.lit(field).alias("field"),
        F.lit(op).alias("op"), F.lit(threshold).alias("threshold"), F.lit(severity).alias("severity"),
    )


def core_alerts(points: DataFrame, imbalance: float = CORE_IMBALANCE) -> DataFrame:
    """Planes whose cores are unevenly loaded, and devices whose load average is above their number of cores."""
    cores = points.filter("measurement = 'cpu_dataplane_cores'").select(
        "collected_at", "device", F.col("tags")["dp_id"].alias("dp_id"), F.col("tags")["core_id"].cast("int").alias("core"),
        _number("fields", "cpu_utilization_avg").alias("load"),
    )
    uneven = core_balance(cores, ["collected_at", "device", "dp_id"], "core", "load").filter(F.col("imbalance") > imbalance)
    counted = cores.groupBy("collected_at", "device").agg(F.count("*").alias("n"))
    loads = points.filter("measurement = 'load_average'").select("collected_at", "device", _number("fields", "load_15min").alias("load"))
    above = loads.join(counted, ["collected_at", "device"]).filter("load > n")
    return _rule_row(uneven, "cpu_dataplane_cores", "imbalance", ">", str(imbalance), "warn").unionByName(
        _rule_row(above, "load_average", "load_15min", ">", "cores", "warn")
    )


def lookback_alerts(points: DataFrame, max_rows: int = series.MAX_ROWS) -> DataFrame:
    """Alerts that need earlier samples of the device: a limit broken for some samples in a row, a changed state, a
    fallen counter.

    Points are read once: each gives a row for every rule of its measurement, and one window for each device and rule
    answers all kinds. Of samples of one instant, tags and value decide the order, so the result does not vary.
    """
    nothing = F.lit(None)

    def rule(kind: str, measurement: str, name: str, op: str, threshold: str, severity: str, limit: float | None, run: int) -> Column:
        value = F.try_element_at("fields", F.lit(name))
        return F.when(F.col("measurement") == measurement, F.struct(
            F.lit(kind).alias("kind"), F.lit(name).alias("field"), F.lit(op).alias("op"), F.lit(threshold).alias("threshold"),
            F.lit(severity).alias("severity"), F.lit(run).alias("run"), _number("fields", name).alias("number"), value["v_str"].alias("text"),
            F.coalesce(_number("fields", name) > (nothing if limit is None else F.lit(limit)), F.lit(False)).cast("int").alias("hit"),
        ))

    rules = [rule("sustained", m, name, f"> for {run}", str(limit), severity, limit, run) for m, name, limit, run, severity in SUSTAINED]
    rules += [rule("changed", m, name, "changed", "", severity, None, 1) for m, name, severity in CHANGES]
    rules += [rule("fell", m, name, "fell", "", severity, None, 1) for m, name, severity in FALLS]
    looked = {r[0] for r in (*SUSTAINED, *CHANGES, *FALLS)}
    samples = points.filter(F.col("measurement").isin(*looked)).select(
        "collected_at", "device", "measurement", F.unix_micros("collected_at").alias("ts_us"),
        F.array_sort(F.map_entries("tags")).alias("tags"), F.inline(F.array_compact(F.array(*rules))),
    )
    samples = samples.withColumn("tie", F.xxhash64("tags", "number", "text")).drop("tags")
    keys, order, runs = ("device", "measurement", "field"), ("ts_us", "tie"), {r[3] for r in SUSTAINED}
    cut = slice_hot(samples, keys, order, max_rows)
    held = with_halo(cut, keys, order, max(1, *[n - 1 for n in runs]))
    frame = sliced(keys, order)
    seen = held.select(
        "*", F.lag("number").over(frame).alias("_number"), F.lag("text").over(frame).alias("_text"),
        *[F.sum("hit").over(frame.rowsBetween(1 - n, 0)).alias(f"_run_{n}") for n in runs],
    )
    broken = (F.col("kind") == "changed") & (F.col("_text") != F.col("text"))
    broken |= (F.col("kind") == "fell") & (F.col("_number") > F.col("number"))
    for n in runs:
        broken |= (F.col("kind") == "sustained") & (F.col("run") == n) & (F.col(f"_run_{n}") == n)
    return without_halo(seen).filter(broken).select(*ALERT_COLUMNS)


def catalog_alerts(points: DataFrame, metrics: DataFrame) -> DataFrame:
    """All alerts of the catalog over points and their long metrics: single values, pairs, cores, look-back."""
    number, text = metric_columns(metrics)
    single = alerts(metrics, alert_rules(points.sparkSession), number, text).select(*ALERT_COLUMNS)
    return single.unionByName(pair_alerts(points)).unionByName(core_alerts(points)).unionByName(lookback_alerts(points))


def sensor_alarm(value: Column, low: Column, high: Column) -> Column:
    """A sensor outside its own limits."""
    return F.coalesce((value < low) | (value > high), F.lit(False))


def near_limit(value: Column, limit: Column, share: float = HOT_SHARE) -> Column:
    return F.coalesce(value > limit * share, F.lit(False))


def outdated(release: Column, now: Column, days: int = CONTENT_DAYS) -> Column:
    return F.coalesce(F.datediff(now, release) > days, F.lit(False))


def equal_priority(local: Column, peer: Column) -> Column:
    return F.coalesce(local == peer, F.lit(False))


def report(levels: DataFrame, device: str = "device", metric: str = "metric", level: str = "level") -> DataFrame:
    """Worst class per device and the metrics that are not ok.

    Metrics are made distinct before they are gathered, so the list is bounded by the rule set
    however many samples a device has.
    """
    place = F.lit(0)
    for number, name in enumerate(LEVELS):
        place = F.when(F.col(level) == name, number).otherwise(place)
    worst_per_metric = levels.groupBy(device, metric).agg(F.max(place).alias("_place"))
    return worst_per_metric.groupBy(device).agg(
        F.element_at(F.array(*[F.lit(n) for n in LEVELS]), F.max("_place") + 1).alias("worst"),
        F.array_sort(F.collect_set(F.when(F.col("_place") > 0, F.col(metric)))).alias("breaching"),
    )


def metric_columns(metrics: DataFrame) -> tuple[Column, Column]:
    """Number and text of a long metric row."""
    number = F.coalesce(F.col("v_dbl"), F.col("v_int").cast("double"), F.col("v_bool").cast("int").cast("double"))
    return number, F.coalesce(F.col("v_str"), F.col("v_bool").cast("string"))
