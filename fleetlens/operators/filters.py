"""Collection rules, device subsets and data-quality expectations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.casts import double_of_text, int_of_text, loose_boolean
from fleetlens.functions.netaddr import IPV4

# Host label, IPv6, interface name and timestamp shapes; port and timeout ranges.
HOST_LABEL = r"^[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?$"
IPV6 = (
    r"(?i)^(([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|([0-9a-f]{1,4}:){1,7}:|([0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}"
    r"|([0-9a-f]{1,4}:){1,5}(:[0-9a-f]{1,4}){1,2}|([0-9a-f]{1,4}:){1,4}(:[0-9a-f]{1,4}){1,3}"
    r"|([0-9a-f]{1,4}:){1,3}(:[0-9a-f]{1,4}){1,4}|([0-9a-f]{1,4}:){1,2}(:[0-9a-f]{1,4}){1,5}"
    r"|[0-9a-f]{1,4}:(:[0-9a-f]{1,4}){1,6}|:((:[0-9a-f]{1,4}){1,7}|:))$"
)
INTERFACE_NAMES = (
    r"^ethernet\d+/\d+$", r"^ae\d+$", r"^tunnel\.\d+$", r"^loopback\.\d+$", r"^vlan\.\d+$", r"^all$",
)
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{3}(\d{3})?)?)?)?(Z|[+-]\d{2}:\d{2})?)?$"
PORTS = (1, 65535)
TIMEOUTS = (1, 300)


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_ip(value: Column) -> Column:
    return _known(value.rlike(IPV4) | value.rlike(IPV6))


def is_hostname(value: Column) -> Column:
    labels = F.split(F.regexp_replace(value, r"\.$", ""), r"\.")
    return _known(
        (value != "")
        & (F.length(value) <= 253)
        & F.forall(labels, lambda label: (F.length(label) <= 63) & label.rlike(HOST_LABEL))
    )


def is_whole_between(value: str, low: int, high: int) -> Column:
    return _known(F.expr(int_of_text(f"cast({value} as string)")).between(low, high))


def is_port(value: str) -> Column:
    return is_whole_between(value, *PORTS)


def is_timeout(value: str) -> Column:
    return is_whole_between(value, *TIMEOUTS)


def is_interface(value: Column) -> Column:
    return _known(value.rlike("(?i)" + "|".join(INTERFACE_NAMES)))


def is_timestamp(value: Column) -> Column:
    return _known(value.rlike(ISO_TIME) & F.try_to_timestamp(value).isNotNull())


def is_between(value: str, low: float | None = None, high: float | None = None) -> Column:
    number = F.expr(double_of_text(f"cast({value} as string)"))
    ok = number.isNotNull()
    if low is not None:
        ok = ok & (number >= low)
    if high is not None:
        ok = ok & (number <= high)
    return _known(ok)


def envelope_rules(envelope: Column) -> dict[str, Column]:
    """Expectations on a response held as VARIANT."""
    success = F.try_variant_get(envelope, "$.success", "variant")
    stamp = F.try_variant_get(envelope, "$.timestamp", "string")
    return {
        "success_present": success.isNotNull(),
        "success_boolean": success.isNull() | (F.schema_of_variant(success) == "BOOLEAN"),
        "timestamp_valid": stamp.isNull() | is_timestamp(stamp),
    }


def expectations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per row and rule: is the rule violated? One pass for all rules."""
    checked = F.array(
        *[F.struct(F.lit(n).alias("rule"), (~_known(ok)).alias("violated")) for n, ok in rules.items()]
    )
    return df.select(*keys, F.explode(checked).alias("_c")).select(*keys, "_c.*")


def pass_ratio(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return checks.groupBy(*keys, "rule").agg(
        F.count("*").alias("checked"),
        F.count_if("violated").alias("violations"),
        (F.count_if(~F.col("violated")).cast("double") / F.count("*")).alias("passed_share"),
    )


def collectable(df: DataFrame, rules: DataFrame, module: str, collection: str, device: str) -> DataFrame:
    """Rows whose collection is switched on.

    ``rules`` holds (module, collection, device, enabled); null collection means the whole module,
    null device all devices. A device may switch a module off but not back on; for collections the
    device's rule comes before the general one; without a rule a collection is on.
    """
    on = rules.withColumn("enabled", F.col("enabled").cast("boolean"))
    whole = F.col("collection").isNull()
    everywhere = F.col("device").isNull()

    def pick(condition: Column, name: str, *keys: tuple[str, str]) -> tuple[DataFrame, list[str], str]:
        return (
            on.filter(condition)
            .groupBy(*[k for k, _ in keys])
            .agg(F.min("enabled").alias(name))
            .withColumnsRenamed({k: c for k, c in keys}),
            [c for _, c in keys],
            name,
        )

    mod, col, dev = ("module", module), ("collection", collection), ("device", device)
    for table, by, _ in (
        pick(whole & ~everywhere, "_device_module", mod, dev),
        pick(whole & everywhere, "_module", mod),
        pick(~whole & ~everywhere, "_device_collection", mod, col, dev),
        pick(~whole & everywhere, "_collection", mod, col),
    ):
        df = df.join(table, by, "left")
    enabled = (
        F.coalesce("_device_module", F.lit(True))
        & F.coalesce("_module", F.lit(True))
        & F.coalesce("_device_collection", "_collection", F.lit(True))
    )
    return df.filter(enabled).drop("_device_module", "_module", "_device_collection", "_collection")


def enabled_devices(devices: DataFrame, flag: str) -> DataFrame:
    """Devices whose flag (SQL text) reads as true; a missing flag counts as enabled."""
    return devices.filter(F.coalesce(F.expr(loose_boolean(flag)), F.lit(True)))


def only_devices(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(*names))


def is_up(status: Column) -> Column:
    return F.coalesce(F.contains(F.lower(status), F.lit("up")), F.lit(False))
