"""Human-readable rates, volumes, durations and bands of the traffic report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.casts import exact_round

# Unit steps and the rate bands.
BIT_STEPS = ((1_000_000_000, "Gb/s"), (1_000_000, "Mb/s"), (1_000, "Kb/s"))
BYTE_STEPS = {
    1024: ((1024**3, "GB"), (1024**2, "MB"), (1024, "KB")),
    1000: ((10**12, "TB"), (10**9, "GB"), (10**6, "MB"), (10**3, "KB")),
}
PACKET_STEPS = ((1_000_000, "M"), (1_000, "k"))
RATE_BANDS = ((1_000_000_000, "1G"), (100_000_000, "100M"), (10_000_000, "10M"), (1_000_000, "1M"))


def _fixed(value: str, digits: int) -> str:
    """Text with a fixed number of decimals, rounded by the exact binary value."""
    return f"format_string('%.{digits}f', {exact_round(value, digits)})"


def _stepped(value: str, steps, gap: str, rest: str) -> Column:
    cases = " ".join(
        f"WHEN {value} >= {size} THEN concat({_fixed(f'{value} / {size}D', 2)}, '{gap}{unit}')" for size, unit in steps
    )
    return F.expr(f"CASE {cases} WHEN {value} IS NOT NULL THEN {rest} END")


def bit_rate(value: str) -> Column:
    """Rate text of a column or SQL expression in bits per second."""
    return _stepped(value, BIT_STEPS, " ", f"concat({_fixed(value, 0)}, ' b/s')")


def byte_volume(value: str, base: int = 1024) -> Column:
    return _stepped(value, BYTE_STEPS[base], " ", f"concat(cast({value} as string), ' B')")


def packet_rate(value: str) -> Column:
    return _stepped(value, PACKET_STEPS, "", _fixed(value, 1))


def duration(seconds: Column) -> Column:
    """Two largest units: ``3d 4h``, ``4h 5m``, ``5m 6s`` or ``6s``."""
    total = seconds.cast("bigint")

    def part(divisor: int, modulus: int | None = None) -> Column:
        rest = total if modulus is None else F.pmod(total, F.lit(modulus))
        return F.floor(rest / divisor).cast("string")

    return (
        F.when(total >= 86400, F.concat(part(86400), F.lit("d "), part(3600, 86400), F.lit("h")))
        .when(total >= 3600, F.concat(part(3600), F.lit("h "), part(60, 3600), F.lit("m")))
        .when(total >= 60, F.concat(part(60), F.lit("m "), part(1, 60), F.lit("s")))
        .when(total.isNotNull(), F.concat(total.cast("string"), F.lit("s")))
    )


def remaining(seconds: Column) -> Column:
    """Minutes and seconds left on an association; ``N/A`` for none."""
    total = F.coalesce(seconds, F.lit(0)).cast("bigint")
    return F.when(total == 0, "N/A").otherwise(
        F.concat(
            F.floor(total / 60).cast("string"), F.lit("m "), F.pmod(total, F.lit(60)).cast("string"), F.lit("s")
        )
    )


def rate_band(value: Column) -> Column:
    out = F.lit("low")
    for size, name in reversed(RATE_BANDS):
        out = F.when(value >= size, name).otherwise(out)
    return out
