"""Names: natural order, safe keys, sensitive text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Assignments that make a message sensitive, and the masks for three of them.
SENSITIVE = r"(?i)(password|api[_-]?key|token|secret|auth)\s*[:=]\s*\S+"
MASKS = (
    (r"(?i)(api[_-]?key\s*[:=]\s*)(\S{4})(\S+)(\S{4})", "$1$2***$4"),
    (r"(?i)(password\s*[:=]\s*)(\S+)", "$1***"),
    (r"(?i)(token\s*[:=]\s*)(\S{4})(\S+)", "$1$2***"),
)


def natural_key(name: Column) -> Column:
    """Sort key in which digit runs of any length compare as numbers: how many digits come first, leading zeros do not
    count."""
    runs = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def comparable(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.format_string("%010d", F.length(digits)), digits)).otherwise(run)

    return F.array_join(F.transform(runs, comparable), "")


def safe_key(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_\-]", "_")


def is_sensitive(text: Column) -> Column:
    return F.coalesce(text.rlike(SENSITIVE), F.lit(False))


def masked(text: Column) -> Column:
    for pattern, replacement in MASKS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def protocol_of_flags(flags: Column) -> Column:
    """Route protocol from flag letters, first match of B, S, C, O, R."""
    out = F.lit("other")
    for letter, protocol in reversed(
        (("B", "bgp"), ("S", "static"), ("C", "connected"), ("O", "ospf"), ("R", "rip"))
    ):
        out = F.when(F.contains(flags, F.lit(letter)), protocol).otherwise(out)
    return out


def protocol_name(protocol: Column) -> Column:
    return F.replace(F.trim(F.lower(protocol)), F.lit(" "), F.lit("_"))
