"""IPv4 text: validity, class, documentation surrogates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address shapes, private ranges, ranges left alone, documentation ranges.
OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
IPV4_ANYWHERE = r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"
PRIVATE = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|169\.254\.)"
UNTOUCHED = r"^(127\.|0\.|255\.)"
MAC = r"^([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}$"
DOCUMENTATION = ("192.0.2.", "198.51.100.", "203.0.113.")
HOSTS_PER_RANGE = 254


def ip_class(ip: Column) -> Column:
    """``private``, ``public`` or ``untouched`` (loopback, 0.x, 255.x, IPv6, not an address)."""
    return (
        F.when(~F.coalesce(ip.rlike(IPV4), F.lit(False)) | ip.rlike(UNTOUCHED), "untouched")
        .when(ip.rlike(PRIVATE), "private")
        .otherwise("public")
    )


def _octet(number: Column, place: int) -> Column:
    return F.pmod(F.floor(number / 256**place), F.lit(256)).cast("string")


def documentation_ip(number: Column) -> Column:
    """n-th public surrogate: three documentation ranges of 254 hosts, then 198.18.x.y, then 240.0.0.0/4."""
    block = F.floor((number - 1) / HOSTS_PER_RANGE)
    host = (F.pmod(number - 1, F.lit(HOSTS_PER_RANGE)) + 1).cast("string")
    reserved = F.lit(240 * 2**24).cast("bigint") + number
    out = F.when(
        number < 65536,
        F.concat(F.lit("198.18."), _octet(number, 1), F.lit("."), _octet(number, 0)),
    ).otherwise(F.concat_ws(".", *[_octet(reserved, place) for place in (3, 2, 1, 0)]))
    for index in range(len(DOCUMENTATION) - 1, -1, -1):
        out = F.when(block == index, F.concat(F.lit(DOCUMENTATION[index]), host)).otherwise(out)
    return out


def ipv4_number(ip: Column) -> Column:
    """Address as a BIGINT, null when it is not IPv4."""
    parts = F.split(ip, r"\.")
    number = F.lit(0).cast("bigint")
    for index in range(4):
        number = number * 256 + parts[index].try_cast("bigint")
    return F.when(ip.rlike(IPV4), number)


def identity_ip(identity: str) -> str:
    """SQL text for the address inside ``name(ipaddr:1.2.3.4)``; text without the marker is kept."""
    return (
        f"CASE WHEN contains({identity}, 'ipaddr:') THEN trim(TRAILING ')' FROM substring_index({identity}, 'ipaddr:', -1)) "
        f"ELSE {identity} END"
    )
