"""Consistent pseudonyms for identifiers, built in two passes.

Pass one lists every identifier occurrence with its category and numbers the distinct ones in
first-seen order; pass two joins the surrogates back and rewrites the documents. Both passes are
distributed: a value that occurs in a third of all documents is one partially aggregated group in
the first and one skew-split join key in the second.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.netaddr import IPV4_ANYWHERE, MAC, documentation_ip, ip_class
from fleetlens.plans.numbering import number_within
from fleetlens.session import run_dir

# Placeholders that stay, section names, and the keys that mark each category.
PLACEHOLDERS = ("unknown", "n/a", "N/A", "null", "none", "None")
SECTIONS = ("system", "interfaces", "routing", "counters", "global_protect", "vpn")
HOSTNAME_KEYS = ("hostname", "devicename", "advHostName", "rcvHostName")
SERIAL_KEYS = ("serial", "serial-num")
MAC_KEYS = ("mac-address", "base_mac", "ha1-macaddr", "ha2-macaddr", "mac")
IP_KEYS = (
    "ip-address", "public-ip-address", "default-gateway", "mgmt-ip", "ha1-ipaddr", "peer-ip", "local-ip",
    "hostLocal", "hostForeign", "nexthop", "updateSource", "router-id", "remoteRouterId", "localRouterId",
    "ip", "addr", "peer-id", "local-id", "destination", "monitordst-0",
)
PEER_GROUP_KEYS = ("peer-group-name", "peerGroup", "peerGroupMember")
ROUTE_FILTER_KEYS = ("incomingUpdatePrefixFilterList", "outgoingUpdatePrefixFilterList")
BGP_PEER_KEYS = ("peer-name", "peerName")
IKE_KEYS = ("name", "gw", "gateway")
ASN_KEYS = ("local-as", "remote-as", "localAs", "remoteAs")
CONTEXTS = {
    "bgp_summary": "logical_router", "routing_table": "logical_router", "bgp_routes": "logical_router",
    "static_routes": "logical_router", "vpn_tunnels": "vpn_tunnel", "ipsec_sa": "vpn_tunnel",
    "active_tunnels": "vpn_tunnel", "IPSec": "vpn_tunnel", "ike_gateways": "ike_gateway",
    "vpn_gateways": "ike_gateway", "bgp_peer_status": "bgp_peer_status", "gateway_summary": "gp_gateway",
    "Gateway": "gp_gateway", "portal_summary": "gp_portal",
}
ROUTER_PARENTS = ("bgp_summary", "routing_table", "bgp_routes", "static_routes")
LEVELS = ("minimal", "standard", "paranoid")
# Surrogate text per category, number format included.
TEMPLATES = {
    "hostname": "firewall-%02d",
    "serial": "100000%05d",
    "vpn_tunnel": "vpn-tunnel-%02d",
    "ike_gateway": "ike-gateway-%02d",
    "bgp_peer": "bgp-peer-%02d",
    "peer_group": "peer-group-%02d",
    "route_filter": "route-filter-%02d",
    "vlan_name": "vlan-%02d",
    "logical_router": "vr-%02d",
    "gp_gateway": "gp-gateway-%02d",
    "gp_portal": "gp-portal-%02d",
    "generic_name": "name-%03d",
}
FIRST_ASN = 64512
MAC_BASE = 0x5E000100

OCCURRENCE = (
    "position bigint, place bigint, role string, key string, parent string, context string, depth int, value string"
)


def at_least(level: str, wanted: str) -> bool:
    return LEVELS.index(level) >= LEVELS.index(wanted)


# ---- categories -----------------------------------------------------------------------------


def category(level: str = "standard") -> Column:
    """Category of an occurrence row (role, key, parent, context, depth, value); null to keep it.

    The first rule that applies decides. A rule above the chosen level does not apply, so later
    rules still see the value. ``ip`` means: replace the addresses found inside the text.
    """
    key, value, context = F.col("key"), F.col("value"), F.col("context")
    text_rules = (
        ("hostname", "minimal", key.isin(*HOSTNAME_KEYS)),
        ("serial", "minimal", key.isin(*SERIAL_KEYS)),
        ("mac", "standard", key.isin(*MAC_KEYS) | value.rlike(MAC)),
        ("ip", "minimal", key.isin(*IP_KEYS)),
        ("peer_group", "minimal", key.isin(*PEER_GROUP_KEYS)),
        ("route_filter", "standard", key.isin(*ROUTE_FILTER_KEYS)),
        ("bgp_peer", "minimal", key.isin(*BGP_PEER_KEYS)),
        ("vpn_tunnel", "minimal", (key == "name") & (context == "vpn_tunnel")),
        ("ike_gateway", "minimal", key.isin(*IKE_KEYS) & context.isin("ike_gateway", "vpn_tunnel")),
        ("gp_gateway", "minimal", (key == "name") & (context == "gp_gateway")),
        ("gp_portal", "minimal", (key == "name") & (context == "gp_portal")),
        ("vlan_name", "standard", (key == "fwd") & value.startswith("vlan:")),
        ("ip", "minimal", value.rlike(IPV4_ANYWHERE)),
    )
    number_rules = (
        ("serial", "minimal", key.isin(*SERIAL_KEYS)),
        ("asn", "paranoid", key.isin(*ASN_KEYS)),
    )
    key_rules = (
        ("hostname", "minimal", (F.col("depth") == 1) & F.col("parent").isin(*SECTIONS)),
        ("bgp_peer", "minimal", F.col("parent") == "bgp_peer_status"),
        ("logical_router", "standard", F.col("parent").isin(*ROUTER_PARENTS)),
    )

    def first(rules) -> Column:
        out = F.lit(None).cast("string")
        for name, wanted, applies in reversed(rules):
            if at_least(level, wanted):
                out = F.when(F.coalesce(applies, F.lit(False)), name).otherwise(out)
        return out

    kept = (value == "") | value.isin(*PLACEHOLDERS)
    return (
        F.when(F.col("role") == "key", first(key_rules))
        .when(F.col("role") == "number", first(number_rules))
        .when(~kept, first(text_rules))
    )


def identifiers(occurrences: DataFrame, level: str = "standard") -> DataFrame:
    """Replaceable pieces of every occurrence: ``piece`` (its number in the text), the category,
    the original, and the unchanged text before it; a last piece without category ends the text."""
    named = occurrences.withColumn("_category", category(level)).filter(F.col("_category").isNotNull())
    is_ip = F.col("_category") == "ip"
    is_vlan = F.col("_category") == "vlan_name"
    whole = F.array(
        F.struct(
            F.when(is_vlan, "vlan:").otherwise("").alias("before"),
            F.when(is_vlan, F.substr("value", F.lit(6))).otherwise(F.col("value")).alias("original"),
        )
    )
    literals = F.split("value", IPV4_ANYWHERE, -1)
    found = F.regexp_extract_all("value", F.lit(IPV4_ANYWHERE), F.lit(1))
    parts = F.transform(
        literals,
        lambda text, i: F.struct(text.alias("before"), F.get(found, i).alias("original")),
    )
    pieces = named.select(
        "position", "place", "role", "_category", F.posexplode(F.when(is_ip, parts).otherwise(whole)).alias("piece", "_p")
    )
    address = ip_class(F.col("_p.original"))
    final = (
        F.when(F.col("_category") != "ip", F.col("_category"))
        .when(address == "public", "public_ip")
        .when((address == "private") & F.lit(at_least(level, "standard")), "private_ip")
    )
    return pieces.select(
        "position", "place", "role", "piece", F.col("_p.before").alias("before"), F.col("_p.original").alias("original"),
        F.when(F.col("_p.original").isNotNull(), final).alias("category"),
    )


# ---- dictionary -----------------------------------------------------------------------------


def _byte(number: Column, place: int) -> Column:
    return F.lower(F.lpad(F.hex(F.pmod(F.floor(number / 256**place), F.lit(256))), 2, "0"))


def _octet(number: Column, place: int, step: int = 1) -> Column:
    return F.pmod(F.floor(number / 256**place) * step, F.lit(256)).cast("string")


def surrogate(kind: Column, number: Column) -> Column:
    """Surrogate text of the n-th value of a category. Templates widen instead of wrapping, so two
    values never share a surrogate."""
    out = F.concat(F.lit("obfuscated-"), number.cast("string"))
    for name, template in TEMPLATES.items():
        out = F.when(kind == name, F.format_string(template, number)).otherwise(out)
    mac = F.concat(F.lit("00:00:"), F.concat_ws(":", *[_byte(F.lit(MAC_BASE) + number, p) for p in (3, 2, 1, 0)]))
    last = F.pmod(number * 7 + F.floor(number / 65536), F.lit(256)).cast("string")
    private = F.concat_ws(".", F.lit("10"), _octet(number, 1), _octet(number, 0), last)
    turn = F.floor(number / 2**24)  # from here on the addresses begin again
    private = F.when(turn > 0, F.concat(private, F.lit("-"), turn.cast("string"))).otherwise(private)
    return (
        F.when(kind == "public_ip", documentation_ip(number))
        .when(kind == "private_ip", private)
        .when(kind == "mac", mac)
        .when(kind == "asn", (number + FIRST_ASN).cast("string"))
        .otherwise(out)
    )


def dictionary(found: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(category, original, number, surrogate) of all distinct identifiers in first-seen order.

    ``found`` holds (category, original, position, place). With a ``previous`` dictionary known
    values keep their surrogates and new ones are numbered after the highest of their category.
    """
    first_seen = (
        found.filter(F.col("category").isNotNull())
        .groupBy("category", "original")
        .agg(F.min(F.struct("position", "place")).alias("_seen"))
        .select("category", "original", F.col("_seen.position").alias("position"), F.col("_seen.place").alias("place"))
    )
    if previous is not None:
        first_seen = first_seen.join(previous, ["category", "original"], "left_anti")
    numbered = number_within(first_seen, ["category"], ["position", "place", "original"]).drop("position", "place")
    if previous is not None:
        top = previous.groupBy("category").agg(F.max("number").alias("_top"))
        numbered = (
            numbered.join(top, "category", "left")
            .withColumn("number", F.col("number") + F.coalesce("_top", F.lit(0)))
            .drop("_top")
        )
    named = numbered.withColumn("surrogate", surrogate(F.col("category"), F.col("number")))
    columns = ["category", "original", "number", "surrogate"]
    return named.select(*columns) if previous is None else previous.select(*columns).unionByName(named.select(*columns))


def mapping_export(mapping: DataFrame, path: str) -> None:
    """The dictionary by category; empty categories have no folder."""
    mapping.select("category", "original", "surrogate").write.mode("overwrite").partitionBy("category").json(path)


def mapping_counts(mapping: DataFrame) -> DataFrame:
    """Surrogates per category and in total."""
    return mapping.rollup("category").agg(F.count("*").alias("values")).withColumn(
        "category", F.coalesce("category", F.lit("total"))
    )


def replaced_texts(pieces: DataFrame, mapping: DataFrame) -> DataFrame:
    """New text of every occurrence that has a replaced piece: (position, place, role, text, is_number)."""
    # pieces without a category have no surrogate and would all meet under one null key
    known = mapping.select("category", "original", "surrogate")
    joined = pieces.filter("category is not null").join(known, ["category", "original"], "left").unionByName(
        pieces.filter("category is null").withColumn("surrogate", F.lit(None).cast("string")), allowMissingColumns=True
    )
    changed = F.concat(F.col("before"), F.coalesce("surrogate", "original", F.lit("")))
    return (
        joined.groupBy("position", "place", "role")
        .agg(
            F.array_sort(F.collect_list(F.struct("piece", changed.alias("text")))).alias("_parts"),
            F.max(F.col("surrogate").isNotNull()).alias("_changed"),
            F.max(F.col("category") == "asn").alias("is_number"),
        )
        .filter("_changed")
        .select(
            "position",
            "place",
            "role",
            F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"),
            F.coalesce("is_number", F.lit(False)).alias("is_number"),
        )
    )


# ---- documents ------------------------------------------------------------------------------

#: Rows of a frame of occurrences, and documents rewritten at a time.
FRAME, DOCUMENTS = 20_000, 500


def _children(value) -> Iterator[tuple] | None:
    """Named values of an object, values of a list without names, None for a leaf."""
    if isinstance(value, dict):
        return iter(value.items())
    return iter([(None, inner) for inner in value]) if isinstance(value, list) else None


def _numbered(value) -> bool:
    return isinstance(value, str) or (isinstance(value, (int, float)) and not isinstance(value, bool))


def _visit(document) -> Iterator[tuple]:
    """Keys and leaves in document order, numbered from 0; walked with a stack of its own, to any depth."""
    place, stack = 0, [(iter([(None, document)]), None, 0, "", None)]
    while stack:
        values, parent, depth, context, key = stack[-1]
        for name, value in values:
            below = (parent, depth, context, key)
            if name is not None:
                yield place, "key", None, parent, context, depth, name
                place += 1
                below = (name, depth + 1, CONTEXTS.get(name, context), name)
            if (children := _children(value)) is not None:
                stack.append((children, *below))
                break
            if _numbered(value):
                role = "text" if isinstance(value, str) else "number"
                yield place, role, below[3], below[0], below[2], below[1], str(value)
                place += 1
        else:
            stack.pop()


def _rebuild(document, changes: dict[int, dict]):
    """The document with the numbered keys and leaves replaced, in the order of ``_visit``."""
    place, whole = 0, []
    stack = [(iter([(None, document)]), whole)]
    while stack:
        values, out = stack[-1]
        for name, value in values:
            if name is not None:
                name = changes[place]["text"] if place in changes else name
                place += 1
            children = _children(value)
            new = value if children is None else type(value)()
            if children is None and _numbered(value):
                if place in changes:
                    new = int(changes[place]["text"]) if changes[place]["is_number"] else changes[place]["text"]
                place += 1
            if isinstance(out, dict):
                out[name] = new
            else:
                out.append(new)
            if children is not None:
                stack.append((children, new))
                break
        else:
            stack.pop()
    return whole[0]


def _loaded(document) -> tuple[object, bool]:
    try:
        return json.loads(document), True
    except (TypeError, ValueError, RecursionError):
        return None, False


def occurrences(documents: DataFrame, text: str, position: str = "position") -> DataFrame:
    """Keys and leaves of JSON documents, in frames of about ``FRAME`` rows; a document that is no JSON, or deeper than the
    parser goes (some thousands of levels), has none."""

    def walk(batches):
        import pandas as pd

        names = ["position", "place", "role", "key", "parent", "context", "depth", "value"]
        for batch in batches:
            rows = []
            for number, document in zip(batch["position"], batch["text"]):
                parsed, good = _loaded(document)
                rows.extend((number, *found) for found in (_visit(parsed) if good else ()))
                if len(rows) >= FRAME:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return documents.select(F.col(position).alias("position"), F.col(text).alias("text")).mapInPandas(walk, OCCURRENCE)


def rewritten(documents: DataFrame, text: str, replacements: DataFrame, position: str = "position") -> DataFrame:
    """Documents with their replacements applied. The replacements of one document are gathered
    (bounded by the document itself) and joined to it. A document that is no JSON, or too deep to be read or
    written, is held back: its text is null."""

    def one(document, changes):
        parsed, good = _loaded(document)
        try:
            return json.dumps(_rebuild(parsed, dict(changes) if changes is not None else {}), ensure_ascii=False) if good else None
        except RecursionError:
            return None

    def apply(batches):
        for batch in batches:
            for at in range(0, len(batch), DOCUMENTS):
                part = batch.iloc[at : at + DOCUMENTS][["position", "text", "changes"]].copy()
                part["text"] = [one(d, c) for d, c in zip(part["text"], part["changes"])]
                yield part[["position", "text"]]

    gathered = replacements.groupBy("position").agg(
        F.map_from_entries(F.collect_list(F.struct("place", F.struct("text", "is_number")))).alias("changes")
    )
    both = documents.select(F.col(position).alias("position"), F.col(text).alias("text")).join(gathered, "position", "left")
    return both.mapInPandas(apply, "position bigint, text string")


def _landed(df: DataFrame, label: str) -> DataFrame:
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pseudonymised(
    documents: DataFrame, text: str, level: str = "standard", position: str = "position", previous: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rewritten documents and the dictionary used. The pieces are landed in the shared folder, as both are made of them."""
    pieces = _landed(identifiers(occurrences(documents, text, position), level), "pieces")
    mapping = dictionary(pieces, previous)
    return rewritten(documents, text, replaced_texts(pieces, mapping), position), mapping
