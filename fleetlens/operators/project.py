"""Measurement definitions applied to collections: wide tables, points, long metrics."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping
from fnmatch import fnmatchcase
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import casts
from fleetlens.functions.lineproto import live_tags
from fleetlens.operators import nested, rollup
from fleetlens.operators.joins import resolve_hosts
from fleetlens.operators.specs import FALLBACKS, MEASUREMENTS, Measurement

CONTEXT = ("collected_at", "device", "hostname", "data_hostname")
VALUE_TYPES = {"bigint": "v_int", "double": "v_dbl", "string": "v_str", "boolean": "v_bool"}
FIELD_MAP = "map<string,struct<v_int:bigint,v_dbl:double,v_str:string,v_bool:boolean>>"
POINT = f"struct<measurement:string,tags:map<string,string>,fields:{FIELD_MAP}>"


def _entry_rows(df: DataFrame, shape: str, path: tuple[str, ...]) -> DataFrame:
    at = casts.leaf("body", *path) if path else "body"
    if shape == "one":
        return df.filter(casts.is_object("body", *path)).selectExpr(
            "*", "cast(null as string) as entry_key", f"{at} as entry"
        )
    if shape == "many":
        return df.selectExpr("*", "cast(null as string) as entry_key", f"explode({casts.objects_of('body', *path)}) as entry")
    if shape == "map":
        return nested.explode_map(df, at)
    if shape == "slots":
        slots = casts.first_path("body", [(name,) for name in path[0].split("|")])
        by_slot = nested.explode_map(df, slots, "entry_key", "_slot")
        return by_slot.selectExpr("*", f"explode({casts.objects_of('_slot', 'entry')}) as entry").drop("_slot")
    if shape in ("plane", "cores"):
        planes = casts.first_path("body", [("resource-monitor", "data-processors"), ("resource-monitor",)])
        chosen = casts.first_key("p", ["dp0", "s1dp0"])
        second = casts.first_path("p", [("dp0", "second"), ("s1dp0", "second")])
        found = casts.bound(planes, f"named_struct('entry_key', {chosen}, 'entry', {second})", "p")
        rows = df.selectExpr("*", f"inline(array({found}))").filter("entry IS NOT NULL")
        if shape == "plane":
            return rows
        cores = casts.objects_of("entry", "cpu-load-average", "entry")
        return rows.withColumn("entry", F.expr(f"explode({cores})"))
    if shape == "summary":
        keyed = f"map_filter({casts.as_object(at)}, (_, v) -> {casts.is_object('v')})"
        routers = casts.bound(keyed, f"CASE WHEN size(m) > 0 THEN m ELSE map('', {at}) END", "m")
        rows = df.filter(casts.is_object("body", *path)).selectExpr("*", f"explode({routers}) as (entry_key, entry)")
        return rows.withColumn("entry_key", F.expr("nullif(entry_key, '')"))
    raise ValueError(f"unknown shape {shape}")


def _typed(kind: str, source: str) -> tuple[str, str]:
    """Wide type and typed SQL text of a plain field read from ``source`` of the entry."""
    keys = source.split("/")
    text, value = casts.leaf_text("entry", *keys), casts.leaf("entry", *keys)
    if kind.startswith("raw:"):
        return kind[4:], casts.get_as("entry", kind[4:], *keys)
    if kind == "int":
        return "bigint", casts.int_of_leaf(value)
    if kind.startswith("float"):
        return "double", casts.bound(text, casts.float_of_text("n", int(kind[5:] or 2)), "n")
    if kind == "yesno":
        return "boolean", casts.yes_no(text)
    if kind == "truthy":
        return "bigint", casts.truthy_leaf(value)
    if kind == "size":
        return "double", casts.exact_round(casts.gigabytes_of_text(text), 2)
    if kind == "percent":
        return "double", casts.percent_of_text(text)
    if kind == "mean":
        return "double", casts.mean_of_csv(text)
    raise ValueError(f"unknown field kind {kind}")


def _slot(wide_type: str, value: str) -> str:
    """Value struct with the slot of one type filled."""
    return "named_struct({})".format(
        ", ".join(
            f"'{slot}', {value if kind == wide_type else f'cast(null as {kind})'}" for kind, slot in VALUE_TYPES.items()
        )
    )


def _as_it_came(value: str) -> str:
    """Value struct of an untyped field: the slot follows the type found in the document."""
    slots = ", ".join(
        f"'{slot}', CASE WHEN k.label = '{label}' THEN {casts.get_as('k.x', kind)} END"
        for label, (kind, slot) in zip(("integer", "float", "string", "boolean"), VALUE_TYPES.items())
    )
    labelled = casts.bound(value, f"CASE WHEN x IS NOT NULL THEN named_struct('x', x, 'label', {casts.leaf_label('x')}) END", "x")
    return casts.bound(labelled, f"named_struct({slots})", "k")


def _tags(spec: Measurement, none_text: bool) -> dict[str, str]:
    out: dict[str, str] = {}
    if spec.key_tag:
        out[spec.key_tag] = "entry_key"
    for name, source in spec.tags:
        text = casts.leaf_text("entry", *source.split("/"))
        out[name] = f"coalesce({text}, 'None')" if none_text and name in spec.filled_tags else text
    return out | spec.computed_tags


def _values(spec: Measurement) -> dict[str, tuple[str, str]]:
    """Wide type and SQL text of every field."""
    plain = {n: _typed(kind, source) for n, source, kind in spec.fields}
    return plain | spec.computed


def _read_together(spec: Measurement) -> tuple[str | None, dict[str, tuple[str, str]]]:
    """Type of a struct of the untyped fields, and where each is found in ``_raw``, a column of that type.

    One walk over an entry fills it, where fields read one by one search the entry's names once each. A leaf of
    another type is null there too, and leaves its siblings alone. A field whose path crosses that of another one is left out.
    """
    tree: dict = {}
    found: dict[str, tuple[str, str]] = {}
    for name, source, kind in spec.fields:
        if not kind.startswith("raw:"):
            continue
        node, keys = tree, source.split("/")
        for i, key in enumerate(keys):
            wanted = kind[4:] if i == len(keys) - 1 else {}
            held = node.setdefault(key, wanted)
            twins = sum(other.lower() == key.lower() for other in node)
            if twins > 1 or isinstance(held, dict) != isinstance(wanted, dict) or (isinstance(held, str) and held != wanted):
                break
            node = held
        else:
            found[name] = kind[4:], "_raw" + "".join(f".`{key}`" for key in keys)

    def ddl(node: dict) -> str:
        return f"struct<{','.join(f'`{k}`:{ddl(v) if isinstance(v, dict) else v}' for k, v in node.items())}>"

    clash = any(len({k.lower() for k in node}) < len(node) for node in _nodes(tree))
    return (None, {}) if clash or len(found) < 2 else (ddl(tree), found)


def _nodes(tree: dict) -> list[dict]:
    return [tree, *[inner for v in tree.values() if isinstance(v, dict) for inner in _nodes(v)]]


def wide(collections: DataFrame, spec: Measurement, none_text: bool = False) -> DataFrame:
    """Typed table of one measurement; a row without any field value is left out."""
    rows = _entry_rows(_of(collections, spec), spec.shape, spec.path)
    together, found = _read_together(spec)
    if together:
        rows = rows.selectExpr("*", f"{casts.get_as('entry', together)} as _raw")
    values = _values(spec) | found
    # A tag may share its name with a field (local_as) or a context column (device of a disk); it then
    # gets a suffix. The row travels as one generated struct: a filter on plain columns would be pushed below the projection and
    # evaluate every expression twice.
    taken = {*values, *CONTEXT}
    parts = [f"'{n}_tag' , nullif({c}, '')" if n in taken else f"'{n}', nullif({c}, '')" for n, c in _tags(spec, none_text).items()]
    parts += [f"'{n}', {c}" for n, (_, c) in values.items()]
    any_value = " OR ".join(f"`{n}` IS NOT NULL" for n in values)
    return rows.selectExpr(*CONTEXT, f"inline(array(named_struct({', '.join(parts)})))").filter(any_value)


def _of(collections: DataFrame, spec: Measurement) -> DataFrame:
    names = ("vpn_tunnels", "active_tunnels") if spec.collection == "vpn_tunnels" else (spec.collection,)
    return collections.filter(
        (F.col("module") == spec.module) & F.col("collection").isin(*names) & ~F.col("superseded")
    )


def _point(spec: Measurement, none_text: bool, asked: Iterable[str] | None = None) -> str:
    """SQL text of the point struct of one entry.

    With ``asked``, fields that no name or pattern there asks for are computed only for a point that has none of the others.
    """
    fields = {}
    for name, source, kind in spec.fields:
        found = casts.leaf("entry", *source.split("/"))
        fields[name] = _as_it_came(found) if kind.startswith("raw:") else _slot(*_typed(kind, source))
    fields |= {name: _slot(wide_type, value) for name, (wide_type, value) in spec.computed.items()}
    tags = [f"'{n}', {c}" for n, c in _tags(spec, none_text).items()]
    tag_map = f"map_filter(map({', '.join(tags)}), (_, t) -> t <> '')" if tags else "cast(map() as map<string,string>)"
    live = " OR ".join(f"f.{slot} IS NOT NULL" for slot in VALUE_TYPES.values())

    def filled(names: list[str]) -> str:
        return f"map_filter(map({', '.join(f"'{n}', {fields[n]}" for n in names)}), (_, f) -> {live})"

    first = [n for n in fields if asked is None or any(fnmatchcase(n, pattern) for pattern in asked)] or list(fields)
    rest = [n for n in fields if n not in first]
    field_map = filled(first)
    if rest:
        field_map = casts.bound(field_map, f"CASE WHEN size(asked) > 0 THEN asked ELSE {filled(rest)} END", "asked")
    return f"cast(named_struct('measurement', '{spec.name}', 'tags', {tag_map}, 'fields', {field_map}) as {POINT})"


def _plain_points(
    collections: DataFrame, specs: Iterable[Measurement], none_text: bool, named: Collection[str] | None
) -> DataFrame:
    """Points of all measurements read from one place: one scan, one explode."""
    specs = list(specs)
    rows = _entry_rows(_of(collections, specs[0]), specs[0].shape, specs[0].path)
    asked = named if isinstance(named, Mapping) else {}
    listed = ", ".join(_point(s, none_text, asked.get(s.name)) for s in specs)
    return rows.selectExpr(*CONTEXT, "module", f"inline(array({listed}))")


def route_list(collections: DataFrame, collection: str) -> DataFrame:
    """Flat routes of either layout: context, vrf, destination, protocol, flags."""
    rows = collections.filter(
        (F.col("module") == "routing") & (F.col("collection") == collection) & ~F.col("superseded")
    )
    listed = F.expr(f"{casts.leaf('body', 'entry')} IS NOT NULL")
    older, newer = nested.by_routing_mode(rows, F.col("routing_mode"), listed)
    flat_older = nested.route_rows(older, "body", CONTEXT).select(
        *CONTEXT,
        "vrf",
        "destination",
        F.try_variant_get(F.col("route")["protocol"], "$", "string").alias("protocol"),
        F.try_variant_get(F.col("route")["flags"], "$", "string").alias("flags"),
    )
    by_vrf = nested.explode_map(newer, "body", "vrf", "_prefixes")
    by_prefix = nested.explode_map(by_vrf, "_prefixes", "destination", "_routes")
    flat_newer = by_prefix.selectExpr(
        *CONTEXT, "vrf", "destination", f"explode({casts.as_list('_routes')}) as _route"
    ).selectExpr(
        *CONTEXT, "vrf", "destination", f"{casts.leaf_text('_route', 'protocol')} as protocol",
        f"{casts.leaf_text('_route', 'flags')} as flags",
    )
    return flat_older.unionByName(flat_newer)


def _int_map(entries: Column) -> Column:
    nothing = {kind: F.lit(None).cast(kind) for kind in VALUE_TYPES}
    return F.transform_values(
        entries,
        lambda _, v: F.struct(*[(v if kind == "bigint" else nothing[kind]).alias(s) for kind, s in VALUE_TYPES.items()]),
    ).cast(FIELD_MAP)


def route_points(collections: DataFrame) -> DataFrame:
    """Route counts per router and protocol, and the two totals used without a routing table."""
    routes = route_list(collections, "routing_table")
    counted = rollup.protocol_fields(
        routes, (*CONTEXT, "vrf"), rollup.route_protocol(F.col("protocol"), F.col("flags"))
    )
    fields = F.map_concat(
        "routes_by_protocol", F.create_map(F.lit("routes_total"), F.col("routes_total"))
    )
    points = counted.select(
        *CONTEXT,
        F.lit("routing").alias("module"),
        F.lit("routing_table_counts").alias("measurement"),
        F.create_map(F.lit("vrf"), F.col("vrf")).alias("tags"),
        _int_map(fields).alias("fields"),
    )
    for name in ("static_routes", "bgp_routes"):
        totals = rollup.row_totals(route_list(collections, name), CONTEXT, "n").select(
            *CONTEXT,
            F.lit("routing").alias("module"),
            F.lit(f"{name}_count").alias("measurement"),
            F.create_map().cast("map<string,string>").alias("tags"),
            _int_map(F.create_map(F.lit(name), F.col("n"))).alias("fields"),
        )
        points = points.unionByName(totals)
    return points


def counter_entries(collections: DataFrame) -> DataFrame:
    rows = collections.filter((F.col("module") == "counters") & (F.col("collection") == "global_counters"))
    entries = nested.explode_entries(rows, casts.leaf("body", "global", "counters", "entry"))
    return entries.selectExpr(
        *CONTEXT,
        "pos",
        f"{casts.leaf_text('entry', 'category')} as category_name",
        f"{casts.leaf_text('entry', 'name')} as name",
        f"{casts.int_of_leaf(casts.leaf('entry', 'value'))} as value",
        f"{casts.int_of_leaf(casts.leaf('entry', 'rate'))} as rate",
        f"{casts.leaf_text('entry', 'severity')} as severity",
    )


def category_points(collections: DataFrame, min_entries: int = rollup.MIN_CATEGORY) -> DataFrame:
    """One point per counter category of at least ``min_entries`` entries; names are data."""
    counters = rollup.category_counters(
        counter_entries(collections), CONTEXT, F.col("category_name"), F.col("name"), ("value", "rate"), "pos", min_entries
    )
    pairs = counters.select(
        *CONTEXT,
        "category",
        F.explode(
            F.array(
                F.struct(F.col("counter").alias("key"), F.col("value").alias("value")),
                F.struct(F.concat("counter", F.lit("_rate")).alias("key"), F.col("rate").alias("value")),
            )
        ).alias("pair"),
    ).filter(F.col("pair.value").isNotNull())
    return pairs.groupBy(*CONTEXT, "category").agg(F.map_from_entries(F.collect_list("pair")).alias("values")).select(
        *CONTEXT,
        F.lit("counters").alias("module"),
        F.concat(F.lit("counters_"), F.col("category")).alias("measurement"),
        F.create_map().cast("map<string,string>").alias("tags"),
        _int_map(F.col("values")).alias("fields"),
    )


def points(
    collections: DataFrame, none_text: bool = False, present: set[str] | None = None, named: Collection[str] | None = None
) -> DataFrame:
    """Every point of the given collections (see ``sources.snapshots.collections``).

    ``present`` names the collections that occur, when that is known (a micro-batch, the folders of
    the collection table); passes over other collections are then left out of the plan. ``named`` names the
    measurements that are asked for, when others would be dropped later anyway (those that a list of rules names). As a
    mapping it also gives the fields asked for, each a name or a pattern with ``*``: a point then has all of those that it
    holds, and others only if it holds none, so no point is lost.

    Measurements that read the same entries share a pass, and each pass filters on (module,
    collection), so on the partitioned collection table every file is read by few passes.
    """
    specs = sorted((s for s in MEASUREMENTS.values() if named is None or s.name in named), key=lambda s: s.reading())
    parts = [
        _plain_points(collections, group, none_text, named)
        for (_, name, _, _), group in groupby(specs, key=lambda s: s.reading())
        if present is None or present & {name, *(f for f, first in FALLBACKS.items() if first == name), FALLBACKS.get(name, name)}
    ]
    if present is None or present & {"routing_table", "static_routes", "bgp_routes"}:
        parts.append(route_points(collections))
    if present is None or "global_counters" in present:
        parts.append(category_points(collections))
    if not parts:
        parts = [route_points(collections.limit(0))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if named is not None:
        out = out.filter(F.col("measurement").isin(*named))
    return out.filter(F.size("fields") > 0)


def with_hostname(df: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Resolve the host name of points (see ``joins.resolve_hosts``) and make it a tag."""
    resolved = resolve_hosts(df, hosts)
    return resolved.withColumn(
        "tags", live_tags(F.map_concat(F.col("tags"), F.create_map(F.lit("hostname"), F.col("hostname"))))
    )


def long_metrics(point_rows: DataFrame) -> DataFrame:
    """One row per field: the four typed value columns, and the tag set as text for grouping."""
    series = F.array_join(
        F.transform(
            F.array_sort(F.map_keys("tags")), lambda k: F.concat(k, F.lit("="), F.col("tags")[k])
        ),
        ",",
    )
    return point_rows.select(
        "*", series.alias("series"), F.explode("fields").alias("field", "value")
    ).select(*[c for c in point_rows.columns if c != "fields"], "series", "field", "value.*")


def melt(df: DataFrame, ids: list[str], values: list[str], field: str = "field", value: str = "value") -> DataFrame:
    """Wide to long, nulls left out."""
    return df.unpivot(ids, values, field, value).filter(F.col(value).isNotNull())
