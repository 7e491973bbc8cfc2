"""Reshaping of nested, polymorphic documents held as VARIANT."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import casts

# Field names of the older routing layout and what they are called in the newer one.
PEER_RENAMES = {
    "status": "state",
    "status-duration": "status-time",
    "peer-group": "peer-group-name",
    "peer-address": "peer-ip",
    "local-address": "local-ip",
}


def explode_entries(df: DataFrame, value: str, into: str = "entry") -> DataFrame:
    """One row per entry of a one-or-many value (SQL text), with its position in the source list."""
    return df.select("*", F.expr(f"posexplode({casts.objects_of(value)}) as (pos, {into})"))


def explode_map(df: DataFrame, value: str, key: str = "entry_key", into: str = "entry") -> DataFrame:
    """One row per key of an object whose keys are data."""
    return df.select("*", F.expr(f"explode({casts.as_object(value)}) as ({key}, {into})"))


def gather_numbered(slots: Sequence[Column]) -> Column:
    """Values of numbered columns 0, 1, 2, … up to the first gap."""
    values = F.array(*slots)
    gap = F.array_position(F.transform(values, lambda v: F.when(v.isNull(), 1).otherwise(0)), 1)
    return F.when(gap == 0, values).otherwise(F.slice(values, F.lit(1), F.greatest(gap - 1, F.lit(0)).cast("int")))


JSON_END = "\u0001end"


def whole_json(text: Column) -> Column:
    """VARIANT of text that is one JSON value from start to end, else null.

    The parser stops after the first value; the marker behind the text shows that it got there.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"\\u0001end"]')))
    parts = F.try_variant_get(parsed, "$", "array<variant>")
    return F.when((F.size(parts) == 2) & (F.try_variant_get(parsed, "$[1]", "string") == JSON_END), parts[0])


def promote_json(fields: Column, key: str = "json") -> Column:
    """Merge the object held as text under ``key`` into its parent map.

    An object replaces the field with its members (they win over equal names before it), any other
    JSON value stays under ``key`` and text that is not JSON is kept as it is.
    """
    text = fields[key]
    parsed = whole_json(text)
    members = F.try_variant_get(parsed, "$", "map<string,string>")
    rest = F.map_filter(fields, lambda name, _: name != key)
    return (
        F.when(text.isNull(), fields)
        .when(members.isNotNull(), F.map_concat(rest, members))
        .when(
            parsed.isNotNull(),
            F.map_concat(rest, F.create_map(F.lit(key), F.try_variant_get(parsed, "$", "string"))),
        )
        .otherwise(fields)
    )


def peer_map(value: str) -> str:
    """SQL text: peers of an older-layout document as name → fields in the newer layout.

    Attributes are dropped and older field names replaced. Of equal peer names the last one stays,
    which is the map duplicate rule ``session.prepare`` sets.
    """
    renames = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in PEER_RENAMES.items())
    kept = f"map_filter({casts.as_object('e')}, (k, _) -> NOT startswith(k, '@'))"
    fields = f"transform_keys({kept}, (k, _) -> CASE k {renames} ELSE k END)"
    name = f"coalesce({casts.leaf_text('e', '@peer')}, {casts.leaf_text('e', 'peer-name')}, 'unknown')"
    entries = casts.objects_of(casts.leaf(value, "entry"))
    return f"map_from_entries(transform({entries}, e -> named_struct('k', {name}, 'v', {fields})))"


def summary_map(value: str) -> str:
    """SQL text: an older-layout routing summary as virtual router → fields."""
    fields = f"map_filter({casts.as_object(value, 'entry')}, (k, _) -> NOT startswith(k, '@'))"
    router = f"coalesce({casts.leaf_text(value, 'entry', '@virtual-router')}, 'default')"
    return f"CASE WHEN {casts.as_object(value, 'entry')} IS NOT NULL THEN map({router}, {fields}) END"


def peer_rows(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Peers of an older-layout document, one row each."""
    return df.select(*keys, F.expr(f"explode({peer_map(value)}) as (peer_name, fields)"))


def route_rows(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Flat routes of an older-layout document, with defaulted router and destination."""
    entries = explode_entries(df, casts.leaf(value, "entry"))
    return entries.select(
        *keys,
        "pos",
        F.expr(f"coalesce({casts.leaf_text('entry', 'virtual-router')}, 'default')").alias("vrf"),
        F.expr(f"coalesce({casts.leaf_text('entry', 'destination')}, 'unknown')").alias("destination"),
        F.expr(f"map_filter({casts.as_object('entry')}, (name, _) -> name <> 'virtual-router')").alias("route"),
    )


def summary_rows(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Older-layout routing summary, one row per virtual router."""
    return df.select(*keys, F.expr(f"explode({summary_map(value)}) as (vrf, fields)"))


def newer_layout(collection: str, mode: str, body: str) -> str:
    """SQL text: the body with older-layout peers and summaries rewritten, all others as they are.
    (Route lists stay flat; ``project.route_list`` reads both layouts.)"""
    older = f"{mode} = 'legacy' AND {casts.leaf(body, 'entry')} IS NOT NULL"
    return (
        f"CASE WHEN {collection} = 'bgp_peer_status' AND {older} THEN to_variant_object({peer_map(body)}) "
        f"WHEN {collection} = 'bgp_summary' AND {older} THEN to_variant_object({summary_map(body)}) ELSE {body} END"
    )


def by_routing_mode(df: DataFrame, mode: Column, usable: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that need the older layout rewritten, and all the others."""
    older = F.coalesce((mode == "legacy") & usable, F.lit(False))
    return df.filter(older), df.filter(~older)


KINDS = {bool: "boolean", int: "integer", float: "float", str: "string", list: "array", type(None): "null"}
NOT_JSON, TOO_DEEP = "not json", "too deep"


def leaves(document: str | None) -> Iterator[tuple[str, str]]:
    """(path, kind) of every leaf of a JSON text: objects are walked, everything else, lists included, is a leaf; envelopes
    are marked. Walked with a stack of its own. Text that is no JSON, or deeper than the parser goes (some thousands
    of levels), gives one row that says so."""
    import json

    try:
        whole = json.loads(document)
    except (TypeError, ValueError):
        yield "", NOT_JSON
        return
    except RecursionError:
        yield "", TOO_DEEP
        return
    stack = [("", whole)]
    while stack:
        path, value = stack.pop()
        if not isinstance(value, dict):
            yield path, KINDS[type(value)]
            continue
        if {"success", "data", "error"} <= value.keys():
            inner = value["data"]
            yield path, "nested envelope" if isinstance(inner, dict) and "success" in inner else "envelope"
        stack += [(f"{path}.{key}" if path else key, inner) for key, inner in reversed(value.items())]


#: Rows of a frame of leaves.
FRAME = 20_000


def leaf_profile(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Path and type of every leaf of a JSON document, envelopes marked.

    Documents nest to any depth, which no built-in generator follows, so each Arrow batch passes
    through a small Python helper; there is no shuffle.
    """
    import pandas as pd

    names = list(keys)

    def flatten(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False):
                *ids, document = record
                rows.extend((*ids, *found) for found in leaves(document))
                if len(rows) >= FRAME:
                    yield pd.DataFrame(rows, columns=[*names, "path", "kind"])
                    rows = []
            yield pd.DataFrame(rows, columns=[*names, "path", "kind"])

    selected = df.select(*names, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in selected.schema.fields[:-1])
    return selected.mapInPandas(flatten, f"{schema}, path string, kind string")


class LeafFlatten:
    """``leaf_flatten`` in SQL: the leaves of a document, as a lateral join or over a whole table.

    ``select d.id, f.* from docs d, lateral leaf_flatten(d.body) f`` gives path and kind;
    ``select * from leaf_flatten(table(docs) partition by (id), 'body')`` gives the other columns of the table beside them.
    """

    @staticmethod
    def analyze(document, text=None):
        from pyspark.sql.types import StringType, StructField, StructType
        from pyspark.sql.udtf import AnalyzeResult

        found = [StructField("path", StringType()), StructField("kind", StringType())]
        if not document.isTable:
            return AnalyzeResult(StructType(found))
        if text is None or text.value not in document.dataType.names:
            raise ValueError("name the column that holds the documents")
        others = [f for f in document.dataType.fields if f.name != text.value and f.name not in ("path", "kind")]
        return AnalyzeResult(StructType(others + found))

    def eval(self, document, text=None):
        if text is None:
            yield from leaves(document)
            return
        others = [document[name] for name in document.__fields__ if name not in (text, "path", "kind")]
        for found in leaves(document[text]):
            yield (*others, *found)


def register_functions(spark: SparkSession) -> None:
    """Make ``leaf_flatten`` known to SQL."""
    import sys

    from pyspark import cloudpickle
    from pyspark.sql.functions import udtf

    # the worker that analyses a call gets no files sent to the executors, so the class goes by value
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.udtf.register("leaf_flatten", udtf(LeafFlatten))
