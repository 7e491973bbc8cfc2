"""Device documents derived from the given tables.

A ``Device`` view turns every row of a table into the collection body a device would have sent:
JSON text assembled in Spark, parsed to VARIANT, with one entry for even keys (as a bare object)
and two for odd ones (as a list). The expressions are plain SQL, so the same numbers can be
computed without going through documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.project import CONTEXT
from fleetlens.operators.specs import Measurement
from fleetlens.plans.ticks import spread, table

KEYS = {
    "customer": "c_custkey",
    "orders": "o_orderkey",
    "part": "p_partkey",
    "supplier": "s_suppkey",
    "documents": "doc_id",
}


def whole(i: int) -> str:
    return f"cast((n * 31 + {i} * 7) % 1000 as bigint)"


def real(i: int) -> str:
    return f"cast((n * 13 + {i} * 5) % 4000 as double) / 4"


def word(i: int) -> str:
    return f"case when (n + {i}) % 7 = 0 then null else 'v{i}-' || cast((n + {i}) % 23 as string) end"


def text(expression: str) -> str:
    return f"cast({expression} as string)"


@dataclass(frozen=True)
class Plan:
    """Source values of a measurement (path → SQL) and what they should become (name → SQL)."""

    spec: Measurement
    table: str = "customer"
    leaves: dict[str, str] = field(default_factory=dict)
    expected: dict[str, str] = field(default_factory=dict)

    def sources(self) -> dict[str, str]:
        out = {path: word(50 + i) for i, (_, path) in enumerate(self.spec.tags)}
        for i, (_, path, kind) in enumerate(self.spec.fields):
            out[path] = self._field(i, kind)[0]
        return out | self.leaves

    def values(self) -> dict[str, str]:
        out = {}
        for i, (name, _, kind) in enumerate(self.spec.fields):
            out[name] = self._field(i, kind)[1]
        for i, (name, _) in enumerate(self.spec.tags):
            out[f"{name}_tag" if name in out or name in self.spec.computed or name in CONTEXT else name] = word(50 + i)
        if self.spec.key_tag:
            out[self.spec.key_tag] = "entry_key"
        return out | self.expected

    @staticmethod
    def _field(i: int, kind: str) -> tuple[str, str]:
        if kind in ("int", "raw:bigint"):
            return (text(whole(i)) if kind == "int" and i % 2 else whole(i)), whole(i)
        if kind == "float1":
            half = f"cast((n * 13 + {i} * 5) % 4000 as double) / 2"
            return text(half), half
        if kind.startswith("float") or kind == "raw:double":
            return (text(real(i)) if kind != "raw:double" and i % 2 else real(i)), real(i)
        if kind == "raw:string":
            return word(i), word(i)
        if kind == "yesno":
            choice = f"case (n + {i}) % 3 when 0 then 'yes' when 1 then 'no' else 'maybe' end"
            return choice, f"case (n + {i}) % 3 when 0 then true when 1 then false end"
        if kind == "truthy":
            return f"(n + {i}) % 2 = 0", f"cast((n + {i} + 1) % 2 as bigint)"
        if kind == "size":
            size = f"cast((n + {i}) % 100 as bigint)"
            shown = f"case n % 3 when 0 then {text(size)} || 'G' when 1 then {text(f'{size} * 1048576')} || 'M' else {text(size)} || 'T' end"
            return shown, f"case n % 3 when 2 then cast({size} * 1024 as double) else cast({size} as double) end"
        if kind == "percent":
            return f"{text(real(i))} || '%'", real(i)
        if kind == "mean":
            first, second = f"(n + {i}) % 50", f"(n * 3 + {i}) % 50"
            return f"{text(first)} || ', ' || {text(second)} || ','", f"cast({first} + {second} as double) / 2"
        raise ValueError(kind)


def _struct(leaves: dict[str, str]) -> str:
    """Nested ``named_struct`` of slash-separated paths."""
    tree: dict = {}
    for path, expression in leaves.items():
        node = tree
        *parents, last = path.split("/")
        for parent in parents:
            node = node.setdefault(parent, {})
        node[last] = expression

    def render(node: dict) -> str:
        parts = [f"'{k}', {render(v) if isinstance(v, dict) else v}" for k, v in node.items()]
        return f"named_struct({', '.join(parts)})"

    return render(tree)


ENTRY_KEYS = {"map": "'m' || cast(n as string)", "summary": "'vr' || cast(n as string)"}


def _numbered(expression: str, j: int) -> str:
    # The n of entry j, written out so that no lateral alias is needed.
    import re

    return re.sub(r"\bn\b", f"(k * 2 + {j})", expression)


def body_sql(plan: Plan) -> str:
    """SQL of the collection body of one device with key ``k``."""
    shape, path = plan.spec.shape, plan.spec.path
    one, two = (f"to_json({_numbered(_struct(plan.sources()), j)})" for j in (0, 1))
    many = f"case when k % 2 = 0 then {one} else concat('[', {one}, ',', {two}, ']') end"

    def wrap(inner: str, names: tuple[str, ...]) -> str:
        opening = "".join(f'{{"{name}":' for name in names)
        return f"concat('{opening}', {inner}, '{'}' * len(names)}')"

    if shape == "one":
        return wrap(one, path)
    if shape == "many":
        return wrap(many, path)
    if shape in ("map", "summary"):
        key_0, key_1 = (_numbered(ENTRY_KEYS[shape], j) for j in (0, 1))
        pairs = (
            f"case when k % 2 = 0 then concat('{{\"', {key_0}, '\":', {one}, '}}') "
            f"else concat('{{\"', {key_0}, '\":', {one}, ',\"', {key_1}, '\":', {two}, '}}') end"
        )
        if shape == "summary":
            pairs = f"case when k % 2 = 0 then {one} else {pairs} end"
        return wrap(pairs, path)
    if shape == "slots":
        return wrap(f"concat('{{\"s1\":{{\"entry\":', {many}, '}},\"note\":\"-\"}}')", (path[0].split("|")[0],))
    second = one if shape == "plane" else wrap(many, ("cpu-load-average", "entry"))
    return (
        "concat(case when k % 3 = 0 then '{\"resource-monitor\":{\"data-processors\":{\"dp0\":' "
        "else '{\"resource-monitor\":{\"s1dp0\":' end, "
        f"{wrap(second, ('second',))}, case when k % 3 = 0 then '}}}}}}' else '}}}}' end)"
    )


def collection_rows(spark: SparkSession, sf_dir: str, plan: Plan) -> DataFrame:
    """Collection rows of one measurement, one per row of the source table."""
    rows = spread(table(spark, sf_dir, plan.table).select(F.col(KEYS[plan.table]).cast("bigint").alias("k")), "k", per_core=3)
    return rows.select(
        F.lit(None).cast("timestamp").alias("collected_at"),
        F.lit(plan.spec.module).alias("module"),
        F.concat(F.lit("dev-"), F.col("k")).alias("device"),
        F.lit(None).cast("string").alias("hostname"),
        F.lit(None).cast("string").alias("data_hostname"),
        F.lit("advanced").alias("routing_mode"),
        F.lit(plan.spec.collection).alias("collection"),
        F.expr(f"parse_json({body_sql(plan)})").alias("body"),
        F.lit(False).alias("superseded"),
    )


def expected_sql(plan: Plan) -> str:
    """The wide table computed directly from the source table."""
    key = KEYS[plan.table]
    shape = plan.spec.shape
    several = shape in ("many", "map", "slots", "cores", "summary")
    entry_key = ENTRY_KEYS.get(shape, "null")
    if shape == "summary":
        entry_key = f"case when k % 2 = 1 then {entry_key} end"
    if shape in ("plane", "cores"):
        entry_key = "case when k % 3 = 0 then 'dp0' else 's1dp0' end"
    rows = (
        f"select k, j, k * 2 + j as n from (select cast({key} as bigint) as k from {plan.table}) t, "
        f"(values (0), (1)) v(j) where j = 0 {'or k % 2 = 1' if several else ''}"
    )
    columns = ", ".join(f'{value} as "{name}"' for name, value in plan.values().items())
    return (
        f"with r as ({rows}), e as (select *, {entry_key} as entry_key from r) "
        f"select 'dev-' || cast(k as string) as device, {columns} from e"
    )
