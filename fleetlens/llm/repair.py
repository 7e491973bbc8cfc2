"""Conversation structure repair by iterative-deepening A*.

A conversation should read: a system turn or none, then pairs of a user's and an assistant's turn, or nothing at all. The
cheapest edits that make it so are searched depth first, in the ASCII order of their letters (Delete, Insert, Keep,
Rerole), under a cost bound that rises to the least cost beyond it until a path is accepted; so the first path
accepted is the least of the cheapest ones. The estimate of what is left is exact for a simpler rule, in which a
conversation may also end after its system turn. States that failed with as much to spend are passed over.

A conversation of more than ``max_rows`` rows is cut into slices. Each slice gives the cheapest cost from every state in
which it can be entered to every state in which it can be left; from these, back from the end, follows what leaving a
slice in a state costs. With that, each slice is searched on its own for every entry, and the maps from entry to exit,
taken in order, tell which entry is the real one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import written
from fleetlens.plans.slicing import SLICE, slice_hot

#: Rows of a conversation that one task holds.
MAX_ROWS = 20_000
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: States by what has been read: nothing, a system turn, a user's turn, an assistant's turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP_TO = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FORCED_TO = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What is still to be inserted after the last row, by state, and its cost.
TAILS = ((), (USER, ASSISTANT), (ASSISTANT,), ())
ENDS = tuple(len(t) * INSERT for t in TAILS)
LEGAL = ("su", "ua", "au")
FAR = 1 << 60

Row = tuple[str, bool, int]  # initial of the role, whether it must go, cost of leaving it as it is


def _estimates(rows: list[Row], ends: tuple[int, ...]) -> tuple[list[int], ...]:
    """Least cost from each row on, by state, if a conversation may also end after its system turn."""
    n = len(rows)
    nothing, user, assistant = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    b, u, a = ends[NOTHING], min(ends[SYSTEM], ends[ASSISTANT]), ends[USER]
    nothing[n], user[n], assistant[n] = b, u, a
    for i in range(n - 1, -1, -1):
        initial, must_go, extra = rows[i]
        to_b, to_u, to_a = b + DELETE, u + DELETE, a + DELETE
        if not must_go:
            other = a + REROLE + extra
            to_b = min(to_b, other, (a if initial == "u" else u if initial == "s" else FAR) + extra)
            to_u = min(to_u, other, (a if initial == "u" else FAR) + extra)
            to_a = min(to_a, u + REROLE + extra, (u if initial == "a" else FAR) + extra)
        u, a = min(to_u, to_a + INSERT), min(to_a, to_u + INSERT)
        b = min(to_b, a + INSERT)
        nothing[i], user[i], assistant[i] = b, u, a
    return nothing, user, assistant, user


def search(rows: list[Row], entry: int = NOTHING, ends: tuple[int, ...] = ENDS) -> tuple[str, int, int]:
    """Edits, state after them, and their cost with that of ``ends``; what is inserted after the last row is left out."""
    n = len(rows)
    left = _estimates(rows, ends)
    bound = left[entry][0]
    while True:
        failed: dict[tuple[int, int], int] = {}
        beyond, path = FAR, []
        stack = [(0, entry, 0, 0)]
        while stack:
            i, state, cost, edit = stack.pop()
            if i == n:
                if cost + ends[state] <= bound:
                    return "".join(path), state, cost + ends[state]
                beyond = min(beyond, cost + ends[state])
                if path:
                    path.pop()
                continue
            if edit == 0 and failed.get((i, state), -1) >= bound - cost:
                if path:
                    path.pop()
                continue
            initial, must_go, extra = rows[i]
            while edit < 4:
                j, to, more = i + 1, state, DELETE
                if edit == 1:
                    j, to, more = i, FORCED_TO[state], INSERT
                elif edit == 2:
                    to, more = KEEP_TO[state].get(initial, -1), extra
                elif edit == 3:
                    to, more = FORCED_TO[state], REROLE + extra
                edit += 1
                if to < 0 or (must_go and edit > 2):
                    continue
                most = cost + more + left[to][j]
                if most <= bound:
                    stack += [(i, state, cost, edit), (j, to, cost + more, 0)]
                    path.append("DIKR"[edit - 1])
                    break
                beyond = min(beyond, most)
            else:
                failed[i, state] = max(failed.get((i, state), -1), bound - cost)
                if path:
                    path.pop()
        if beyond >= FAR:
            raise ValueError("no edits lead to an accepted end")
        bound = beyond


def costs_between(rows: list[Row]) -> list[list[int]]:
    """Cheapest cost from each entry to each exit, without what is inserted after the last row."""
    out = []
    for entry in range(4):
        now = [FAR] * 4
        now[entry] = 0
        for initial, must_go, extra in rows:
            for _ in range(2):
                for s, to in enumerate(FORCED_TO):
                    now[to] = min(now[to], now[s] + INSERT)
            after = [c + DELETE for c in now]
            if not must_go:
                for s in range(4):
                    if initial in KEEP_TO[s]:
                        after[KEEP_TO[s][initial]] = min(after[KEEP_TO[s][initial]], now[s] + extra)
                    after[FORCED_TO[s]] = min(after[FORCED_TO[s]], now[s] + REROLE + extra)
            now = after
        out.append([min(c, FAR) for c in now])
    return out


def faults(roles: list[str], texts: list[str], again: list[bool | None]) -> list[str | None]:
    """First fault of each row; ``again``: whether the same role and text stand in an earlier row, where that is known."""
    seen, found = set(), []
    for role, text, known in zip(roles, texts, again):
        end = text.rstrip(BLANKS)[-1:]
        key = (role, text)
        duplicate = key in seen if known is None else known
        seen.add(key)
        found.append("blank" if not end else "duplicate" if duplicate else "truncated" if end not in ".!?" else None)
    return found


def edited(roles: list[str], texts: list[str], path: str, entry: int, tail: tuple[int, ...]) -> list[tuple]:
    """(edit, role, text) for each edit; role and text are null where a row is deleted."""
    out, i, state = [], 0, entry
    for edit in path:
        if edit == "D":
            out.append((edit, None, None))
        elif edit == "K":
            state = KEEP_TO[state][roles[i][:1]]
            out.append((edit, roles[i], texts[i]))
        else:
            state = FORCED_TO[state]
            out.append((edit, NAMES[state], "" if edit == "I" else texts[i]))
        i += edit != "I"
    return out + [("I", NAMES[s], "") for s in tail]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Columns of each stretch of rows equal in conv_id and slice; a stretch may go over several batches."""
    held: dict[str, list] = {}
    for batch in batches:
        columns = {name: batch[name].to_pylist() for name in batch.schema.names}
        keys = list(zip(columns["conv_id"], columns[SLICE]))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            part = {name: values[start:i] for name, values in columns.items()}
            if held and (held["conv_id"][0], held[SLICE][0]) == keys[start]:
                for name, values in part.items():
                    held[name] += values
            else:
                if held:
                    yield held
                held = part
            start = i
    if held:
        yield held


def _rows_of(group: dict[str, list]) -> tuple[list[str | None], list[Row]]:
    found = faults(group["role"], group["text"], group["again"])
    kinds = [
        (role[:1], fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0)
        for role, fault in zip(group["role"], found)
    ]
    return found, kinds


PART = (
    "{slice} long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
    "first_turn {turn}, last_turn {turn}, turns long, cost long, edits array<struct<edit:string,role:string,text:string>>"
)


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(e[2] or "") for e in row[-1] if isinstance(e, tuple))
        if len(held) >= 2000 or size > 8 << 20:
            yield _frame(held, schema)
            held, size = [], 0
    if held:
        yield _frame(held, schema)


def _repaired(schema: pa.Schema):
    """Each group searched, entered in ``entry`` and left at the cost of ``ends``."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in _groups(batches):
            found, rows = _rows_of(group)
            entry, ends, last = group["entry"][0], tuple(group["ends"][0]), group["is_last"][0]
            path, state, total = search(rows, entry, ends)
            initials = [row[0] for row in rows]
            turns = [t for t in group["turn"] if t is not None]
            yield (
                group["conv_id"][0], group[SLICE][0], found.count("blank"), found.count("duplicate"), found.count("truncated"),
                sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), initials[0], initials[-1],
                turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)),
                total - (0 if last else ends[state]),
                edited(group["role"], group["text"], path, entry, TAILS[state] if last else ()),
            )

    return lambda batches: _batched(parts(batches), schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of a conversation and slice in one task, by turn (null first), then role and digest of the text."""
    return rows.repartition("conv_id", SLICE).sortWithinPartitions("conv_id", SLICE, "turn", "role", "digest")


def _maps(schema: pa.Schema, searched: bool):
    """A row for each slice: costs between all states, or, with ``ends`` known, the exit for each entry."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in _groups(batches):
            rows = _rows_of(group)[1]
            if searched:
                ends = tuple(group["ends"][0])
                said = [search(rows, entry, ends)[1] for entry in range(4)]
            else:
                said = [c for costs in costs_between(rows) for c in costs]
            yield group["conv_id"][0], group[SLICE][0], said

    return lambda batches: _batched(found(batches), schema)


def _ends(of: pd.DataFrame) -> pd.DataFrame:
    """What leaving each slice of a conversation costs, by state, from the costs between states of the later ones."""
    of = of.sort_values(SLICE, ascending=False)
    now, ends, last = ENDS, [], []
    for costs in of["said"]:
        ends.append(list(now))
        last.append(not last)
        now = tuple(min(costs[4 * s + t] + now[t] for t in range(4)) for s in range(4))
    return of.assign(ends=ends, is_last=last)[["conv_id", SLICE, "ends", "is_last"]]


def _entries(of: pd.DataFrame) -> pd.DataFrame:
    """The state in which each slice of a conversation is entered, from the maps of the earlier ones."""
    of = of.sort_values(SLICE)
    now, entries = NOTHING, []
    for exits in of["said"]:
        entries.append(now)
        now = int(exits[now])
    return of.assign(entry=entries)[["conv_id", SLICE, "entry"]]


def _beside(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Rows with the columns of their slice: a row for each of some 20,000 rows, joined without a hint."""
    named = few.withColumnsRenamed({"conv_id": "_conv", SLICE: "_nth"})
    match = rows["conv_id"].eqNullSafe(named["_conv"]) & (rows[SLICE] == named["_nth"])
    return rows.join(named, match).drop("_conv", "_nth")


def _first_seen(rows: DataFrame) -> DataFrame:
    """Rows of sliced conversations with ``again``: true if an equal role and text stand at an earlier turn, else null. Equal
    rows of one turn are in one slice, which sees them itself. Only what recurs is joined."""
    firsts = (
        rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1").withColumnsRenamed({"conv_id": "_conv", "role": "_role", "digest": "_digest"})
    )
    match = rows["conv_id"].eqNullSafe(firsts["_conv"]) & (rows["role"] == firsts["_role"]) & (rows["digest"] == firsts["_digest"])
    later = F.when(F.struct("turn") > F.col("_first"), F.lit(True))
    return rows.join(firsts, match, "left").withColumn("again", later).drop("_conv", "_role", "_digest", "_first", "_n")


def repair(turns: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """conv_id, part, number of rows of each fault, of illegal pairs, first and last initial and turn, distinct turns, cost and
    edits (edit, role, text): one row for each conversation, or for each slice (part 1, 2, ..) of a long one.

    ``turns``: conv_id, turn, role, text; other columns are left out. A null role or text is one space, a null conv_id a
    conversation of its own, a null turn comes first. Rows of one turn are taken by role, then by the SHA-256 of the text. A row's first fault
    counts: blank (only ASCII white space), duplicate (role and text stood earlier), truncated (its last other character
    is none of ``.!?``). Blank and duplicate rows are deleted (4); other rows are kept, deleted (4) or get another role (3);
    a truncated row costs 3 more unless it is deleted; inserting an empty turn costs 3. A role without initial s, u or a,
    the empty one included, cannot be kept. An empty table gives an empty table.
    """
    spark = turns.sparkSession
    rows = turns.select(
        turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"),
        F.coalesce(turns["role"].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(turns["text"].cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    conv, turn = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    part = f"conv_id {conv}, " + PART.format(slice=SLICE, turn=turn)
    done = _repaired(_arrow(spark, part))
    sliced = slice_hot(rows, ["conv_id"], ["turn", "role", "digest"], max_rows)
    whole = sliced.filter(F.col(SLICE) == 0).withColumns(
        {"again": F.lit(None).cast("boolean"), "entry": F.lit(NOTHING), "ends": F.array(*map(F.lit, ENDS)), "is_last": F.lit(True)}
    )
    found = _in_order(whole).mapInArrow(done, part)
    long = sliced.filter(F.col(SLICE) > 0)
    if not long.isEmpty():
        long = written(_first_seen(long), "conversations")
        said = f"conv_id {conv}, {SLICE} long, said array<long>"
        ordered = _in_order(long)
        costs = ordered.mapInArrow(_maps(_arrow(spark, said), False), said)
        ends = written(
            costs.groupBy("conv_id").applyInPandas(_ends, f"conv_id {conv}, {SLICE} long, ends array<long>, is_last boolean"),
            "ends",
        )
        exits = _in_order(_beside(long, ends)).mapInArrow(_maps(_arrow(spark, said), True), said)
        entries = exits.groupBy("conv_id").applyInPandas(_entries, f"conv_id {conv}, {SLICE} long, entry int")
        ready = _beside(_beside(long, ends), written(entries, "entries"))
        found = found.unionByName(_in_order(ready).mapInArrow(done, part))
    return found.withColumnRenamed(SLICE, "part")
