"""State fed in event-time order: late rows, changing selections, forgotten keys.

Keys are dealt to groups, or each is its own. Rows of a group wait in a buffer of time buckets until the watermark has passed them, whatever files they came in; an
event-time timer then releases them in order, a bucket at a time, to the same steps that ``state`` takes. A row that
comes after its place has been passed is not lost: it is emitted with a reason, for a side table.

Control rows travel in the same order: from ``deselected`` on a key has no state and its samples are left out, from
``selected`` on it begins anew. A key that nothing names for ``idle_ms`` is forgotten (of a deselected one, that it is so
stays known). A heartbeat only moves the watermark.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from fleetlens.operators.series import PAUSE_AFTER
from fleetlens.streaming.state import (
    CHANGE_OUTPUT, CHANGE_STATE, PAUSE_OUTPUT, PAUSE_STATE, RATE_OUTPUT, RATE_STATE, as_text, change_step, grouped, numbered, pause_step,
    rate_step, typed,
)

#: Kinds of rows, as they are named in column ``kind``; the last one goes to no buffer.
SAMPLE, SELECTED, DESELECTED, HEARTBEAT = "sample", "selected", "deselected", "heartbeat"
#: Why a row is in the side output.
LATE, REPEATED = "late", "repeated"
#: Time of rows that are sorted together; a bucket of one group of keys must fit into memory.
BUCKET_US = 600_000_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class InOrder(StatefulProcessor):
    """Buffers the rows of a group of keys, releases them behind the watermark and steps over them key by key."""

    def __init__(
        self, step: Callable, schema: str, value: str, value_type: str, keys: Sequence[str], outputs: Sequence[str],
        selected: bool = True, idle_ms: int | None = None, bucket_us: int = BUCKET_US,
    ):
        self.step, self.schema, self.value, self.value_type = step, schema, value, value_type
        self.keys, self.outputs, self.selected = list(keys), list(outputs), selected
        self.idle_ms, self.bucket_us = idle_ms, bucket_us
        self.columns = [*self.keys, "ts_us", "tie", "kind", "value"]

    def init(self, handle) -> None:
        self.handle = handle
        named = ", ".join(f"{k} string" for k in self.keys)
        self.last = handle.getListState("last", f"{named}, {self.schema}")
        self.place = handle.getListState("place", f"{named}, ts_us bigint, tie bigint, selected boolean")
        self.parts = handle.getValueState("parts", "parts bigint")
        self.buffer = handle.getMapState(
            "buffer", "bucket bigint, part bigint",
            ", ".join(f"{k} array<string>" for k in self.keys)
            + f", ts_us array<bigint>, tie array<bigint>, kind array<string>, value array<{self.value_type}>",
        )

    def _read(self, state) -> dict[tuple, tuple]:
        n = len(self.keys)
        return {tuple(row[:n]): tuple(row[n:]) for row in state.get()}

    def _write(self, state, kept: dict[tuple, tuple]) -> None:
        if kept:
            state.put([(*name, *value) for name, value in kept.items()])
        else:
            state.clear()

    def _hold(self, rows: pd.DataFrame) -> None:
        """Puts rows into their buckets."""
        known = self.parts.get()
        first = part = known[0] if known else 0
        for bucket, some in rows.groupby(rows["ts_us"] // self.bucket_us):
            self.buffer.updateValue((int(bucket), part), tuple(some[c].tolist() for c in self.columns))
            part += 1
        if part > first:
            self.parts.update((part,))

    def _wake(self, ts_us: int) -> None:
        self.handle.registerTimer(-(-int(ts_us) // 1000))

    def _told(self, out: pd.DataFrame, reason: str | None = None) -> pd.DataFrame:
        full = out[self.keys].copy()
        for name in self.outputs:
            full[name] = out[name] if name in out else None
        full["reason"] = reason
        return full.reset_index(drop=True)

    def _passed(self, chunk: pd.DataFrame, places: dict) -> np.ndarray:
        """Which rows come after their place has been passed."""
        number, names = numbered(chunk, self.keys)
        at = [places.get(n) for n in names]
        known = np.array([p is not None for p in at])[number]
        at_ts = np.array([p[0] if p else 0 for p in at], dtype="int64")[number]
        at_tie = np.array([p[1] if p else 0 for p in at], dtype="int64")[number]
        ts, tie = chunk["ts_us"].to_numpy(), chunk["tie"].to_numpy()
        return known & ((ts < at_ts) | ((ts == at_ts) & (tie <= at_tie)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        places, come = self._read(self.place), []
        for chunk in rows:
            chunk = chunk[chunk["kind"] != HEARTBEAT]
            if places and len(chunk):
                passed = self._passed(chunk, places)
                if passed.any():
                    yield self._told(chunk[passed], LATE)
                    chunk = chunk[~passed]
            if len(chunk):
                come.append(chunk[self.columns])
        if come:
            held = pd.concat(come, ignore_index=True)
            self._hold(held)
            self._wake(held["ts_us"].min())

    def _released(self, held: pd.DataFrame, places: dict, known: dict) -> Iterator[pd.DataFrame]:
        """Output of the rows of a bucket that the watermark has passed; ``places`` and ``known`` go on to behind them."""
        number, names = numbered(held, self.keys)
        ts, tie = held["ts_us"].to_numpy(dtype="int64"), held["tie"].to_numpy(dtype="int64")
        place = np.lexsort((tie, ts, number))
        number, ts, tie = number[place], ts[place], tie[place]
        again = np.append(False, (np.diff(number) == 0) & (np.diff(ts) == 0) & (np.diff(tie) == 0))
        if again.any():
            yield self._told(held.iloc[place[again]], REPEATED)
        number, ts, tie, rows = number[~again], ts[~again], tie[~again], held.iloc[place[~again]]
        begin = np.searchsorted(number, np.arange(len(names)))
        end = np.append(begin[1:], len(number)) - 1
        kind = rows["kind"].to_numpy(dtype=object)
        off, on = kind == DESELECTED, kind == SELECTED
        before = np.array([places[n][2] if n in places else self.selected for n in names])
        latest = np.maximum.accumulate(np.where(off | on, np.arange(len(kind)), -1))
        selected = np.where(latest >= begin[number], on[latest], before[number])
        times = np.cumsum(off)
        times = times - (times - off)[begin][number]
        taken = (kind == SAMPLE) & selected
        if taken.any():
            samples = rows[taken].rename(columns={"value": self.value}).reset_index(drop=True)
            of, since = number[taken], times[taken]
            starts = np.append(True, (np.diff(of) != 0) | (np.diff(since) != 0))
            going = [known.get(names[n]) if t == 0 else None for n, t in zip(of[starts], since[starts])]
            states, out = self.step(going, np.cumsum(starts) - 1, samples)
            ended = {names[n]: (t, state) for n, t, state in zip(of[starts], since[starts], states)}
            if len(out):
                for k in self.keys:
                    out[k] = samples[k].iloc[out.index]
                yield self._told(out)
        else:
            ended = {}
        for n, (name, at) in enumerate(zip(names, end.tolist())):
            times_off, state = ended.get(name, (None, None))
            if times_off == times[at]:
                known[name] = state
            elif times[at]:
                known.pop(name, None)
            places[name] = (int(ts[at]), int(tie[at]), bool(selected[at]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        places, known = self._read(self.place), self._read(self.last)
        held: dict[int, list[int]] = {}
        for bucket, part in list(self.buffer.keys()):
            held.setdefault(bucket, []).append(part)
        for bucket in sorted(b for b in held if b * self.bucket_us <= limit):
            pieces = []
            for part in sorted(held[bucket]):
                pieces.append(pd.DataFrame(dict(zip(self.columns, self.buffer.getValue((bucket, part))))))
                self.buffer.removeKey((bucket, part))
            batch = pd.concat(pieces, ignore_index=True)
            waits = batch["ts_us"] > limit
            if waits.any():
                self._hold(batch[waits])
                self._wake(batch["ts_us"][waits].min())
            if not waits.all():
                yield from self._released(batch[~waits].reset_index(drop=True), places, known)
        later = [b for b in held if b * self.bucket_us > limit]
        if later:
            self._wake(min(later) * self.bucket_us)
        if self.idle_ms is not None:
            self._forget(limit, places, known)
        self._write(self.place, places)
        self._write(self.last, known)

    def _forget(self, limit: int, places: dict, known: dict) -> None:
        """Forgets keys that nothing has named for ``idle_ms`` and wakes when the next one will be due."""
        due = {n: p[0] + self.idle_ms * 1000 for n, p in places.items() if n in known or p[2] == self.selected}
        if any(at <= limit for at in due.values()):
            for _, rows in list(self.buffer.iterator()):
                for name in set(zip(*rows[: len(self.keys)])):
                    due.pop(name, None)
        for name in [n for n, at in due.items() if at <= limit]:
            del due[name]
            known.pop(name, None)
            if places[name][2] == self.selected:
                del places[name]
        if due:
            self._wake(min(due.values()))

    def close(self) -> None:
        pass


def _in_order(
    rows: DataFrame, step: Callable, schema: str, value: str, value_type: str, keys: Sequence[str], outputs: str, delay: str,
    selected: bool, idle_ms: int | None, bucket_us: int, groups: int | None,
) -> DataFrame:
    kind = F.coalesce(F.col("kind") if "kind" in rows.columns else F.lit(None), F.lit(SAMPLE))
    # A null makes pandas read the whole column as floats, also for the other keys of an Arrow batch, so rows that are
    # not samples get numbers for what they do not have.
    tie = F.coalesce(F.col("tie"), F.when(kind != SAMPLE, 0))
    held = F.coalesce(F.col(value).cast(value_type), F.when(kind != SAMPLE, F.lit(0).cast(value_type)))
    by = list(keys) if groups is None else ["key_group"]
    marked = (
        (rows if groups is None else grouped(rows, keys, groups)).withColumn("_ts", F.timestamp_micros("ts_us")).withWatermark("_ts", delay)
        # without the watermarked column, rows behind the watermark reach the processor, which reports them
        .select(*by, *as_text(keys), "ts_us", tie.alias("tie"), kind.alias("kind"), held.alias("value"))
    )
    out = StructType.fromDDL(", ".join([*(f"key_{k} string" for k in keys), outputs, "reason string"]))
    columns = [f.name for f in out][len(keys) : -1]
    processor = InOrder(step, schema, value, value_type, [f"key_{k}" for k in keys], columns, selected, idle_ms, bucket_us)
    return typed(marked.groupBy(*by).transformWithStateInPandas(processor, out, "Append", "EventTime"), rows, keys)


def ordered_rates(
    samples: DataFrame, delay: str, zero_is_unknown: bool = True, selected: bool = True, idle_ms: int | None = None,
    bucket_us: int = BUCKET_US, groups: int | None = None,
) -> DataFrame:
    """Rates of a stream of (device, iface, ts_us, tie, counter and, if there are control rows, kind), in event-time order.

    Rows with a ``reason`` are not rates but samples that came when later ones had been passed (``late``) or a second time
    (``repeated``). ``selected``: whether keys count before any control row names them. ``groups``: keys are dealt to so
    many groups that share state calls, which tables of many keys need (see ``state.GROUPS``); without it each key has
    calls of its own, and the state can be read by key.
    """
    return _in_order(
        samples, partial(rate_step, zero_is_unknown=zero_is_unknown), RATE_STATE, "counter", "bigint", ("device", "iface"),
        RATE_OUTPUT, delay, selected, idle_ms, bucket_us, groups,
    )


def ordered_changes(
    samples: DataFrame, delay: str, bucket_us: int = BUCKET_US, idle_ms: int | None = None, groups: int | None = None
) -> DataFrame:
    """Transitions of a stream of (device, ts_us, tie, state), in event-time order; rows with a reason as in rates."""
    return _in_order(
        samples, change_step, CHANGE_STATE, "state", "string", ("device",),
        CHANGE_OUTPUT, delay, True, idle_ms, bucket_us, groups,
    )


def ordered_pauses(
    polls: DataFrame, delay: str, after: int = PAUSE_AFTER, bucket_us: int = BUCKET_US, idle_ms: int | None = None,
    groups: int | None = None,
) -> DataFrame:
    """Pause alerts of a stream of (device, ts_us, tie, failed), in event-time order; rows with a reason as in rates."""
    return _in_order(
        polls, partial(pause_step, after=after), PAUSE_STATE, "failed", "boolean", ("device",),
        PAUSE_OUTPUT, delay, True, idle_ms, bucket_us, groups,
    )


def to_folders(path: str, side: str):
    """Writer of a micro-batch: results and rows with a reason to a folder each, replaced if the batch is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            batch.filter("reason is not null").write.mode("overwrite").parquet(f"{side}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write
