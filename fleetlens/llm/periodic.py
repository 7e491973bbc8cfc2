"""Runs: stretches of words that repeat with a period, found as maximal pairs in the LCP-interval tree.

Two places i < j of a text whose suffixes share l words make a maximal pair if the words before them differ (or i is
the first). If their distance p is l at most, the words from i up to j + l repeat with period p and no neighbouring
word goes on with it: this is a run, and nothing has to be extended. Suffixes are sorted by doubling. The tree of LCP
intervals is walked bottom-up; each interval lists its places in order, each of the class of the word on its left. Where
two intervals meet, each place of the smaller one looks for its next neighbours in the other list that are of another
class. Farther places need no look: one between them of depth l would make the period smaller.

A run of ``least`` words has l >= least / 2, so intervals below that depth are not walked, and neither are those
whose left words are all one or no two of whose places are near enough. A text is worked on whole, within one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlens.llm.columns import text_of, whole_row

#: A run has at least so many words.
LEAST = 12
#: Words that are sorted together; a longer text is sorted alone.
CHUNK = 1 << 17
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _sorted_suffixes(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes, and their ranks by 1, 2, 4, .. words until no two are equal.

    A rank is the place of the first suffix of its group in the order, so it stays while others are refined.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    fresh = np.concatenate(([True], ids[order[1:]] != ids[order[:-1]]))
    start = np.flatnonzero(fresh)
    rank = np.empty(n, "int64")
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    levels, step, at = [rank], 1, np.arange(n)
    while True:
        by_place = rank[order[at]]
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = by_place[1:] == by_place[:-1]
        at = at[same[:-1] | same[1:]]
        if not len(at):
            return order, levels
        some = order[at]
        ahead = some + step
        key = rank[some] << 32 | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[at] = some
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        rank = rank.copy()
        rank[some] = np.repeat(at[start], np.diff(np.append(start, len(at))))
        levels.append(rank)
        step *= 2


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` share."""
    n, length = len(levels[0]), np.zeros(len(a), "int64")
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + length, b + length
        same = (i < n) & (j < n) & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        length[same] += 1 << k
    return length


def _meet(a: tuple, b: tuple, depth: int, before: dict[int, int], least: int, found: list) -> tuple:
    """The interval of ``depth`` in which two meet; runs that begin at pairs across them go to ``found``.

    An interval is (set of left words, places): places ascend. The intervals of a long repetition meet from its first
    place on, so that they are appended.
    """
    if len(a[1]) < len(b[1]):
        a, b = b, a
    words, places = a
    if len(words) > 1 or words != b[0]:
        for x in b[1]:
            k = bisect_left(places, x)
            for y in places[max(0, k - 1) : k + 1]:
                apart = abs(x - y)
                if apart <= depth and depth + apart >= least and before[x] != before[y]:
                    found.append((min(x, y), max(x, y) + depth, apart))
    if len(b[1]) * 16 < len(places):
        for x in b[1]:
            if x > places[-1]:
                places.append(x)
            else:
                insort(places, x)
    else:
        places.extend(b[1])
        places.sort()
    words |= b[0]
    return a


def _walk(suffixes: list[int], shared: list[int], before: list[int], least: int, found: list) -> None:
    """Bottom-up walk over the intervals of one group; ``shared``: words in common with the suffix before."""
    held: list[tuple[int, tuple]] = []
    now = ({before[0]}, [suffixes[0]])
    left = dict(zip(suffixes, before))
    for place, depth in zip(suffixes[1:], shared[1:]):
        while held and held[-1][0] > depth:
            at, other = held.pop()
            now = _meet(other, now, at, left, least, found)
        if held and held[-1][0] == depth:
            now = _meet(held.pop()[1], now, depth, left, least, found)
        held.append((depth, now))
        now = ({left[place]}, [place])
    while held:
        at, other = held.pop()
        now = _meet(other, now, at, left, least, found)


def runs(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all runs, by start, then period.

    ``ids``: a number for each word, equal for equal words; texts behind one another, each ended by a number of its own.
    """
    if len(ids) < least:
        return (np.zeros(0, "int64"),) * 3
    order, levels = _sorted_suffixes(ids)
    shared = np.append(0, _common(levels, order[:-1], order[1:]))
    left = np.where(order > 0, ids[order - 1], -1)
    # groups of suffixes with at least half of ``least`` words in common
    begins = shared < -(-least // 2)
    group = np.cumsum(begins) - 1
    edges = np.flatnonzero(begins)
    size = np.diff(np.append(edges, len(order)))
    deepest = np.maximum.reduceat(np.where(begins, 0, shared), edges)
    varied = np.zeros(len(order), bool)
    varied[1:] = (left[1:] != left[:-1]) & ~begins[1:]
    open_ = (size > 1) & np.logical_or.reduceat(varied, edges)
    at = np.flatnonzero(open_[group])
    by = at[np.lexsort((order[at], group[at]))]
    apart = np.where(group[by[1:]] == group[by[:-1]], order[by[1:]] - order[by[:-1]], len(order))
    nearest = np.full(len(edges), len(order))
    np.minimum.at(nearest, group[by[1:]], apart)
    open_ &= nearest <= deepest
    # groups of two are pairs; others are walked
    two = edges[open_ & (size == 2)]
    low, high = np.minimum(order[two], order[two + 1]), np.maximum(order[two], order[two + 1])
    ok = shared[two + 1] + high - low >= least
    found = list(zip(low[ok].tolist(), (high + shared[two + 1])[ok].tolist(), (high - low)[ok].tolist()))
    for g in np.flatnonzero(open_ & (size > 2)):
        part = slice(edges[g], edges[g] + size[g])
        _walk(order[part].tolist(), shared[part].tolist(), left[part].tolist(), least, found)
    if not found:
        return (np.zeros(0, "int64"),) * 3
    start, end, period = np.array(sorted(found)).T
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, and a number of its own after each text; and where texts begin."""
    lengths = np.array([len(w) + 1 for w in words])
    begins = np.cumsum(lengths) - lengths
    ids = np.empty(lengths.sum(), "int64")
    for at, part in zip(begins.tolist(), words):
        seen: dict[bytes, int] = {}
        ids[at : at + len(part)] = np.fromiter(map(seen.setdefault, part, count(at)), "int64", len(part))
        ids[at + len(part)] = at + len(part)
    return ids, begins


def found_in(texts: list[str], least: int = LEAST) -> Iterator[tuple[int, np.ndarray, str]]:
    """For each text its number of words, its runs as rows (start, length, period), and the text with each run's words
    after its first period left out."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(text.encode("utf-8", "surrogatepass").split())
        size += len(held[-1])
        if size < CHUNK and i + 1 < len(texts):
            continue
        ids, begins = _numbered(held)
        start, end, period = runs(ids, least)
        upto = np.searchsorted(start, begins)
        gone = np.zeros(len(ids) + 1, "int64")
        np.add.at(gone, start + period, 1)
        np.add.at(gone, end, -1)
        gone = np.cumsum(gone) > 0
        for at, words, a, b in zip(begins.tolist(), held, upto.tolist(), [*upto[1:].tolist(), len(start)]):
            kept = words
            if b > a:
                kept = [words[k] for k in np.flatnonzero(~gone[at : at + len(words)]).tolist()]
            rows = np.stack([start[a:b] - at, end[a:b] - start[a:b], period[a:b]], 1)
            yield len(words), rows, b" ".join(kept).decode("utf-8", "surrogatepass")
        held, size = [], 0


def _described(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rows, kept = [], [], []
            for words, found, text in found_in(batch["text"].to_pylist(), least):
                n.append(words)
                rows.append(found)
                kept.append(text)
            flat = np.concatenate(rows) if rows else np.zeros((0, 3), "int64")
            ends = np.cumsum([0, *map(len, rows)])
            entries = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(n, "int64"), pa.ListArray.from_arrays(pa.array(ends, "int32"), entries), pa.array(kept, "string")],
                ["row", "n_words", "runs", "collapsed"],
            )

    return run


def describe(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` without ``text``, and: n_words, runs (start, length, period; by start, then period), collapsed.

    Words are what stands between ASCII white space, in ``text`` as a whole. A run is a stretch of consecutive words with
    smallest period q, of ``least`` and 2 q words at least, that no neighbouring word extends with period q.
    ``collapsed``: the words, joined by one space, without those that a run holds after its first q. A null or empty text,
    or one of white space, has 0 words, no runs and an empty ``collapsed``; equal rows give equal results; an empty table
    gives an empty table. Other columns are carried along; of columns with the names above, the results stay.
    """
    others = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("text", "n_words", "runs", "collapsed")])
    rows = docs.select(whole_row(others).alias("row"), text_of(docs).alias("text"))
    kind = others.select(whole_row(others).alias("row")).schema[0].dataType.simpleString()
    done = rows.mapInArrow(
        _described(least), f"row {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
    return done.select("row.*", "n_words", "runs", "collapsed")
