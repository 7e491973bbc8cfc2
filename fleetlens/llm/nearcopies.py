"""Near copies by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of its five-word shingles. A shingle weighs the more the oftener it stands in the text (up to
1.1 times) and the fewer texts have it (up to 1.25 times, from 1 % of them down), so neither a passage that one copy
repeats nor the edits of a large family outweigh what two texts share, and weighted similarity stays close to that of
the plain sets. Shares of texts come from a count sketch over all texts; its size is fixed, its noise is a fixed share of
the texts at every size of the input, and it is what reaches every executor. Consistent weighted sampling draws
``SAMPLES`` shingles of each text such that two texts draw the same one with a chance of their weighted Jaccard
similarity, and ``ROWS`` draws make a band. Texts that share a band are candidates, and each pair of candidates is
verified on whole texts, by the Jaccard similarity weighted or of the plain sets, whichever is larger, or is
linked through others:

1. each text with one other, the smallest of all its buckets: a row for each text, however large its group;
2. in buckets that still hold more than one component, every pair across components, block against block: a block
   verifies the pairs of a text whose samples agree most first and goes on until each pair is verified or its texts are
   linked through others. So a text that is no copy of the smallest one is still found through any other. Only pairs
   whose sizes alone rule out the similarity are passed over.

Linked texts form classes. Equal texts are one node throughout, so a text with millions of copies is sampled by each
task that reads it, and from then on is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import words
from fleetlens.llm.columns import text_of, unpacked, whole_row
from fleetlens.llm.graph import components
from fleetlens.llm.shared import ids_side, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
#: How far the rarest shingles stand above the commonest, from what share of the texts on they count as rare, and how far
#: a shingle that a text repeats without end stands above one that it has once.
DAMPED, RARE, REPEATED = 0.25, 0.01, 0.1
#: Cells of each of the two rows of the sketch, in as many parts.
CELLS, PARTS = 1 << 18, 64
#: Texts of a bucket that are compared with as many others at a time, and bytes of them.
BLOCK, BLOCK_BYTES = 1500, 8 << 20
#: Partners of a text that are verified at first; four times as many in each further step, until none is left.
FIRST = 4


def weighted(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, stop, hashes, counts, ends): the distinct shingles of texts first .. stop - 1, sorted within each text."""
    for first, stop, h, ends in words.shingles(texts, SHINGLE):
        n = np.diff(ends, prepend=0)
        text = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        yield first, stop, h[at], np.diff(at, append=len(h)), np.cumsum(np.bincount(text[at], minlength=len(n)))


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(CELLS - 1)).astype("int64"), ((h >> np.uint64(40)) & np.uint64(CELLS - 1)).astype("int64")


class Frequencies:
    """Damped inverse document frequencies from the sketch of a corpus of ``texts`` texts."""

    def __init__(self, sketch: np.ndarray, texts: int):
        # less what other shingles add to a cell on the mean
        share = (sketch - sketch.sum(1, keepdims=True) / CELLS) / max(1, texts)
        self.share = share.clip(RARE, 1).astype("float32")

    def idf(self, h: np.ndarray) -> np.ndarray:
        a, b = _cells(h)
        return 1 + DAMPED * np.log(np.minimum(self.share[0, a], self.share[1, b])) / np.log(RARE)

    def weights(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + REPEATED * (1 - 1 / counts)) * self.idf(h)


def frequencies(texts: DataFrame) -> Frequencies:
    """Sketch of the document frequencies over all rows of column text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = np.zeros((2, CELLS), "int64"), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, h, _, _ in weighted(batch["text"].to_pylist()):
                for row, cells in zip(sketch, _cells(h)):
                    row += np.bincount(cells, minlength=CELLS)
        if n:
            yield _parts(sketch.reshape(PARTS, -1), n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = {}, {}
        for batch in batches:
            for part, cells, n in zip(batch["part"].to_pylist(), batch["cells"].to_pylist(), batch["n"].to_pylist()):
                found = np.frombuffer(cells, "int64")
                total[part] = total[part] + found if part in total else found
                rows[part] = rows.get(part, 0) + n
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), "int32"), pa.array([x.tobytes() for x in total.values()], "binary"), pa.array(list(rows.values()), "int64")],
                ["part", "cells", "n"],
            )

    kind = "part int, cells binary, n long"
    rows = texts.select(text_of(texts).alias("text")).mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).collect()
    sketch, n = np.zeros((PARTS, 2 * CELLS // PARTS), "int64"), 0
    for row in rows:  # one row for each part
        sketch[row["part"]] = np.frombuffer(row["cells"], "int64")
        n = row["n"]
    return Frequencies(sketch.reshape(2, CELLS), n)


def _parts(cells: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(PARTS), "int32"), pa.array([c.tobytes() for c in cells], "binary"), pa.array([n] * PARTS, "int64")],
        ["part", "cells", "n"],
    )


def _gamma_table() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, for 65,536 equal steps."""
    u, low, high = (np.arange(65536) + 0.5) / 65536, np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


GAMMA = _gamma_table().astype("float32")
INVERSE_GAMMA, LOG_GAMMA = 1 / GAMMA, np.log(GAMMA)
STEPS = [(int(x) | 1) for x in words.mixed(np.arange(1, SAMPLES + 1, dtype="uint64"))]


def sampled(h: np.ndarray, log_weight: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SAMPLES draws of each text, one row for each; texts without shingles have rows of zeros."""
    n = np.diff(ends, prepend=0)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), SAMPLES), "uint32")
    if not len(some):
        return out
    starts = (ends - n)[some]
    for k, step in enumerate(STEPS):
        x = h * np.uint64(step)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        first = (x >> np.uint64(48)).astype("int32")
        beta = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype("float32") * np.float32(1 / 65536)
        t = np.floor(log_weight * INVERSE_GAMMA[first] + beta)
        rank = LOG_GAMMA[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype("int32")] - GAMMA[first] * (t - beta + 1)
        bits = rank.astype("float32").view("uint32")
        ordered = bits ^ np.where(bits >> 31, np.uint32(0xFFFFFFFF), np.uint32(0x80000000))
        drawn = (h >> np.uint64(7)).astype("uint32") ^ (t.astype("int32").view("uint32") * np.uint32(0x9E3779B1))
        low = np.minimum.reduceat(ordered.astype("uint64") << np.uint64(32) | drawn, starts)
        out[some, k] = (low & np.uint64(0xFFFFFFFF)).astype("uint32")
    return out


def samples(rows: DataFrame, known: Frequencies) -> DataFrame:
    """id, hash, key and samples, an array of int (null without words), of rows with id, hash, key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn, empty = [], []
            for _, _, h, counts, ends in weighted(batch["text"].to_pylist()):
                drawn.append(sampled(h, np.log(known.weights(h, counts)).astype("float32"), ends))
                empty.append(np.diff(ends, prepend=0) == 0)
            values = np.concatenate(drawn).view("int32") if drawn else np.zeros((0, SAMPLES), "int32")
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(values) + 1) * SAMPLES, "int32"), pa.array(values.ravel()),
                mask=pa.array(np.concatenate(empty)) if drawn else None,
            )
            columns = [batch["id"], batch["hash"], batch["key"], lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "key", "samples"])

    return rows.select("id", "hash", "key", "text").mapInArrow(run, "id long, hash long, key string, samples array<int>")


def similarity(a: str, b: str, known: Frequencies) -> float:
    """Jaccard similarity of two whole texts, weighted or plain, whichever is larger; 0 if either has no words."""
    (_, _, h, n, _), (_, _, g, m, _) = (next(weighted([t])) for t in (a, b))
    if not len(h) or not len(g):
        return 0.0
    v, w = known.weights(h, n), known.weights(g, m)
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    both = np.minimum(v[i], w[j]).sum()
    plain = len(i) / (len(h) + len(g) - len(i))
    return max(plain, float(both / (v.sum() + w.sum() - both)))


def verified(pairs: DataFrame, texts: DataFrame, known: Frequencies, similar: float) -> DataFrame:
    """The pairs u, v of node ids whose texts (columns node, text) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(a, b, known) >= similar for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(good, "bool"))

    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _near(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a group's two blocks, how many samples of each pair across them agree, and which pairs are to be met: of
    components that are apart, without an earlier band in common (there they are met as well), each pair once."""
    drawn = np.stack(group["samples"].to_numpy())
    _, root = np.unique(group["root"].to_numpy(), return_inverse=True)
    block, band = group["block"].to_numpy(), int(group["band"].iloc[0])
    low, high = divmod(int(group["task"].iloc[0]), int(group["blocks"].iloc[0]))
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    same, apart = np.zeros((len(a), len(b)), "uint8"), root[a][:, None] != root[b][None, :]
    for i in range(BANDS):
        shared = np.ones((len(a), len(b)), bool)
        for k in range(i * ROWS, (i + 1) * ROWS):
            alike = drawn[a, k][:, None] == drawn[b, k][None, :]
            same += alike
            shared &= alike
        if i < band:
            apart &= ~shared
    if low == high:
        apart &= a[:, None] < b[None, :]
    return a, b, same, apart


def _asking(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of a group that are in any pair, without their samples."""
    a, b, _, apart = _near(group)
    return group.iloc[np.union1d(a[apart.any(1)], b[apart.any(0)])].drop(columns="samples")


def _links(group: pd.DataFrame, known: Frequencies, similar: float) -> pd.DataFrame:
    """Verified pairs of a group, as many as link all of its texts that similar pairs link: each pair is either
    verified or left out because others link its texts already."""
    a, b, same, apart = _near(group)
    node = group["node"].to_numpy()
    _, part = np.unique(group["root"].to_numpy(), return_inverse=True)
    found = [(h, counts, np.diff(ends, prepend=0)) for _, _, h, counts, ends in weighted(group["text"].tolist())]
    h, counts, n = (np.concatenate(x) for x in zip(*found))
    weight = known.weights(h, counts)
    start = np.cumsum(n) - n  # every text has shingles, or it would have no samples
    total = np.add.reduceat(weight, start)
    _, at = np.unique(h, return_inverse=True)
    held, pairs = np.zeros(at.max() + 1), []
    for row in np.flatnonzero(apart.any(1)):
        met = np.flatnonzero(apart[row])
        own, left, step = a[row], b[met[np.argsort(-same[row, met].astype("int"), kind="stable")]], FIRST
        sizes = np.minimum(n[left], n[own]) / np.maximum(n[left], n[own])
        weights = np.minimum(total[left], total[own]) / np.maximum(total[left], total[own])
        left = left[np.maximum(sizes, weights) >= similar]
        mine = slice(start[own], start[own] + n[own])
        held[at[mine]] = weight[mine]
        while len(left := left[part[left] != part[own]]):
            now, left, step = left[:step], left[step:], step * 4
            begin = np.cumsum(n[now]) - n[now]
            of = np.arange(n[now].sum()) + np.repeat(start[now] - begin, n[now])
            other = held[at[of]]
            common = np.add.reduceat((other > 0).astype("int64"), begin)
            both = np.add.reduceat(np.minimum(other, weight[of]), begin)
            best = np.maximum(common / (n[own] + n[now] - common), both / (total[own] + total[now] - both))
            for x in now[best >= similar]:
                if part[x] != part[own]:
                    pairs.append(sorted((node[own], node[x])))
                    part[part == part[x]] = part[own]
        held[at[mine]] = 0
    return pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """id, hash (of the text), class_id and kept, one row for each row of ``docs``.

    A class is a connected component of similar texts; class_id is its smallest doc_id, and the row with it is kept.
    A null text counts as empty. Texts without words are similar to equal texts only, all others by their words. A null
    doc_id is larger than any other; a class without doc_ids is named by a hash of its text, and its rows with that
    text are kept. Rows equal in doc_id and text are one document: they are kept or not together.
    """
    text = text_of(docs)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.md5(text).alias("key"), text.alias("text")
    )
    known = frequencies(rows)
    drawn = written(samples(rows, known), "samples")
    unnamed = F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    nodes = drawn.groupBy("key").agg(
        F.min("id").alias("low"), F.first("hash").alias("hash"), F.first("samples").alias("samples")
    )
    nodes = written(nodes.withColumn("node", F.coalesce("low", unnamed)), "nodes")

    bands = [F.xxhash64(F.lit(i), *[F.col("samples")[i * ROWS + j] for j in range(ROWS)]) for i in range(BANDS)]
    dealt = nodes.filter("samples is not null").select("node", F.posexplode(F.array(*bands)).alias("band", "bucket"))
    sizes = dealt.groupBy("bucket").agg(F.min("node").alias("lowest"), F.count("*").alias("n")).filter("n > 1")
    buckets = written(dealt.join(sizes, "bucket"), "buckets")
    busy = ids_side(buckets.select("node").distinct())
    owners = written(nodes.join(busy, "node", "left_semi").select("node", "low", "hash", "samples"), "owners")
    wanted = owners.select("node", F.col("low").alias("own"), F.col("hash").alias("h"))
    same = (F.col("hash") == F.col("h")) & F.col("id").eqNullSafe(F.col("own"))
    texts = rows.join(ids_side(wanted), same).groupBy("node").agg(F.first("text").alias("text"))
    texts = written(texts, "texts")

    star = buckets.filter("node <> lowest").groupBy(F.col("node").alias("v")).agg(F.min("lowest").alias("u"))
    found = written(verified(star, texts, known, similar), "verified")
    roots = written(components(found), "roots")
    roots = components(found.unionByName(_across(buckets, owners, texts, star, roots, known, similar)))

    members = drawn.join(nodes.select("key", "node", "low"), "key").select("id", "hash", "node", "low")
    named = members.join(roots, "node", "left").withColumn("class_id", F.coalesce("root", "node"))
    kept = (F.col("node") == F.col("class_id")) & F.col("id").eqNullSafe(F.col("low"))
    return named.select("id", "hash", "class_id", kept.alias("kept"))


def _across(
    buckets: DataFrame, owners: DataFrame, texts: DataFrame, star: DataFrame, roots: DataFrame, known: Frequencies,
    similar: float,
) -> DataFrame:
    """Links between components that still share a bucket, as many as it takes; ``star``: pairs that were verified."""
    rooted = buckets.join(roots, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("root"))
    mixed = (
        rooted.groupBy("bucket").agg(
            F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"),
            F.min("node").alias("u"), F.max("node").alias("v"),
        )
        .filter("a <> b")
    )
    mixed = written(mixed, "mixed")
    two = mixed.filter("n = 2").select("u", "v").distinct().join(star, ["u", "v"], "left_anti")
    two = verified(two, texts, known, similar)
    sizes = texts.select("node", F.octet_length("text").alias("size"))
    rooted = written(rooted.join(mixed.filter("n > 2").select("bucket"), "bucket", "left_semi").join(sizes, "node"), "rooted")

    # the largest component of a bucket is not compared with itself: blocks of the others meet all blocks
    parts = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    dealt = parts.groupBy("bucket").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max(F.struct("n", "root", "size")).alias("most"),
        F.sum("n").alias("n"), F.sum("size").alias("size"),
    )

    def blocks(n, size):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")

    dealt = dealt.select(
        "bucket", "main", blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("few"),
        blocks(F.col("most.n"), F.col("most.size")).alias("many"),
    )
    hashed, large = F.xxhash64("node"), F.col("root") == F.col("main")
    block = F.when(large, F.col("few") + F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.col("few"))).cast("int")
    placed = rooted.join(dealt, "bucket").withColumn("blocks", F.col("few") + F.col("many")).withColumn("block", block)
    others = F.sequence(F.lit(0), F.when(large, F.col("few")).otherwise(F.col("blocks")) - 1)
    tasks = placed.withColumn("other", F.explode(others)).select(
        "bucket", "band", "node", "root", "blocks", "block",
        (F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")).alias("task"),
    )
    drawn = owners.select("node", "samples")
    kind = "bucket long, band int, node long, root long, blocks int, block int, task long"
    columns = ["bucket", "band", "node", "root", "blocks", "block", "task"]
    asking = tasks.join(drawn, "node").select(*columns, "samples").groupBy("bucket", "task").applyInPandas(_asking, kind)
    full = written(asking, "asking").join(drawn, "node").join(texts, "node").select(*columns, "samples", "text")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _links(group, known, similar)

    return full.groupBy("bucket", "task").applyInPandas(run, "u long, v long").unionByName(two).distinct()


def dedup(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The kept rows with all their columns, one document of each class."""
    gone = classes(docs, similar).filter("not kept").select(F.col("id").alias("gone_id"), F.col("hash").alias("gone_hash"))
    gone = ids_side(written(gone.distinct(), "gone"))
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.xxhash64(text).alias("hash"), whole_row(docs).alias("row"))
    same = (F.col("hash") == F.col("gone_hash")) & F.col("id").eqNullSafe(F.col("gone_id"))
    return unpacked(rows.join(gone, same, "left_anti"), "row")
