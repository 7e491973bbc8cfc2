"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

A node of a tree cuts its vectors by the hyperplane halfway between two of them, at the median. A query goes down all
trees through one priority queue: the branch it leaves waits there with its margin, the smallest on the way, and the
branch with the largest margin comes next, whichever tree it belongs to, until the query has seen its number of leaves.
What those leaves hold is ranked by the exact product in double precision.

Inner products become distances by one more coordinate, which brings all vectors to the same length. The trees are fitted
to ``SAMPLE`` rows with the smallest hashes of their ids; every row is indexed. Of ``BOUND``
such rows, a query ranks those in its own leaves first: what falls behind its best of them can be in no answer and is
left out where a leaf is ranked. How many leaves a query sees follows
from ``RECALL``: a bounded set of queries is answered exactly over all rows, and the leaves are as many as their true
neighbours ask for. Vectors without structure need many leaves, whatever the trees; more of the sample and smaller
leaves pay off where there is some.

Equal vectors are one, with its smallest ids: copies beyond the length of an answer can appear in none. Leaves and their
queries meet in blocks of bounded size, however many rows a leaf has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import written

TOP, EVERY = 20, 20
SAMPLE, TREES, LEAF = 8192, 4, 64
RECALL, CALIBRATION = 0.96, 64
#: Rows of which those in a query's leaves give it a first bound.
BOUND = 32768
#: What two sums of the same products may differ by.
ROUNDING = 1e-9
#: Vectors, and queries, of a leaf that meet at a time.
ROW_BLOCK, QUERY_BLOCK = 4096, 2048


class Tree:
    """Nodes as arrays: direction, offset, and children; a child below 0 is leaf -1 - child."""

    def __init__(self, points: np.ndarray, random: np.random.Generator, leaf: int):
        self.direction, self.offset, self.children, self.leaves = [], [], [], 0
        self.root = self._grow(points, np.arange(len(points)), random, leaf)

    def _grow(self, points: np.ndarray, own: np.ndarray, random: np.random.Generator, leaf: int) -> int:
        if len(own) > leaf:
            for _ in range(3):
                a, b = points[random.choice(own, 2, replace=False)]
                way = a - b
                if (length := np.sqrt(way @ way)) > 0:
                    way = way / length
                    at = points[own] @ way
                    middle = float(np.median(at))
                    if 0 < (low := at <= middle).sum() < len(own):
                        node = len(self.children)
                        self.direction.append(way)
                        self.offset.append(middle)
                        self.children.append(())
                        self.children[node] = tuple(self._grow(points, part, random, leaf) for part in (own[low], own[~low]))
                        return node
        self.leaves += 1
        return -self.leaves

    def margins(self, points: np.ndarray) -> np.ndarray:
        if not self.children:
            return np.zeros((len(points), 0))
        return points @ np.array(self.direction).T - np.array(self.offset)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        margins, at = self.margins(points), np.full(len(points), self.root)
        if not self.children:
            return np.zeros(len(points), "int64")
        children = np.array(self.children)
        while (inner := np.flatnonzero(at >= 0)).size:
            at[inner] = children[at[inner], (margins[inner, at[inner]] > 0).astype("int64")]
        return -1 - at


class Forest:
    def __init__(self, points: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5):
        random = np.random.default_rng(seed)
        self.trees = [Tree(points, random, leaf) for _ in range(trees)]
        self.first = np.cumsum([0] + [t.leaves for t in self.trees])

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree, numbered through."""
        return np.stack([t.leaf_of(points) + first for t, first in zip(self.trees, self.first)], axis=1)

    def visited(self, points: np.ndarray, leaves: int) -> Iterator[list[int]]:
        """For each point the leaves that the shared queue comes to, in its order."""
        margins = [t.margins(points) for t in self.trees]
        for i in range(len(points)):
            queue = [(-np.inf, j, t.root) for j, t in enumerate(self.trees)]
            found: list[int] = []
            while queue and len(found) < leaves:
                waiting, j, node = heapq.heappop(queue)
                if node < 0:
                    found.append(int(self.first[j]) - 1 - node)
                    continue
                margin = float(margins[j][i, node])
                low, high = self.trees[j].children[node]
                heapq.heappush(queue, (max(waiting, margin), j, low))
                heapq.heappush(queue, (max(waiting, -margin), j, high))
            yield found


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)


def _lifted(points: np.ndarray, longest: float) -> np.ndarray:
    """With a coordinate that brings every row to length ``longest``."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - np.square(points).sum(1)))
    return np.concatenate((points, rest[:, None]), axis=1)


def _flat(points: np.ndarray) -> np.ndarray:
    """Queries have no part in that coordinate."""
    return np.concatenate((points, np.zeros((len(points), 1))), axis=1)


def valid(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, one of them not 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """vec, node (its smallest id) and ids, the ``top`` + 1 smallest, of rows with id and vec.

    Ids are cut down within parts of a group first, so that a vector with very many copies meets as a few rows.
    """
    key = F.xxhash64("vec")
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    few = rows.select("id", "vec", key.alias("key"), part.alias("part")).selectExpr(
        "*", "row_number() over (partition by key, vec, part order by id) as nth"
    ).filter(F.col("nth") <= top + 1)
    ranked = few.drop("part", "nth").selectExpr("*", "row_number() over (partition by key, vec order by id) as nth")
    return (
        ranked.filter(F.col("nth") <= top + 1).groupBy("key", "vec")
        .agg(F.sort_array(F.collect_list("id")).alias("ids")).select("vec", F.col("ids")[0].alias("node"), "ids")
    )


def _best(scores: np.ndarray, nodes: np.ndarray, top: int) -> np.ndarray:
    """For each row of scores the places of its ``top`` largest, and of all that are as large as the last of them."""
    if scores.shape[1] <= top:
        return np.ones(scores.shape, bool)
    last = -np.partition(-scores, top - 1, axis=1)[:, top - 1 : top]
    return scores >= last


def _calibrated(index: DataFrame, queries: DataFrame, forest: Forest, longest: float, width: int, top: int) -> int:
    """Leaves that a query sees, so that the calibration queries find RECALL of their true neighbours."""
    some = queries.orderBy(F.xxhash64("node"), "node").limit(CALIBRATION).select("node", "vec").toArrow()
    if not some.num_rows:
        return 1
    asked, own = _matrix(some["vec"], width), some["node"].to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, float, bytes]] = []
        for batch in batches:
            points, nodes = _matrix(batch["vec"], width), batch["node"].to_numpy()
            scores = asked @ points.T
            scores[own[:, None] == nodes[None, :]] = -np.inf
            for q, at in zip(*np.nonzero(_best(scores, nodes, top))):
                held.append((int(q), float(scores[q, at]), points[at].tobytes()))
            held.sort(key=lambda h: (h[0], -h[1]))
            counts: dict[int, int] = {}
            kept = []
            for h in held:
                counts[h[0]] = counts.get(h[0], 0) + 1
                if counts[h[0]] <= top:
                    kept.append(h)
            held = kept
        yield pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], "int32"), pa.array([h[1] for h in held], "float64"), pa.array([h[2] for h in held], "binary")],
            ["q", "score", "point"],
        )

    near = index.select("node", "vec").mapInArrow(scan, "q int, score double, point binary")
    best = near.selectExpr("*", "row_number() over (partition by q order by score desc) as nth").filter(F.col("nth") <= top)
    rows = [r for r in best.select("q", "score", "point").collect() if r["score"] > -np.inf]  # CALIBRATION * top at most
    if not rows:
        return 1
    cells = forest.cells(_lifted(np.stack([np.frombuffer(r["point"]) for r in rows]), longest))
    order = [{leaf: i for i, leaf in enumerate(found)} for found in forest.visited(_flat(asked), int(forest.first[-1]))]
    needed = np.sort([min(order[r["q"]][c] for c in own) for r, own in zip(rows, cells.tolist())])
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1


def search(
    vectors: DataFrame, top: int = TOP, every: int = EVERY, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF
) -> DataFrame:
    """query_id, rank, vec_id and score: for each vec_id divisible by ``every`` its ``top`` nearest other rows.

    Nearest first by inner product in double precision, ties to the smaller vec_id; all candidates, if there are fewer.
    Rows with a null vec_id, or whose vector is null, empty, zero, or holds null or non-finite components, take no
    part; nor do those of another length than most. Rows equal in vec_id and vector are one, and rows that share a
    vec_id with different vectors are candidates, and queries, each. Other columns are left out.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(vectors["vec_id"].cast("long").alias("id"), vectors["embedding"].cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & valid(F.col("vec")))
    widths = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return vectors.sparkSession.createDataFrame([], schema)
    width = widths[0]["w"]
    rows = rows.filter(F.size("vec") == width).distinct()
    index = written(distinct_vectors(rows, top), "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    longest = float(np.sqrt(index.agg(F.max(norm)).first()[0])) * (1 + 1e-9)
    drawn = index.orderBy(F.xxhash64("node"), "node").limit(max(sample, BOUND)).select("vec").toArrow()
    bound = _matrix(drawn["vec"], width)[:BOUND]
    forest = Forest(_lifted(_matrix(drawn["vec"], width)[:sample], longest), trees, leaf)
    bound_cells = forest.cells(_lifted(bound, longest))
    asked = rows.filter(F.col("id") % every == 0).groupBy("vec").agg(F.collect_set("id").alias("askers"), F.min("id").alias("node"))
    asked = written(asked, "queries")
    leaves = _calibrated(index, asked, forest, longest, width, top)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = forest.cells(_lifted(_matrix(batch["vec"], width), longest))
            repeated = np.repeat(np.arange(batch.num_rows), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ravel(), "int64"), batch["node"].take(pa.array(repeated)), batch["vec"].take(pa.array(repeated))],
                ["cell", "node", "vec"],
            )

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                points = _matrix(part["vec"], width)
                scores, found = points @ bound.T, list(forest.visited(_flat(points), leaves))
                least = np.full(len(points), -np.inf)
                for i, own in enumerate(found):
                    seen = np.zeros(int(forest.first[-1]), bool)
                    seen[own] = True
                    # these rows are met again in the leaves; one more than an answer, as the query may be among them
                    met = scores[i][seen[bound_cells].any(1)]
                    if len(met) > top:
                        least[i] = -np.partition(-met, top)[top] - ROUNDING * longest * np.linalg.norm(points[i])
                repeated = pa.array(np.repeat(np.arange(len(points)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(found), "int64"), part["node"].take(repeated),
                        pa.array(least).take(repeated), part["vec"].take(repeated),
                    ],
                    ["cell", "query", "least", "point"],
                )

    held = index.mapInArrow(placed, "cell long, node long, vec array<double>")
    sent = asked.mapInArrow(routed, "cell long, query long, least double, point array<double>")
    sizes = held.groupBy("cell").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("row_blocks")).join(
        sent.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks")), "cell"
    )
    sizes = F.broadcast(written(sizes, "leaves"))  # a row for each leaf of the forest at most
    own_row = F.pmod(F.xxhash64("node"), F.col("row_blocks")).cast("int")
    own_query = F.pmod(F.xxhash64("query"), F.col("query_blocks")).cast("int")
    left = held.join(sizes, "cell").select(
        "cell", own_row.alias("row_block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "node", "vec"
    )
    right = sent.join(sizes, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"), own_query.alias("query_block"),
        "query", "least", "point",
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "node": [], "score": []}).astype({"query": "int64", "node": "int64", "score": "float64"})
        nodes, queries = a["node"].to_numpy(), b["query"].to_numpy()
        scores = np.stack(b["point"].to_numpy()) @ np.stack(a["vec"].to_numpy()).T
        good = (scores >= b["least"].to_numpy()[:, None]) & _best(scores, nodes, top + 1)
        q, n = np.nonzero(good)
        return pd.DataFrame({"query": queries[q], "node": nodes[n], "score": scores[q, n]})

    keys = ("cell", "row_block", "query_block")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query long, node long, score double")
    near = near.groupBy("query", "node").agg(F.max("score").alias("score"))
    # each candidate vector stands for at most top + 1 ids, each query vector for the ids that ask with it
    found = near.selectExpr("*", "row_number() over (partition by query order by score desc, node) as nth")
    found = found.filter(F.col("nth") <= top + 1).join(index.select("node", "ids"), "node")
    found = found.select("query", "score", F.explode("ids").alias("vec_id"))
    found = found.selectExpr("*", "row_number() over (partition by query order by score desc, vec_id) as nth")
    found = found.filter(F.col("nth") <= top + 1)
    each = found.join(asked.select(F.col("node").alias("query"), F.explode("askers").alias("query_id")), "query")
    each = each.filter("vec_id <> query_id").selectExpr(
        "query_id", "cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank", "vec_id", "score"
    )
    return each.filter(F.col("rank") <= top)
