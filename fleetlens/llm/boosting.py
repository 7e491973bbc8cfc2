"""Gradient boosting over a table of distinct feature combinations, compiled into a column expression.

All features are categories of a few values, so a corpus of any size comes down to a table with one row for each
combination that occurs, with its counts: Spark makes that table from all rows, and the trees are fitted to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, RATE, DEPTH = 40, 0.3, 3
#: Added to the curvature of a leaf.
RIDGE = 1.0


@dataclass(frozen=True)
class Cell:
    """A combination of feature values, the rows that have it and how many of them are positive."""

    values: dict[str, int]
    rows: int
    positive: int


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """``name`` up to ``most`` goes to ``low``, above to ``high``."""

    name: str
    most: int
    low: Leaf | Split
    high: Leaf | Split


def _grown(cells: list[Cell], slope: list[float], curve: list[float], depth: int) -> Leaf | Split:
    g, h = sum(slope), sum(curve)
    best, gain = None, 1e-6
    if depth:
        for name in cells[0].values:
            sums: dict[int, list[float]] = {}
            for c, a, b in zip(cells, slope, curve):
                total = sums.setdefault(c.values[name], [0.0, 0.0])
                total[0] += a
                total[1] += b
            left = [0.0, 0.0]
            for value in sorted(sums)[:-1]:
                left = [left[0] + sums[value][0], left[1] + sums[value][1]]
                better = sum(a * a / (b + RIDGE) for a, b in (left, (g - left[0], h - left[1]))) - g * g / (h + RIDGE)
                if better > gain:
                    best, gain = (name, value), better
    if best is None:
        return Leaf(-RATE * g / (h + RIDGE))
    name, most = best
    parts = []
    for low in (True, False):
        rows = [i for i, c in enumerate(cells) if (c.values[name] <= most) == low]
        parts.append(_grown([cells[i] for i in rows], [slope[i] for i in rows], [curve[i] for i in rows], depth - 1))
    return Split(name, most, *parts)


def _value(tree: Leaf | Split, values: dict[str, int]) -> float:
    while isinstance(tree, Split):
        tree = tree.low if values[tree.name] <= tree.most else tree.high
    return tree.value


@dataclass(frozen=True)
class Boosted:
    trees: tuple[Leaf | Split, ...]

    def margin(self, values: dict[str, int]) -> float:
        return sum(_value(t, values) for t in self.trees)

    def column(self) -> Column:
        """The margin from columns with the features' names."""

        def of(tree: Leaf | Split) -> Column:
            if isinstance(tree, Leaf):
                return F.lit(tree.value)
            return F.when(F.col(tree.name) <= tree.most, of(tree.low)).otherwise(of(tree.high))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + of(tree)
        return total


def fit(cells: list[Cell], rounds: int = ROUNDS, depth: int = DEPTH) -> Boosted:
    """Logistic boosting; counts enter by their logarithm, so that common combinations do not drown the others."""
    if not cells:
        return Boosted(())
    weight = [math.log2(1 + c.rows) for c in cells]
    share = [c.positive / c.rows for c in cells]
    margin, trees = [0.0] * len(cells), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        slope = [w * (a - b) for w, a, b in zip(weight, p, share)]
        curve = [w * a * (1 - a) for w, a in zip(weight, p)]
        tree = _grown(cells, slope, curve, depth)
        trees.append(tree)
        margin = [m + _value(tree, c.values) for m, c in zip(margin, cells)]
    return Boosted(tuple(trees))


def threshold(model: Boosted, cells: list[Cell], precise: float) -> float:
    """Smallest margin above which at least a share ``precise`` of the rows, taken from the top, is positive."""
    scored = sorted(((model.margin(c.values), c) for c in cells), key=lambda x: -x[0])
    rows = positive = 0
    least = math.inf
    for i, (margin, c) in enumerate(scored):
        rows, positive = rows + c.rows, positive + c.positive
        last = i + 1 == len(scored) or scored[i + 1][0] < margin
        if last and positive >= precise * rows:
            least = margin
    return least
