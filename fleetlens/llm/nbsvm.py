"""Quality classifier: naive Bayes support vectors over n-grams of word shapes.

A word is reduced to its shape: which of lower case, upper case, digits, other ASCII signs and characters beyond ASCII
it has, and whether it repeats the word before. A text's features are the indicators of its shape n-grams of one, two
and three words, scaled by the log ratio of the classes' counts and brought to unit length, and a linear model with
hinge loss is fitted to them by dual coordinate descent. The score is a logistic function of the margin, fitted to the
training rows.

The model is fitted on a bounded sample of labelled rows (``rows`` for each class); it has one weight for each n-gram
that occurs there. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import words
from fleetlens.llm.columns import text_of, unpacked, whole_row

#: Labelled rows of each class that the model is fitted on at most.
ROWS = 4000
#: A text is predicted to be good from this score on.
THRESHOLD = 0.3
#: Labels of documents whose CRC32 of doc_id has this remainder are never learned from.
FOLDS, HELD_OUT = 5, 0
SHAPES = 64
REPEAT = 32
#: Numbers of features of one, two and three words.
SIZE = SHAPES + SHAPES**2 + SHAPES**3
#: Added to the counts of an n-gram in a class.
SMOOTHING = 1.0
#: Penalty of the hinge loss, rounds of descent.
COST, ROUNDS = 1.0, 30


def _signs() -> np.ndarray:
    """Byte to what it says of its word; 0 for white space and control characters."""
    table = np.zeros(256, "uint8")
    table[33:] = 8
    for low, high, sign in ((97, 123, 1), (65, 91, 2), (48, 58, 4), (128, 256, 16)):
        table[low:high] = sign
    table[127] = 0
    return table


SIGNS = _signs()


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the sorted numbers of the features it has; none for a text without words."""
    for first, stop, data, ends in words.chunks(texts):
        signs = SIGNS[data]
        a, b = words.spans(signs != 0)
        if not len(a):
            yield from (np.zeros(0, "int64") for _ in range(first, stop))
            continue
        # between words the flags are 0, so a run from one start to the next holds the flags of one word
        shape = np.bitwise_or.reduceat(signs, a).astype("int64")
        word = words.hashes(words.FOLD[data], a, b)
        shape[1:] |= np.where(word[1:] == word[:-1], REPEAT, 0)
        upto = np.searchsorted(a, ends)
        start = np.concatenate(([0], upto[:-1]))
        shape[start[start < len(shape)]] &= REPEAT - 1
        for i, j in zip(start, upto):
            s = shape[i:j]
            two = s[:-1] * SHAPES + s[1:]
            yield np.unique(np.concatenate((s, SHAPES + two, SHAPES + SHAPES**2 + two[:-1] * SHAPES + s[2:])))


@dataclass(frozen=True)
class Model:
    """weight: of each feature, the class log ratio included; ratio: that alone; scale, shift: of the logistic function."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    scale: float
    shift: float

    def margin(self, on: np.ndarray) -> float:
        norm = math.sqrt(float(np.square(self.ratio[on]).sum()))
        return float(self.weight[on].sum()) / norm + self.bias if norm else self.bias

    def score(self, on: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.scale * self.margin(on) + self.shift))))


def fit(rows: list[tuple[np.ndarray, int]]) -> Model:
    """The model of (features, label) rows; with one class only, a constant."""
    y = np.array([1.0 if label else -1.0 for _, label in rows])
    if not len(rows) or abs(y.sum()) == len(y):
        constant = 0.0 if not len(rows) else 10.0 * y[0]
        return Model(np.zeros(SIZE), np.zeros(SIZE), constant, 1.0, 0.0)
    p, q = np.full(SIZE, SMOOTHING), np.full(SIZE, SMOOTHING)
    for on, label in rows:
        (p if label else q)[on] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p + q) == 2 * SMOOTHING] = 0.0
    data = []
    for on, _ in rows:
        value = ratio[on]
        norm = math.sqrt(float(np.square(value).sum()))
        data.append((on, value / norm if norm else value))
    # both classes weigh the same in total
    cost = COST * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in order.permutation(len(y)):
            on, value = data[i]
            slope = y[i] * (float(w[on] @ value) + bias) - 1
            new = min(max(alpha[i] - slope / (float(value @ value) + 1.0), 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[on] += step * value
                bias += step
                moved = max(moved, abs(step))
            alpha[i] = new
        if moved < 1e-3:
            break
    margin = np.array([float(w[on] @ value) + bias for on, value in data])
    scale, shift = _logistic(margin, y > 0)
    return Model(w * ratio, ratio, bias, scale, shift)


def _logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Scale and shift by Newton steps on smoothed targets, both classes weighing the same."""
    n, m = good.sum(), (~good).sum()
    target = np.where(good, (n + 1) / (n + 2), 1 / (m + 2))
    weight = np.where(good, 0.5 / n, 0.5 / m)
    scale, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * margin + shift, -40, 40)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        a, b, c = (h * margin * margin).sum() + 1e-6, (h * margin).sum(), h.sum()
        da, db = (g * margin).sum(), g.sum()
        det = a * c - b * b
        if det <= 0:
            break
        scale, shift = scale - (c * da - b * db) / det, shift - (a * db - b * da) / det
    return float(scale), float(shift)


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> list[tuple[np.ndarray, int]]:
    """Features and labels of the rows to learn from.

    Documents that are labelled, by a label that is not null, and not held out; of each class the ``rows`` with the
    smallest hash of their doc_id, so the sample is the same wherever it is drawn. A document with both labels counts
    as bad. Only ids, then features of the chosen rows, reach the driver: 2 * ``rows`` at most.
    """
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
        .filter("doc_id is not null and quality is not null")
        .filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD_OUT)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    chosen = {}
    for label in (0, 1):
        ids = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen |= {r["doc_id"]: label for r in ids.select("doc_id").collect()}
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame(list(chosen.items()), "id long, quality int")
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [f.astype("int32") for f in features(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["quality"], pa.array(on, pa.list_(pa.int32()))], ["id", "quality", "on"]
            )

    found = texts.join(F.broadcast(picked), "id").select("id", "quality", "text").mapInArrow(run, "id long, quality int, on array<int>")
    got = found.toArrow()
    order = np.lexsort((got["quality"].to_numpy(), got["id"].to_numpy()))
    on = got["on"].combine_chunks()
    return [(on[int(i)].values.to_numpy().astype("int64"), int(got["quality"][int(i)].as_py())) for i in order]


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    return fit(sample(docs, labels, rows))


def scorer(model: Model):
    """A vectorised function from texts to scores."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(on) for on in features(texts.tolist())])

    return score


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``, other columns left out.

    A null text counts as empty; texts without words all have the same score. A null doc_id is not held out.
    """
    held = F.pmod(F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT
    scored = docs.select(
        docs["doc_id"].alias("doc_id"), (held & docs["doc_id"].isNotNull()).alias("held_out"), scorer(model)(text_of(docs)).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows predicted to be good, with all their columns."""
    scored = docs.select(whole_row(docs).alias("row"), scorer(model)(text_of(docs)).alias("score"))
    return unpacked(scored.filter(F.col("score") >= THRESHOLD), "row")
