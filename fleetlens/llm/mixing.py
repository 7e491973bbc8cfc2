"""Mixing of sources to target weights by Poisson replication.

The target weight of a source, against the rows it has, gives the mean number of times each of its rows should come.
Every row draws its own count: a number in [0, 1) from a hash of seed and doc_id, put through the inverse of the Poisson
distribution with that mean; a mean above ``LARGEST`` is split into equal ones with draws of their own, whose counts
add up to a Poisson count. The draw needs no state, so a lost task draws the same again, and the expected mix is the
target exactly. Rows are exploded by their count and dealt out by a hash of (seed, doc_id, copy), then ordered by it.

Only DataFrame functions. The rates are a few numbers, one for each source of the given targets, and enter the plan
as literals: no join, so a source with a third of all rows is no hot key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.columns import whole_row

SEED = "mix-1"
#: Share of the mix that each source should have, in parts; REST is the part of all other sources together, null included.
TARGETS = {"src0": 3.0, "src1": 2.0, "src2": 2.0, "src3": 2.0, "src4": 1.0, "src5": 1.0, "src6": 0.5, "src7": 0.5}
REST = 12.0
#: Mean of a single draw, at most: exp(-mean) has to be a normal number.
LARGEST = 500.0
#: Copies of a row that are numbered at a time if any mean is above LARGEST.
RUN = 4096


def uniform(seed: str, doc_id: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of seed and doc_id; a null doc_id counts as empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def terms(rate: float) -> list[float]:
    """Poisson distribution function at 0, 1, 2 .. until it reaches 1 in double precision; rate: up to LARGEST."""
    if not 0 <= rate <= LARGEST:
        raise ValueError(f"a mean of {rate} copies is no rate for mixing")
    p = math.exp(-rate)
    out, total, k = [], 0.0, 0
    while True:
        total += p
        out.append(total)
        k += 1
        if k > rate and total + p * rate / k == total or total >= 1 - 2**-53:
            return out
        p = p * rate / k


def inverse(u: Column, rate: float) -> Column:
    """How many values of the distribution function are not above u: the Poisson count."""
    steps = F.array(*[F.lit(t) for t in terms(rate)])
    return F.size(F.filter(steps, lambda t: t <= u))


def count(seed: str, doc_id: Column, rate: float) -> Column:
    """The Poisson count of a row for any mean; the further draws of a large one have their numbers in the seed."""
    if rate <= LARGEST:
        return inverse(uniform(seed, doc_id), rate)
    draws = math.ceil(rate / LARGEST)
    name = F.coalesce(doc_id.cast("string"), F.lit(""))

    def one(i: Column) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}+"), i.cast("string"), F.lit(":"), name))
        return inverse(F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52)), rate / draws)

    return F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.lit(0), lambda n, i: n + one(i))


def rates(docs: DataFrame, targets: Mapping[str, float], rest: float, times: float) -> dict[str | None, float]:
    """Mean copies by source; None: all others. A source without rows gives up its part to the rest in proportion."""
    name = docs["source"].cast("string")
    group = F.when(name.isin(list(targets)), name)
    counts = {r[0]: r[1] for r in docs.groupBy(group.alias("g")).count().collect()}  # a row for each target at most
    parts = {k: (rest if k is None else targets[k]) for k in counts}
    total, n = sum(parts.values()), sum(counts.values())
    return {k: times * n * parts[k] / total / counts[k] if total else 0.0 for k in counts}


def mix(
    docs: DataFrame, targets: Mapping[str, float] = TARGETS, rest: float = REST, times: float = 1.0, seed: str = SEED,
    with_copy: bool = False,
) -> DataFrame:
    """The mixed and shuffled rows with all columns of ``docs``; ``times``: rows out for each row in, in expectation.

    Rows with the same doc_id draw the same count, so repeated rows are repeated alike. A null source belongs to the
    rest; a null doc_id draws as an empty one. Texts are not looked at. An empty table gives an empty table.
    ``with_copy``: adds ``copy``, from 0; an input column of that name is then replaced.
    """
    mean = rates(docs, targets, rest, times)
    name = docs["source"].cast("string")
    n = count(seed, docs["doc_id"], mean.get(None, 0.0))
    for source in (s for s in targets if s in mean):
        n = F.when(name == source, count(seed, docs["doc_id"], mean[source])).otherwise(n)
    drawn = docs.select(whole_row(docs).alias("row"), n.alias("n")).filter("n > 0")
    if max(mean.values(), default=0.0) > LARGEST:  # in runs, so that no array holds all copies of a row
        # columns by place, not a struct: Spark loses fields of one that passes two generators
        flat = [F.col("row")[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
        run = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(RUN))
        runs = drawn.select(*flat, "n", F.explode(run).alias("run"))
        row = F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
        copies = F.sequence("run", F.least(F.col("run") + (RUN - 1), F.col("n") - 1))
        each = runs.select(row.alias("row"), F.explode(copies).alias("copy"))
    else:
        each = drawn.select("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    place = F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.col("copy"))
    dealt = each.withColumn("place", place).repartition("place").sortWithinPartitions("place")
    if not with_copy:
        return dealt.select("row.*")
    return dealt.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "copy"], "copy")
