import math
from collections import Counter

from pyspark.sql import functions as F

from fleetlens.llm import mixing


def test_inverse_is_poisson(spark):
    rate = 1.7
    u = spark.range(20000).selectExpr("(id + 0.5) / 20000 as u")
    counts = {r["k"]: r["count"] / 20000 for r in u.select(mixing.inverse(u["u"], rate).alias("k")).groupBy("k").count().collect()}
    for k in range(6):
        assert abs(counts[k] - math.exp(-rate) * rate**k / math.factorial(k)) < 1e-3
    assert mixing.terms(0.0) == [1.0] and mixing.terms(400.0)[-1] >= 1 - 1e-9


def test_mix_meets_targets(documents):
    rows = [(i, "t", "hot" if i % 3 else "rare" if i % 30 == 0 else None) for i in range(6000)]
    df = documents(rows)
    got = mixing.mix(df, {"hot": 1.0, "rare": 1.0}, rest=2.0)
    assert got.columns == df.columns
    by = Counter(r["source"] for r in got.collect())
    for name, want in (("hot", 1500), ("rare", 1500), (None, 3000)):
        assert abs(by[name] - want) < 0.15 * want
    again = mixing.mix(df.repartition(7), {"hot": 1.0, "rare": 1.0}, rest=2.0)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in again.collect())


def test_copies_are_shuffled_and_numbered(documents):
    got = mixing.mix(documents([(i, "t") for i in range(300)]), {"src0": 1.0}, times=4.0, with_copy=True).collect()
    seen = {}
    for r in got:
        seen.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in seen.values())
    ids = [r["doc_id"] for r in got]
    assert sum(abs(a - b) == 1 for a, b in zip(ids, ids[1:])) < 30


def test_awkward_rows(awkward):
    got = mixing.mix(awkward, {"src0": 1.0}, rest=1.0)
    assert got.columns == awkward.columns
    by = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert by[4, "the same text again"] % 2 == 0 and by[None, "without a number"] % 2 == 0
    assert mixing.mix(awkward.limit(0)).count() == 0
    assert mixing.mix(awkward, {}, rest=0.0).count() == 0


def test_a_scarce_source_has_a_large_mean(documents):
    """10,000 rows of one source and 3 without any: a mean of 2,500 copies or so for each of the three."""
    rows = [(i, "t", "hot" if i < 10000 else None) for i in range(10003)]
    got = mixing.mix(documents(rows), {"hot": 1.0}, rest=3.0, with_copy=True).filter("source is null").collect()
    mean = 10003 * 3 / 4 / 3
    seen = {}
    for r in got:
        seen.setdefault(r["doc_id"], []).append(r["copy"])
    assert sorted(seen) == [10000, 10001, 10002] and len({len(c) for c in seen.values()}) > 1
    assert all(sorted(c) == list(range(len(c))) and abs(len(c) - mean) < 6 * mean**0.5 for c in seen.values())


def test_split_draws_are_poisson(spark):
    rate = 1200.0
    n = spark.range(4000).select(mixing.count("s", F.col("id"), rate).alias("n"))
    mean, variance = n.agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(mean - rate) < 5 * (rate / 4000) ** 0.5 and abs(variance / rate - 1) < 0.12
