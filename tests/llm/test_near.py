import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from fleetlens.llm import graph, nearcopies, shared, words


def sentence(r, n):
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def family(r, size, edits):
    base = sentence(r, 200)
    yield " ".join(base)
    for _ in range(size):
        copy = list(base)
        for _ in range(edits):
            copy[r.randrange(200)] = f"new{r.random()}"
        yield " ".join(copy)


def corpus():
    r = random.Random(2)
    texts = [" ".join(sentence(r, r.randint(1, 300))) for _ in range(150)]
    for size, edits in ((12, 1), (12, 3), (20, 4), (6, 8), (40, 2)):
        texts += family(r, size, edits)
    for _ in range(40):
        once = sentence(r, 200)
        part = once[60:100]
        # doubled, tripled, and with a passage that stands there up to thirty times
        texts += [" ".join(t) for t in (once, once * 2, once * 3, once[:100] + part * r.randint(1, 30) + once[100:])]
    shared = " ".join(sentence(r, 100))
    texts += [shared + " " + " ".join(sentence(r, 100)) for _ in range(30)]
    r.shuffle(texts)
    return texts + texts[:10] + ["", None, "a b", "a b", "A  B!", "a b c d"]


def shingles(text):
    found = [w.lower() for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


def test_classes_against_brute_force(documents):
    texts = corpus()
    df = documents(enumerate(texts))
    known = nearcopies.frequencies(df)
    inverted = defaultdict(list)
    for i, t in enumerate(texts):
        for s in shingles(t):
            inverted[s].append(i)
    pairs = {p for ids in inverted.values() for p in combinations(ids, 2)}
    links = [(a, b) for a, b in pairs if nearcopies.similarity(texts[a], texts[b], known) >= 0.8]
    links += [(a, b) for a, b in combinations(range(len(texts)), 2) if (texts[a] or "") == (texts[b] or "")]
    want = roots(range(len(texts)), links)
    got = nearcopies.classes(df).collect()
    assert len(got) == len(texts)
    assert {r["id"]: r["class_id"] for r in got} == want
    assert {r["id"] for r in got if r["kept"]} == set(want.values())
    assert nearcopies.dedup(df).count() == len(set(want.values())) and nearcopies.dedup(df).columns == df.columns


@pytest.mark.parametrize("ids", [shared.BROADCAST_IDS, -1])
def test_awkward_rows(awkward, monkeypatch, ids):
    monkeypatch.setattr(shared, "BROADCAST_IDS", ids)
    got = nearcopies.classes(awkward).collect()
    assert len(got) == awkward.count()
    by = defaultdict(list)
    for r in got:
        by[r["class_id"]].append(r)
    assert sorted(len(v) for v in by.values()) == [1, 1, 1, 2, 2, 2, 3]
    assert all(any(r["kept"] for r in v) for v in by.values())
    # a repeated row stays with its like: 4 twice, null twice
    assert nearcopies.dedup(awkward).count() == 9
    assert nearcopies.dedup(awkward.limit(0)).columns == awkward.columns


def test_frequencies_do_not_depend_on_the_number_of_texts():
    """The same shares of texts in a small and in a large corpus give the same weights."""
    r = np.random.default_rng(4)
    cells = r.poisson(3.0, (2, nearcopies.CELLS)).astype("int64")
    cells[:, :200] += 900
    h = r.integers(0, 1 << 63, 2000).astype("uint64")
    small, large = nearcopies.Frequencies(cells, 1000), nearcopies.Frequencies(cells * 100_000, 100_000_000)
    assert np.allclose(small.idf(h), large.idf(h)) and 1 <= small.idf(h).min() and small.idf(h).max() <= 1.25 + 1e-6
    assert small.weights(h[:1], np.array([10**6])) / small.weights(h[:1], np.array([1])) < 1.1


def test_samples_agree_as_often_as_sets_do():
    r = random.Random(8)
    texts = list(family(r, 200, 3))
    known = nearcopies.Frequencies(np.zeros((2, nearcopies.CELLS), "int64"), 1000)
    (_, _, h, n, ends), = nearcopies.weighted(texts)
    drawn = nearcopies.sampled(h, np.log(known.weights(h, n)).astype("float32"), ends)
    agree = (drawn[1:] == drawn[0]).mean()
    exact = np.mean([nearcopies.similarity(texts[0], t, known) for t in texts[1:]])
    assert abs(agree - exact) < 0.03


def test_shingles_against_plain_sets():
    texts = ["", "one", "a b c d", "a b c d e", "a b c d e f", "x " * 50, "ä B-c d e f g", " 1 2 3 4 5 6 7"] * 2
    for k in (5, 2):
        for first, stop, h, ends in words.shingles(texts, k):
            assert (first, stop) == (0, len(texts))
            parts = [tuple(p.tolist()) for p in np.split(h, ends[:-1])]
            assert parts[:8] == parts[8:]
            plain = [re.findall(r"\w+", t.lower()) for t in texts]
            for p, w in zip(parts, plain):
                grams = [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
                assert len(p) == len(grams) and len(set(p)) == len(set(grams))


def test_long_chains_are_one_component(spark):
    chain = spark.range(200).selectExpr("id * 7 % 201 as u", "(id + 1) * 7 % 201 as v")
    star = spark.range(1000, 1100).selectExpr("1000L as u", "id as v")
    got = {r["node"]: r["root"] for r in graph.components(chain.unionByName(star)).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1100)} == {1000} and len(got) == 301
    assert graph.components(chain.limit(0)).count() == 0


def test_only_partner_within_a_large_family(documents):
    """A text whose one similar partner does not stand out among a family by samples: the others lie just below 0.8."""
    r = random.Random(4)
    texts = []
    for _ in range(12):
        base = sentence(r, 200)
        near, lone = list(base), list(base)
        near[150] = lone[150] = f"new{r.random()}"
        for i in (20, 50, 80, 110):
            lone[i] = f"new{r.random()}"
        texts.append(" ".join(base))
        for _ in range(60):
            copy = list(base)
            copy[r.randrange(18, 23)] = f"new{r.random()}"
            texts.append(" ".join(copy))
        texts += [" ".join(near), " ".join(lone)]
    df = documents(enumerate(texts))
    known = nearcopies.frequencies(df)
    links = [
        (a, b) for n in range(0, len(texts), 63) for a, b in combinations(range(n, n + 63), 2)
        if nearcopies.similarity(texts[a], texts[b], known) >= 0.8
    ]
    assert [b for _, b in sorted(links) if b % 63 == 62] == list(range(62, len(texts), 63))
    assert {x["id"]: x["class_id"] for x in nearcopies.classes(df).collect()} == roots(range(len(texts)), links)
