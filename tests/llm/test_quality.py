import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from fleetlens.llm import nbsvm


def corpus(n, seed=1):
    r = random.Random(seed)
    syllables = ["an", "er", "tion", "st", "ou", "re", "ing", "wh", "ly"]
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 200))]
        kind = r.choice(["good", "good", "good", "signs", "upper", "repeat"])
        if kind == "signs":
            words = [w + r.choice(["$$$", "###"]) for w in words]
        elif kind == "upper":
            words = [w.upper() + "!!" for w in words]
        elif kind == "repeat":
            words = [w for w in words for _ in range(9)]
        else:
            words[0] = words[0].capitalize()
        yield i, " ".join(words) + ".", int(kind == "good")


def test_held_out_accuracy(spark, documents):
    rows = list(corpus(600))
    df = documents([r[:2] for r in rows])
    labels = spark.createDataFrame([(i, q, 0, "x") for i, _, q in rows], "doc_id long, quality int, toxic int, text string")
    scored = nbsvm.scores(df, nbsvm.train(df, labels)).collect()
    assert len(scored) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    held = [r for r in scored if r["held_out"]]
    assert sum(r["predicted"] == rows[r["doc_id"]][2] for r in held) > 0.95 * len(held)


def test_held_out_labels_are_not_learned(spark, documents):
    rows = list(corpus(200))
    df = documents([r[:2] for r in rows])
    own = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, _, q in rows]
    schema = "doc_id long, quality int"
    a = nbsvm.train(df, spark.createDataFrame([(i, q) for i, _, q in rows], schema))
    b = nbsvm.train(df, spark.createDataFrame(own, schema))
    assert np.array_equal(a.weight, b.weight) and (a.bias, a.scale, a.shift) == (b.bias, b.scale, b.shift)


def test_awkward_rows(spark, awkward):
    schema = "doc_id long, quality int"
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1), (4, 1), (4, 1), (4, 0), (7, 1), (8, 1), (9, 0), (99, 1)], schema)
    for table in (labels, labels.limit(0)):
        model = nbsvm.train(awkward, table)
        got = nbsvm.scores(awkward, model).collect()
        assert len(got) == awkward.count()
        empty = {r["score"] for r in got if r["doc_id"] in (1, 2, 9)}
        assert len(empty) == 1 and all(0 <= r["score"] <= 1 for r in got)
        assert nbsvm.keep_good(awkward, model).columns == awkward.columns
    assert nbsvm.scores(awkward.limit(0), model).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = [t for _, t, _ in corpus(50)] + ["", " ", "é É", "a a a", "x"]
    alone = [next(iter(nbsvm.features([t]))) for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(alone, nbsvm.features(texts)))
    assert len(alone[50]) == 0


def plain_features(text):
    """Shapes word by word, and the sets of one, two and three of them, straight from their definition."""
    found, before = [], None
    for word in re.findall(rb"[\x21-\x7e\x80-\xff]+", text.encode()):
        shape = 0
        for b in word:
            shape |= 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 16 if b >= 128 else 8
        folded = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in word]
        while folded and folded[-1] == 0:  # signs at the end of a word do not tell it from the one before
            folded.pop()
        found.append(shape + 32 * (folded == before))
        before = folded
    grams = {(s,) for s in found} | set(zip(found, found[1:])) | set(zip(found, found[1:], found[2:]))
    offset = {1: 0, 2: 64, 3: 64 + 64**2}
    return sorted(offset[len(g)] + sum(s * 64 ** (len(g) - 1 - k) for k, s in enumerate(g)) for g in grams)


def test_features_against_plain_words():
    texts = [t for _, t, _ in corpus(80, seed=4)] + ["", " \x7f\x01", "É é É", "a a A a-b a$b 1 22 1!", "x\x7fy z"]
    assert [f.tolist() for f in nbsvm.features(texts)] == [plain_features(t) for t in texts]


def test_model_against_a_plain_solver(monkeypatch):
    """Ratios from plain counts, and the loss of the fitted weights beside that of a slow solver run to its end: near it after
    the usual rounds, at it after many."""
    rows = [(plain_features(t), q) for _, t, q in corpus(120, seed=9)]
    model = nbsvm.fit([(np.array(on, "int64"), q) for on, q in rows])
    counts = {1: Counter(), 0: Counter()}
    for on, q in rows:
        counts[q].update(on)
    total = {q: sum(counts[q].values()) + nbsvm.SIZE for q in (0, 1)}
    ratio = {
        f: math.log((counts[1][f] + 1) / total[1]) - math.log((counts[0][f] + 1) / total[0]) for f in counts[0].keys() | counts[1].keys()
    }
    assert all(abs(model.ratio[f] - r) < 1e-9 for f, r in ratio.items()) and np.count_nonzero(model.ratio) <= len(ratio)
    units, y = [], [1 if q else -1 for _, q in rows]
    for on, _ in rows:
        norm = math.sqrt(sum(ratio[f] ** 2 for f in on))
        units.append({f: ratio[f] / norm for f in on} | {"bias": 1.0})
    cost = [nbsvm.COST * len(y) / (2 * y.count(v)) for v in y]

    def loss(w):
        hinge = sum(c * max(0.0, 1 - v * sum(w.get(f, 0.0) * x for f, x in u.items())) for u, v, c in zip(units, y, cost))
        return 0.5 * sum(x * x for x in w.values()) + hinge

    w, alpha = {}, [0.0] * len(y)
    for _ in range(400):
        for i, u in enumerate(units):
            slope = y[i] * sum(w.get(f, 0.0) * x for f, x in u.items()) - 1
            new = min(max(alpha[i] - slope / sum(x * x for x in u.values()), 0.0), cost[i])
            for f, x in u.items():
                w[f] = w.get(f, 0.0) + (new - alpha[i]) * y[i] * x
            alpha[i] = new
    monkeypatch.setattr(nbsvm, "ROUNDS", 1000)
    longer = nbsvm.fit([(np.array(on, "int64"), q) for on, q in rows])
    for found, share in ((model, 0.05), (longer, 0.002)):
        fitted = {f: found.weight[f] / found.ratio[f] for f in ratio if found.ratio[f]} | {"bias": found.bias}
        assert loss(w) <= loss(fitted) * (1 + 1e-6) and loss(fitted) <= loss(w) * (1 + share)
