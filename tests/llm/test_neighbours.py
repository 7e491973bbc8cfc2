import numpy as np

from fleetlens.llm import neighbours


def table(spark, vectors, first=0):
    rows = [(first + i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def brute(ids, points, top=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = points @ points[i]
        scores[i] = -np.inf
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:top]
        out[int(ids[i])] = [(int(ids[j]), scores[j]) for j in order]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return got


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 24))
    points = (centres[r.integers(0, 12, 1500)] + r.normal(size=(1500, 24)) * 0.6).astype("float32").astype("float64")
    got = answers(neighbours.search(table(spark, points), leaf=32))
    want = brute(np.arange(1500), points)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, near in want.items():
        assert [x[2] for x in got[q]] == list(range(1, 21))
        for vec, score, _ in got[q]:
            assert abs(score - points[q] @ points[vec]) < 1e-9
        hits += len({x[0] for x in got[q]} & {x[0] for x in near})
        total += 20
    assert hits >= 0.9 * total


def test_copies_ties_and_left_out_vectors(spark):
    points = [[1.0, 0.0]] * 60 + [[0.0, 2.0]] * 3
    bad = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    got = answers(neighbours.search(table(spark, points + bad)))
    want = brute(np.arange(63), np.array(points))
    assert {q: [x[0] for x in v] for q, v in got.items()} == {q: [x[0] for x in v] for q, v in want.items()}


def test_few_rows_and_none(spark):
    got = answers(neighbours.search(table(spark, [[1.0, 2.0], [3.0, 4.0]])))
    assert got == {0: [(1, 11.0, 1)]}
    assert neighbours.search(table(spark, [[1.0, 2.0]])).count() == 0
    assert neighbours.search(table(spark, [[1.0]]).limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    repeated = table(spark, [[1.0, 2.0], [3.0, 4.0]])
    assert answers(neighbours.search(repeated.union(repeated))) == {0: [(1, 11.0, 1)]}


def test_queue_visits_leaves_by_margin():
    r = np.random.default_rng(3)
    points = r.normal(size=(400, 8))
    forest = neighbours.Forest(points, trees=3, leaf=20)
    leaves = int(forest.first[-1])
    asked = r.normal(size=(40, 8))
    for found, cells in zip(forest.visited(asked, leaves), forest.cells(asked)):
        assert sorted(found) == list(range(leaves)) and set(found[:3]) == set(cells.tolist())


def test_blocks_of_a_hot_leaf(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    points = np.random.default_rng(4).normal(size=(200, 4)).astype("float32").astype("float64")
    got = answers(neighbours.search(table(spark, points), leaf=500))
    want = brute(np.arange(200), points)
    assert {q: [x[0] for x in v] for q, v in got.items()} == {q: [x[0] for x in v] for q, v in want.items()}
