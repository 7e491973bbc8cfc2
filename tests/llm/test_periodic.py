import random
from hashlib import sha256
from zlib import crc32

import pytest

from fleetlens.llm import periodic, queries


def brute(words, least=12):
    """Every period in turn: stretches in which words so far apart are equal; the smallest period of a stretch stays."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted([(s, e - s, q) for (s, e), q in found.items()], key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(r):
    n, signs = r.choice([0, 1, 5, 13, 40, 90, 200]), "abcdefgh"[: r.choice([1, 2, 3, 8])]
    words = [r.choice(signs) for _ in range(n)]
    for _ in range(r.choice([0, 1, 3]) if n > 20 else 0):
        p, s = r.randrange(1, n // 2), r.randrange(0, n)
        for i in range(s + p, r.randrange(s, n + 1)):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("least", [2, 5, 12, 31])
def test_runs_are_those_of_brute_force(monkeypatch, least):
    r = random.Random(least)
    for _ in range(150):
        monkeypatch.setattr(periodic, "CHUNK", r.choice([1, 100, 5000]))
        many = [random_words(r) for _ in range(r.choice([1, 4]))]
        for words, (n, rows, kept) in zip(many, periodic.found_in([" ".join(w) for w in many], least)):
            want = brute(words, least)
            assert (n, [tuple(x) for x in rows.tolist()], kept) == (len(words), want, collapsed(words, want))


def test_very_long_repetitions():
    (n, rows, kept), (_, lines, _), (_, none, _) = periodic.found_in(
        ["a " * 200_000, ("x " * 50 + "y ") * 2000, " ".join(f"u{i} a line that many places share here" for i in range(9000))]
    )
    assert n == 200_000 and rows.tolist() == [[0, 200_000, 1]] and kept == "a"
    assert [0, 2000 * 51, 51] in lines.tolist() and len(lines) == 2001
    assert len(none) == 0


def test_white_space_is_that_of_ascii():
    n, rows, kept = next(periodic.found_in(["\x0bone two\tthree\r\n\x0c é é "]))
    assert n == 3 and kept == "one two three é é"


def test_awkward_rows(awkward):
    more = awkward.selectExpr("*", "'x' as runs", "'x' as collapsed", "doc_id as N_Words")
    got = periodic.describe(more)
    assert got.count() == more.count() and {"n_words", "runs", "collapsed", "digest", "row"} <= set(got.columns)
    rows = {(r["doc_id"], r["n_words"], len(r["runs"]), r["collapsed"]) for r in got.collect()}
    assert (1, 0, 0, "") in rows and (2, 0, 0, "") in rows and (9, 0, 0, "") in rows
    assert (None, 3, 0, "without a number") in rows
    assert periodic.describe(more.limit(0)).count() == 0


def expected(doc_id, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *first, sha256(said.encode()).hexdigest(), sha256(collapsed(words, runs).encode()).hexdigest())


def test_query_equals_brute_force(spark, documents, tmp_path):
    r = random.Random(7)
    rows = [(i, None if i == 3 else "\n".join([" ".join(random_words(r)), "  é 漢字\t"])) for i in range(160)]
    documents(rows, clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert {tuple(x) for x in got.collect()} == {expected(*row) for row in rows}
