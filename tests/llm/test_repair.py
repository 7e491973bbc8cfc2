import random
import re
from hashlib import sha256
from zlib import crc32

import pytest

from fleetlens.llm import queries, repair

NAMES = "conv_id long, turn long, role string, text string"


def brute(rows, entry=0, ends=repair.ENDS):
    """Cheapest (cost, edits) from every place and state, backwards; the tail of inserted turns left out."""
    best = {(len(rows), s): (ends[s], "", s) for s in range(4)}
    for i in range(len(rows) - 1, -1, -1):
        initial, must_go, extra = rows[i]
        for s in range(4):
            found = [(4, "D", s)]
            if not must_go:
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, initial))
                found += [(extra, "K", to)] if to else []
                found.append((3 + extra, "R", 3 if s == 2 else 2))
            best[i, s] = min((c + best[i + 1, to][0], e + best[i + 1, to][1], best[i + 1, to][2]) for c, e, to in found)
        for _ in range(4):
            for s in range(4):
                c, e, to = best[i, 3 if s == 2 else 2]
                best[i, s] = min(best[i, s], (c + 3, "I" + e, to))
    cost, path, state = best[0, entry]
    return path, state, cost


def random_rows(r, n):
    for k in range(n):
        must = r.random() < 0.15
        role = "su"[k > 0] if k < 1 else "ua"[(k + (r.random() < 0.3)) % 2]
        yield (r.choice([role] * 8 + ["s", "u", "a", "t", "", " "]), must, 0 if must else r.choice([0, 0, 0, 3]))


def test_search_finds_the_least_of_the_cheapest_edits():
    r = random.Random(1)
    for _ in range(1500):
        rows = list(random_rows(r, r.choice([0, 1, 2, 3, 5, 8, 13, 30])))
        entry, ends = r.choice([(0, repair.ENDS), (r.randrange(4), tuple(r.randrange(9) for _ in range(4)))])
        assert repair.search(rows, entry, ends) == brute(rows, entry, ends)


def test_long_conversations_are_searched_without_recursion():
    r = random.Random(2)
    rows = list(random_rows(r, 3000))
    assert repair.search(rows) == brute(rows)
    assert repair.search([("t", False, 0)] * 3000)[2] == brute([("t", False, 0)] * 3000)[2]


def test_costs_between_states():
    r = random.Random(3)
    for _ in range(200):
        rows = list(random_rows(r, r.choice([0, 1, 4, 9])))
        far = 10**6
        for entry, costs in enumerate(repair.costs_between(rows)):
            for exit_, cost in enumerate(costs):
                found = brute(rows, entry, tuple(0 if s == exit_ else far for s in range(4)))[2]
                assert min(cost, far) == min(found, far)


def expected(conv, turns):
    """The result of a conversation from its rows before damage, straight from the definition."""
    rows = []
    for turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        k = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], sha256(x[2].encode()).hexdigest()))
    seen, kinds, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        kinds.append((role[:1], fault in ("blank", "duplicate"), 3 if fault == "truncated" else 0))
    path, state, cost = brute(kinds)
    audit = path + {0: "", 1: "II", 2: "I", 3: ""}[state]
    said, i, s = [], 0, 0
    for e in audit:
        if e == "K":
            said.append(f"{rows[i][1]}:{rows[i][2]}")
            s = {"s": 1, "u": 2, "a": 3}[kinds[i][0]]
        elif e != "D":
            s = 3 if s == 2 else 2
            said.append(f"{'assistant' if s == 3 else 'user'}:{'' if e == 'I' else rows[i][2]}")
        i += e != "I"
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    digest = sha256("\n".join(said).encode()).hexdigest()
    return (conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)


def random_table(r, conversations, rows):
    texts = ["Yes.", "No!", "What?", "and so", " \t\n", "", None, "Bye. \n", "é 漢字.", "the same.", "...", "x " * 9000 + "."]
    out = []
    for conv in range(conversations):
        turn = 0
        for k in range(r.choice(rows)):
            role = "ua"[k % 2] == "u" and "user" or "assistant"
            role = r.choice([role] * 9 + ["system", "tool", None, "", "user"]) if k or r.random() < 0.7 else "system"
            text = r.choice(texts) if r.random() < 0.4 else f"text {r.random()}."
            out.append((conv, r.choice([turn] * 12 + [None]), role, text))
            turn += r.choice([1] * 9 + [0, 2, 7])
    return out + [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (10**6, None, None, None)]


def by_conversation(rows):
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(rest)
    return {expected(conv, turns) for conv, turns in groups.items()}


@pytest.mark.parametrize("max_rows", [20_000, 7])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, max_rows):
    from fleetlens.plans import slicing

    monkeypatch.setattr(slicing, "PROBES", 7)
    whole = repair.repair
    monkeypatch.setattr(queries.repair, "repair", lambda turns: whole(turns, max_rows))
    r = random.Random(max_rows)
    rows = random_table(r, 60, [1, 2, 3, 6, 9] if max_rows > 7 else [1, 3, 6, 40, 90])
    spark.createDataFrame(rows, NAMES).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(x) for x in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()]
    want = by_conversation(rows)
    assert len(got) == len(want)
    assert set(got) == want


def test_real_outputs_nulls_and_clashes(spark):
    rows = [(1, 2, "assistant", "b."), (1, 1, "user", "a."), (2, 1, "user", None), (2, None, None, "c."), (None, 1, "user", "d.")]
    turns = spark.createDataFrame(rows, NAMES).selectExpr("*", "'x' as digest", "'y' as part", "1 as entry", "2 as _slice")
    got = {r["conv_id"]: [tuple(e) for e in r["edits"]] for r in repair.repair(turns).collect()}
    assert got[1] == [("K", "user", "a."), ("K", "assistant", "b.")]
    assert got[2] == [("D", None, None)] * 2
    assert got[None] == [("K", "user", "d."), ("I", "assistant", "")]
    assert repair.repair(turns.limit(0)).count() == 0
