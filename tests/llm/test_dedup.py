from collections import Counter, defaultdict
from hashlib import sha256

import pyarrow as pa
import pytest

from fleetlens.llm import exactdedup


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("groups", [exactdedup.BROADCAST_GROUPS, -1])
def test_copies_against_brute_force(spark, awkward, monkeypatch, groups):
    monkeypatch.setattr(exactdedup, "BROADCAST_GROUPS", groups)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    want = expected(rows)
    got = exactdedup.copies(awkward).collect()
    assert len(got) == len(rows)
    by_digest = {sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_digest[r["text_sha256"]]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(list(by_digest))


def test_dedup_keeps_columns_and_one_row(awkward):
    kept = exactdedup.dedup(awkward)
    assert kept.columns == awkward.columns
    got = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert len(got) == kept.count() == 7
    assert (5, "the same text again") in got and (8, [t for _, t in got if t and len(t) > 999][0]) in got


def test_texts_travel_once(awkward, monkeypatch):
    distinct, sent = exactdedup._distinct, []
    monkeypatch.setattr(exactdedup, "_distinct", lambda df, budget: sent.append(df) or distinct(df, budget))
    kept = exactdedup.dedup(awkward)
    assert [f.name for f in sent[0].schema["row"].dataType] == [c for c in awkward.columns if c != "text"]
    assert kept.columns == awkward.columns and kept.dtypes == awkward.dtypes
    found, rows = kept.collect(), Counter(awkward.collect())
    assert all(r in rows for r in found)  # null texts stay null, other columns come from the same row
    other = awkward.withColumn("text", awkward["text"].cast("binary"))
    got = exactdedup.dedup(other).selectExpr("doc_id", "cast(text as string) as text").collect()
    assert Counter(map(tuple, got)) == Counter((r["doc_id"], r["text"]) for r in found)


def test_two_texts_of_one_digest_stop_the_job():
    rows = {"digest": ["ab" * 32] * 2, "text": ["one", "two"], "id": [1, 2], "n": [1, 1]}
    with pytest.raises(ValueError, match="share the digest"):
        exactdedup._winners(pa.table(rows))
    rows["text"] = ["one", "one"]
    assert [x.tolist() for x in exactdedup._winners(pa.table(rows))] == [[1], [2]]


def test_empty_table(documents):
    nothing = documents([(1, "a")]).filter("doc_id > 1")
    assert exactdedup.copies(nothing).count() == 0 and exactdedup.dedup(nothing).columns == nothing.columns


def test_spills_until_buckets_fit(tmp_path):
    texts = [f"text number {i % 700} " * 20 for i in range(3000)]
    schema = pa.schema([("digest", pa.string()), ("text", pa.string()), ("id", pa.int64())])
    schema = schema.append(pa.field("n", pa.int64(), nullable=False))
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([sha256(t.encode()).hexdigest() for t in texts[a : a + 100]]), pa.array(texts[a : a + 100]),
             pa.array(range(a, a + 100), "int64"), pa.array([1] * 100, "int64")], schema=schema,
        )
        for a in range(0, 3000, 100)
    ]
    out = pa.Table.from_batches(exactdedup.grace(iter(batches), 20_000, str(tmp_path))).to_pylist()
    assert not list(tmp_path.iterdir())
    want = {}
    for i, t in enumerate(texts):
        want[t] = (i, want.get(t, (0, 0))[1] + 1)
    assert {r["text"]: (r["id"], r["n"]) for r in out} == want and len(out) == 700


def test_different_texts_with_one_digest_are_refused(tmp_path):
    table = pa.table({"digest": ["ab" * 32] * 2, "text": ["x", "y"], "id": [1, 2], "n": [1, 1]})
    try:
        list(exactdedup.grace(iter(table.to_batches()), 1000, str(tmp_path)))
    except ValueError:
        return
    raise AssertionError("no error")
