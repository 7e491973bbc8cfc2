import math
import os
from collections import Counter, defaultdict
from hashlib import md5, sha256
from itertools import combinations

import pyarrow as pa
import pytest

from fleetlens.llm import mixing, nbsvm, nearcopies, queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables not there")


@needs_tables
def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == names
        now = docs.count()
        assert name == "mix" or 0 < now <= before
        before = now
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_rows_go_to_workers_in_small_heaps(spark, documents, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(8000, numPartitions=1).selectExpr("id as doc_id", "repeat('x', 3000) as text")

    def heaps(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    for _, stage in corpus_pipeline.STAGES:
        if stage is corpus_pipeline.mix:
            continue  # without Python
        spark.conf.unset(name)
        monkeypatch.setattr(corpus_pipeline.nbsvm, "train", lambda *a: None)
        monkeypatch.setattr(corpus_pipeline.nbsvm, "keep_good", lambda docs, model: docs)
        monkeypatch.setattr(corpus_pipeline.nearcopies, "dedup", lambda docs: docs)
        if stage is not corpus_pipeline.quality or os.path.isdir(SMALL):
            stage(spark, documents([(1, "a")], clashes=False), SMALL)
            assert max(r["size"] for r in rows.mapInArrow(heaps, "size long").collect()) < 5 << 20
    spark.conf.unset(name)


def kept_by_similarity(docs, known):
    """Of each class of similar texts the smallest doc_id, from all pairs that share a shingle."""
    root, holders = {i: i for i, _, _ in docs}, defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    texts = {i: text for i, text, _ in docs}
    for i, text in texts.items():
        for _, _, h, _, _ in nearcopies.weighted([text]):
            for shingle in h.tolist():
                holders[shingle].append(i)
    for a, b in {pair for ids in holders.values() for pair in combinations(ids, 2)}:
        if nearcopies.similarity(texts[a], texts[b], known) >= 0.8:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return [d for d in docs if find(d[0]) == d[0]]


def copies_of(docs):
    """How often each document is taken: the Poisson count whose distribution first exceeds the document's number."""
    group = {i: source if source in mixing.TARGETS else None for i, _, source in docs}
    n = Counter(group.values())
    part = {g: mixing.REST if g is None else mixing.TARGETS[g] for g in n}
    for i, text, _ in docs:
        mean = len(docs) * part[group[i]] / sum(part.values()) / n[group[i]]
        u = int(md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-mean)
        cdf = p
        while cdf <= u:
            k += 1
            p *= mean / k
            cdf += p
        yield from [(i, text)] * k


@needs_tables
def test_run_against_brute_force(spark):
    """The five stages done anew in plain Python, on the rows that each one gets."""
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    from fleetlens.llm.bpe import read_ranks

    table, labels = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "labels"))
    docs = [(r["doc_id"], r["text"] or "", r["source"]) for r in table.collect()]
    model = nbsvm.train(table, labels)
    docs = [d for d, on in zip(docs, nbsvm.features([text for _, text, _ in docs])) if model.score(on) >= 0.3]
    largest = {}
    for i, text, _ in docs:
        largest[text] = max(i, largest.get(text, i))
    docs = [d for d in docs if largest[d[1]] == d[0]]
    known = nearcopies.frequencies(spark.createDataFrame([(text,) for _, text, _ in docs], "text string"))
    docs = kept_by_similarity(docs, known)
    ranks = read_ranks(public_tokenizers.path(corpus_pipeline.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, text in copies_of(docs):
        ids = library.encode_ordinary(text)
        want[i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(tuple(r) for r in got.collect()) == want


@needs_tables
def test_stages_on_awkward_rows(spark, awkward):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, awkward, SMALL)
        assert name == "tokens" or got.columns == awkward.columns
        got.count()


def test_one_query_for_each_operator():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{file}')")
    df = queries.QUERIES[name](spark, SMALL)
    cursor = con.execute(queries.SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*theirs).collect()), key=str)
    assert mine == sorted(cursor.fetchall(), key=str)
