"""Documents nested to thousands of levels, and those that no parser follows."""

import json

import pytest

from fleetlens.operators import nested, pseudonyms

DEEP = '{"a":' * 5000 + '{"hostname":"h1","x":[1,"10.1.2.3"]}' + "}" * 5000
HOPELESS = '{"a":' * 200_000 + "1" + "}" * 200_000


def test_leaves_of_deep_documents(spark):
    docs = spark.createDataFrame([(1, DEEP), (2, HOPELESS), (3, None), (4, "{"), (5, '"x"'), (6, '{"b":{},"c":[{}]}')], "id long, doc string")
    got = {(r["id"], r["path"].count("."), r["path"][-9:], r["kind"]) for r in nested.leaf_profile(docs, "doc", ["id"]).collect()}
    assert got == {
        (1, 5000, ".hostname", "string"), (1, 5000, "a.a.a.a.x", "array"), (2, 0, "", "too deep"), (3, 0, "", "not json"), (4, 0, "", "not json"),
        (5, 0, "", "string"), (6, 0, "c", "array"),
    }


def test_pseudonyms_in_deep_documents(spark):
    docs = spark.createDataFrame([(1, DEEP), (2, HOPELESS), (3, '{"hostname":"h1"}')], "position long, doc string")
    out, mapping = pseudonyms.pseudonymised(docs, "doc", "standard")
    rows = {r["position"]: r["text"] for r in out.collect()}
    host = {r["original"]: r["surrogate"] for r in mapping.collect()}["h1"]
    assert json.loads(rows[3]) == {"hostname": host} and rows[2] is None
    assert rows[1] is None or (host in rows[1] and "10.1.2.3" not in rows[1] and rows[1].count("{") == 5001)


def test_places_are_those_of_the_walk():
    document = {"a": [1, {"b": "x", "c": None}, "y", True], "d": {"e": 2.5}}
    rows = list(pseudonyms._visit(document))
    assert [(r[0], r[1], r[6]) for r in rows] == [
        (0, "key", "a"), (1, "number", "1"), (2, "key", "b"), (3, "text", "x"), (4, "key", "c"), (5, "text", "y"),
        (6, "key", "d"), (7, "key", "e"), (8, "number", "2.5"),
    ]
    assert pseudonyms._rebuild(document, {}) == document
    changed = pseudonyms._rebuild(document, {3: {"text": "z", "is_number": False}, 7: {"text": "f", "is_number": False}, 1: {"text": "9", "is_number": True}})
    assert changed == {"a": [9, {"b": "z", "c": None}, "y", True], "d": {"f": 2.5}}


def test_leaf_flatten_in_sql(spark):
    nested.register_functions(spark)
    spark.createDataFrame([(1, '{"a":{"b":1}}', "k"), (2, None, "k")], "id long, doc string, path string").createOrReplaceTempView("flat_docs")
    want = {(1, "a.b", "integer"), (2, "", "not json")}
    lateral = spark.sql("select d.id, f.path, f.kind from flat_docs d, lateral leaf_flatten(d.doc) f")
    assert {tuple(r) for r in lateral.collect()} == want
    dealt = spark.sql("select id, path, kind from leaf_flatten(table(flat_docs) partition by (id), 'doc')")
    assert {tuple(r) for r in dealt.collect()} == want
    with pytest.raises(Exception, match="name the column"):
        spark.sql("select * from leaf_flatten(table(flat_docs) partition by (id), 'none')").collect()
