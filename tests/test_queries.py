"""Registered queries against their SQL on the smallest tables."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry_point
from fleetlens.queries import all_queries

SMALL = "/root/testdata/sf0.001"
SAMPLE = (
    "a10_bucket_rate_5min", "a1_protocol_counts", "c2_value_profile", "f08_expectations", "h2_alerts", "j3_source_merge",
    "j6_validity", "k3_top_by_value", "n07_peer_layout", "n08_route_layout", "p12_named_numbers", "p19_line",
    "pj10_disk_usage", "pj43_vpn_gateway", "s3_response_decode", "u2_fallback", "w11_failure_streak", "x1_dictionary",
    "x6_compound_text",
)

needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables not there")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in sorted(os.listdir(SMALL)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{name}')")
    return con


def test_every_sql_has_a_query():
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(queries)
    assert {name for name, q in all_queries().items() if not q.sql} == set()


@needs_tables
def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["device", "bucket_us", "samples", "octets", "sum_bps", "max_bps"] and df.count() > 0


@needs_tables
@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, SMALL)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    order = sorted(theirs)
    assert sorted(df.columns) == order
    mine = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in order]).collect())
    picked = [theirs.index(c) for c in order]
    assert mine == Counter(tuple(r[i] for i in picked) for r in cursor.fetchall())
