"""Work that is heavy per row stays spread over tasks, and is done once."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from fleetlens.functions import casts
from fleetlens.operators import health, project
from fleetlens.plans.ticks import spread
from fleetlens.sources import snapshots, store
from fleetlens.streaming import flows

SMALL = "/root/testdata/sf0.001"


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _documents(spark, rows, tasks):
    payload = F.expr(
        """concat('{"system":{"d', id, '":{"success":true,"data":{"resource_usage":{"cpu_idle":', id % 100, ',"memory_usage_percent":7,
           "load_average_1min":1}}}}}')"""
    )
    return spark.range(0, rows, 1, tasks).select(F.timestamp_seconds("id").alias("collected_at"), payload.alias("payload"))


def test_filters_stay_behind_the_shuffle_that_spreads(spark):
    rows = spread(spark.range(0, 100, 1, 1), "id")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    heavy = rows.filter(F.md5(F.col("id").cast("string")).startswith("a"))
    plan = _optimized(heavy)
    assert plan.index("md5") < plan.index("Repartition")
    assert heavy.count() == spark.range(100).filter(F.md5(F.col("id").cast("string")).startswith("a")).count()
    assert spread(spark.range(0, 100, 1, 1), "id", per_core=3).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_documents_are_parsed_once(spark):
    good, bad = snapshots.parsed(_documents(spark, 20, 2))
    assert len(re.findall("(?i)parse_?json", _optimized(good))) == 1
    assert (good.count(), bad.count()) == (20, 0)


def test_landing_without_gathering_leaves_files_for_all_tasks(spark, tmp_path):
    good, _ = snapshots.parsed(_documents(spark, 40, 4))
    rows = snapshots.collections(snapshots.envelopes(good))
    store.write_collections(rows, str(tmp_path / "c"), gather=False)
    landed = store.read_collections(spark, str(tmp_path / "c"))
    assert landed.count() == 40
    assert landed.select("_metadata.file_path").distinct().count() == 4


def test_fields_that_no_rule_names_are_left_out_but_no_point_is(spark):
    payload = F.expr(
        """element_at(array('{"load_average_1min":1,"load_average_15min":3}', '{"load_average_1min":1}', '{"load_average_15min":3}', '{"other":1}'), cast(id + 1 as int))"""
    )
    rows = spark.range(4).select(
        F.timestamp_seconds("id").alias("collected_at"), F.lit("system").alias("module"), F.lit("d").alias("device"),
        F.lit(None).cast("string").alias("hostname"), F.lit(None).cast("string").alias("data_hostname"),
        F.lit("resource_usage").alias("collection"), F.parse_json(payload).alias("body"), F.lit(False).alias("superseded"),
    )

    def fields(named):
        found = project.points(rows, present={"resource_usage"}, named=named)
        return {(r["collected_at"].minute * 60 + r["collected_at"].second, *sorted(r["fields"])) for r in found.collect()}

    assert fields({"load_average"}) == {(0, "load_15min", "load_1min"), (1, "load_1min"), (2, "load_15min")}
    for asked in ("load_15min", "load_15*"):
        assert fields({"load_average": {asked}}) == {(0, "load_15min"), (1, "load_1min"), (2, "load_15min")}
    assert fields({"load_average": {"nothing"}}) == fields({"load_average"})


def test_every_field_that_alerts_look_at_is_asked_for(spark):
    """Each rule's field, of either side of a pair, and what the look-back and core rules read."""
    looked = {(r[0], r[1]) for r in (*health.ALERTS, *health.PAIRS, *health.SUSTAINED, *health.CHANGES, *health.FALLS)}
    looked |= {(r[0], r[3]) for r in health.PAIRS} | {("load_average", "load_15min"), ("cpu_dataplane_cores", "cpu_utilization_avg")}
    assert looked == {(m, name) for m, names in health.WATCHED.items() for name in names}
    assert {r[:2] for r in health.CLASSES} <= {(m, name) for m, names in health.CLASSED.items() for name in names}


def test_whole_numbers_and_null_round_at_once(spark):
    values = "double(null), 0D, -0D, 7D, -100D, 1e300D, double('NaN'), double('Infinity'), 2.675D, -0.125D, 0.375D"
    text = casts.exact_round("x", 2)
    got = spark.sql(f"select {text} as y from (select explode(array({values})) as x)").collect()
    assert [str(r["y"]) for r in got] == ["None", "0.0", "0.0", "7.0", "-100.0", "1e+300", "nan", "inf", "2.67", "-0.12", "0.38"]
    assert "v IS NULL OR v % 1 = 0" in text


def test_named_measurements_are_those_of_all_points(spark):
    good, _ = snapshots.parsed(_documents(spark, 10, 2))
    rows = snapshots.collections(snapshots.envelopes(good))
    every = project.points(rows, present={"resource_usage"})
    some = project.points(rows, present={"resource_usage"}, named={"cpu_usage", "load_average"})
    wanted = every.filter(F.col("measurement").isin("cpu_usage", "load_average"))
    assert sorted(map(str, some.collect())) == sorted(map(str, wanted.collect()))
    assert "'memory_usage'" not in _optimized(some) and some.count() == 20


def test_objects_are_told_from_other_leaves(spark):
    texts = ['{"a":1}', "{}", "[1]", "[]", "null", "1", '"x"', '{"a":null}', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "parse_json(t) as v")
    told = rows.selectExpr("t", f"{casts.is_object('v')} as new", f"{casts.as_object('v')} IS NOT NULL as old").collect()
    assert [r["new"] for r in told] == [r["old"] for r in told] == [t is not None and t.startswith("{") for t in texts]
    inner = spark.sql("""select parse_json('{"x":{"y":[{"a":1},2,{"b":2}]}}') as v""").selectExpr(
        f"transform({casts.objects_of('v', 'x', 'y')}, o -> to_json(o)) as many", f"transform({casts.objects_of('v', 'x')}, o -> to_json(o)) as one"
    ).first()
    assert inner["many"] == ['{"a":1}', '{"b":2}'] and inner["one"] == ['{"y":[{"a":1},2,{"b":2}]}']


def test_untyped_fields_are_read_in_one_walk(spark):
    spec = project.MEASUREMENTS["interface_counters_logical"]
    body = """{"ifnet":{"ifnet":{"entry":[{"name":"a","ibytes":1,"obytes":"x","pod":"7","land":null,"teardrop":2.9},
        {"name":"b","ibytes":{"z":1},"sctp_conn":5,"ibytes2":9},{"name":"c","other":1},3]}}}"""
    rows = spark.createDataFrame([(body,)], "body string").selectExpr(
        "cast(null as timestamp) collected_at", "'d' device", "cast(null as string) hostname", "cast(null as string) data_hostname",
        f"'{spec.module}' module", f"'{spec.collection}' collection", "false superseded", "parse_json(body) body",
    )
    table = project.wide(rows, spec)
    assert _optimized(table).count("try_variant_get(entry") <= 2
    found = {r["interface"]: {k: v for k, v in r.asDict().items() if isinstance(v, int)} for r in table.collect()}
    assert found == {"a": {"ibytes": 1, "pod": 7, "teardrop": 2}, "b": {"sctp_conn": 5}}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables not there")
def test_snapshot_files_are_written_by_several_tasks(spark):
    files = entry_point.queries()["s1_snapshot_file"](spark, SMALL).inputFiles()
    assert len({re.search(r"part-(\d+)-", f).group(1) for f in files}) > 1


def test_points_that_are_used_once_are_not_kept(spark):
    good, _ = snapshots.parsed(_documents(spark, 10, 2))
    seen = {}

    def use(points):
        seen[points.is_cached] = sorted(map(str, points.collect()))

    for several in (True, False):
        flows.with_points(snapshots.envelopes(good), use, several=several)
    assert set(seen) == {True, False} and seen[True] == seen[False] != []
