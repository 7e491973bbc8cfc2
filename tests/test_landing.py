"""Host names resolved where a document lands; look-back alerts from one reading of the points."""

import io
import json
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from fleetlens.operators import health, joins, project
from fleetlens.sources import snapshots


def landed(spark, *documents):
    rows = [(json.dumps(d), i) for i, d in enumerate(documents)]
    raw = spark.createDataFrame(rows, "payload string, at int").select("payload", F.col("at").cast("timestamp").alias("collected_at"))
    return snapshots.collections(snapshots.envelopes(snapshots.parsed(raw)[0]))


def reported(name, success=True):
    return {"success": success, "data": {"system_info": {"system": {"hostname": name}}}}


FLOWS = {"vpn_flows": {"num_ipsec": 1, "total": 2}}


def test_host_names_of_snapshots_need_no_join(spark):
    rows = landed(
        spark,
        {"system": {"a": reported("core-a"), "b": reported(""), "c": reported("core-c", False), "d": "broken"},
         "vpn": {n: {"success": True, "data": FLOWS} for n in "abcd"} | {"e": {"success": True, "hostname": "own", "data": FLOWS}}},
        {"vpn": {"a": {"success": True, "data": {"_hostname": "kept", **FLOWS}}}},
    )
    points = project.points(rows, present={"vpn_flows"})
    got = project.with_hostname(points)
    found = {(r["device"], r["collected_at"].second): r["tags"]["hostname"] for r in got.filter("measurement = 'vpn_flows'").collect()}
    assert found == {("a", 0): "core-a", ("b", 0): "b", ("c", 0): "c", ("d", 0): "d", ("e", 0): "own", ("a", 1): "kept"}
    joined = project.with_hostname(points, joins.host_names(rows))
    assert sorted(map(str, joined.collect())) == sorted(map(str, got.collect()))
    plan = io.StringIO()
    with redirect_stdout(plan):
        got.explain("formatted")
    assert "Join" not in plan.getvalue()


def test_alerts_of_one_instant_do_not_vary(spark):
    """Two samples of one instant are ordered by what they hold, however the rows are dealt out."""
    rows = [(at, f"core-{i}", state, cpu) for at in range(6) for i, (state, cpu) in enumerate((("active", 90.0), ("passive", 70.0)))]
    kind = "struct<v_bool:boolean,v_int:bigint,v_dbl:double,v_str:string>"
    points = spark.createDataFrame(rows, "at int, slot string, state string, cpu double").select(
        F.col("at").cast("timestamp").alias("collected_at"), F.lit("fw").alias("device"),
        F.explode(F.array(F.lit("ha_status"), F.lit("cpu_usage"))).alias("measurement"),
        F.create_map(F.lit("slot"), "slot").alias("tags"), "state", "cpu",
    ).select(
        "collected_at", "device", "measurement", "tags",
        F.expr(f"""case measurement when 'ha_status' then map('local_state', cast(struct(null, null, null, state) as {kind}))
                   else map('cpu_total_used', cast(struct(null, null, cpu, null) as {kind})) end""").alias("fields"),
    )
    seen = set()
    for parts in (1, 3, 7):
        for limit in (10**6, 4):
            found = health.lookback_alerts(points.repartition(parts, F.rand(parts)), limit).collect()
            seen.add(tuple(sorted(str((r["collected_at"], r["measurement"], r["field"])) for r in found)))
    assert len(seen) == 1 and len(next(iter(seen))) == 11
