"""Words and units of the catalog."""

from pyspark.sql import functions as F

from fleetlens.operators import catalog, glossary
from fleetlens.operators.specs import MEASUREMENTS


def test_every_measurement_and_field_has_words(spark):
    described = {r["measurement"]: r for r in catalog.descriptions(spark).collect()}
    assert set(described) == set(MEASUREMENTS) <= set(glossary.MEASUREMENT_TEXTS)
    assert all(r["description"] != m.replace("_", " ") and r["update_frequency"] for m, r in described.items())
    texts = catalog.field_texts(spark).collect()
    assert all(r["text"] and "_" not in r["text"] for r in texts)
    assert len({(r["measurement"], r["role"], r["key"]) for r in texts}) == len(texts)


def test_units():
    for measurement, name, unit in (
        ("cpu_usage", "cpu_user", "%"), ("memory_usage", "memory_usage_percent", "%"), ("memory_usage", "memory_free_mib", "MiB"), ("task_stats", "tasks_total", None),
        ("cpu_dataplane_tasks", "task_send_out", "%"), ("cpu_dataplane_tasks", "resource_session_avg", "%"), ("cpu_dataplane_tasks", "cpu_cores", "cores"),
        ("disk_usage", "use_percent", "%"), ("env_fan", "min_rpm", "RPM"), ("env_thermal", "max_temp_c", "°C"), ("interface_counters_hw", "ibytes", "bytes"),
        ("interface_counters_hw", "link_down_count", None), ("system_uptime", "uptime_days", "days"), ("ipsec_sa", "remaining_seconds", "s"), ("ha_status", "max_flaps", None),
        ("load_average", "load_1min", None), ("bgp_peer", "status_time", "s"), ("vpn_tunnel", "lifetime", "s"), ("interface_info", "speed", "Mbps"),
    ):
        assert glossary.unit(measurement, name) == unit, name


def test_other_measurements_are_described_by_their_names(spark):
    kind = "struct<v_bool:boolean,v_int:bigint,v_dbl:double,v_str:string>"
    points = spark.range(1).select(
        F.timestamp_seconds("id").alias("collected_at"), F.lit("d").alias("device"), F.lit("own").alias("measurement"),
        F.create_map(F.lit("some_tag"), F.lit("x")).alias("tags"), F.expr(f"map('free_mib', cast(struct(null, 1, null, null) as {kind}))").alias("fields"),
    )
    row = catalog.catalog(points, catalog.descriptions(spark)).first()
    assert (row["tags"][0]["description"], row["fields"][0]["unit"], row["fields"][0]["description"]) == ("some tag", "MiB", "free mib")


def test_parts_of_one_small_file_are_read_by_all_cores(spark):
    from fleetlens.queries.documents import part_points

    points = part_points(spark, "/root/testdata/sf0.001")
    assert points.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
