"""Health, alerts, catalog, pseudonyms and user hooks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import casts, netaddr
from fleetlens.operators import catalog, health, hooks, joins, project, pseudonyms, textparse
from fleetlens.plans.ticks import spread, table
from fleetlens.queries import query
from fleetlens.session import run_dir
from fleetlens.sources import snapshots, store

# ---- health and alerts ----------------------------------------------------------------------

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MELTED = """m as (select l_suppkey as device, l_orderkey, field, value from lineitem
    unpivot (value for field in (l_quantity, l_extendedprice, l_discount, l_tax)))"""
CUTS = "('lineitem', 'l_quantity', 30.0, 45.0, true), ('lineitem', 'l_discount', 0.03, 0.01, false)"
RULES = """('lineitem', 'l_quantity', '>', '45', 'warn'), ('lineitem', 'l_tax', '>=', '0.07', 'critical'),
    ('lineitem', 'l_d*', '<', '0.01', 'warn'), ('lineitem', 'l_extendedprice', '<=', '1000', 'warn'), ('other', 'l_tax', '>', '0', 'warn')"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("device"), "l_orderkey", *MEASURES)
    return project.melt(rows, ["device", "l_orderkey"], MEASURES).withColumn("measurement", F.lit("lineitem"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = spark.sql(
        f"select col1 as measurement, col2 as field, cast(col3 as double) as low, cast(col4 as double) as high, col5 as rising from values {CUTS}"
    )
    return health.classified(_metrics(spark, sf_dir), cuts, F.col("value"))


LEVELS = f"""{MELTED}, l as (select device, l_orderkey, field, case field
      when 'l_quantity' then case when value < 30 then 'ok' when value < 45 then 'warn' else 'critical' end
      else case when value < 0.01::double then 'critical' when value < 0.03::double then 'warn' else 'ok' end end as level
    from m where field in ('l_quantity', 'l_discount'))"""


@query("h1_health_class", f"with {LEVELS} select device, field, level, count(*) as n from l group by all")
def h1_health_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).groupBy("device", "field", "level").agg(F.count("*").alias("n"))


@query(
    "h1_peer_and_counter_class",
    """select o_orderkey, case o_orderkey % 5 when 0 then 'up' when 1 then 'transitional' when 2 then 'transitional' else 'down' end as peer,
       case when o_custkey % 10 = 0 or o_orderstatus = 'F' then 'ok' when o_custkey < 1000 then 'warn' else 'critical' end as counter from orders""",
)
def h1_peer_and_counter_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.expr("element_at(array('Established', 'Active', 'OpenSent', 'Idle', 'Unknown'), cast(o_orderkey % 5 + 1 as int))")
    severity = F.expr("case o_orderstatus when 'F' then 'info' when 'O' then 'drop' else 'warn' end")
    value = F.expr("if(o_custkey % 10 = 0, 0, o_custkey)")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", health.peer_level(state).alias("peer"), health.counter_level(severity, value).alias("counter")
    )


@query(
    "h2_alerts",
    f"""with {MELTED} select device, field, l_orderkey, value, case field when 'l_tax' then 'critical' else 'warn' end as severity from m
        where (field = 'l_quantity' and value > 45) or (field = 'l_tax' and value >= 0.07::double) or (field = 'l_discount' and value < 0.01::double)
           or (field = 'l_extendedprice' and value <= 1000)""",
)
def h2_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(
        f"select col1 as measurement, col2 as field, col3 as op, col4 as threshold, col5 as severity from values {RULES}"
    )
    found = health.alerts(_metrics(spark, sf_dir), rules, F.col("value"), F.lit(None).cast("string"))
    return found.select("device", "field", "l_orderkey", "value", "severity")


@query(
    "h2_text_alerts",
    """select o_orderkey, 'state_sync' as field from orders where o_orderstatus <> 'F'
       union all select o_orderkey, 'app_compat' from orders where o_orderpriority = '1-URGENT'""",
)
def h2_text_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lit("ha_status").alias("measurement"),
        F.explode(
            F.create_map(
                F.lit("state_sync"), F.expr("if(o_orderstatus = 'F', 'Complete', o_orderstatus)"),
                F.lit("app_compat"), F.expr("if(o_orderpriority = '1-URGENT', 'Mismatch', 'Match')"),
            )
        ).alias("field", "v_str"),
    )
    found = health.alerts(metrics, health.alert_rules(spark), F.lit(None).cast("double"), F.col("v_str"))
    return found.select("o_orderkey", "field")


def _health_points(spark: SparkSession, sf_dir: str, named: dict[str, set[str]]) -> DataFrame:
    """Every customer is a poll of its nation's device, with eleven measurements made of its columns; points of those ``named``."""
    payload = F.expr(
        """concat('{"system":{"fw-', c_nationkey, '":{"success":true,"data":{"resource_usage":{"cpu_idle":', c_custkey % 100, ',"memory_usage_percent":', c_custkey * 7 % 100,
           ',"swap_usage_percent":', c_custkey * 3 % 100, ',"load_average_15min":', c_custkey % 8, ',"tasks_zombie":', c_custkey % 3, '},"environmental":{"thermal":{"S1":{"entry":{"slot":1,"DegreesC":', c_custkey % 100,
           ',"max":90,"alarm":', c_custkey % 9 = 0, '}}},"fan":{"S1":{"entry":[{"slot":1,"RPMs":', c_custkey % 9000, ',"min":1000,"alarm":false}]}},"power":{"S1":{"entry":{"slot":1,"Volts":', c_custkey % 40 / 8,
           ',"min":1,"max":3,"alarm":false}}}},"ha_status":{"enabled":"yes","group":{"local-info":{"state":"', if(c_custkey % 5 < 3, 'active', 'passive'), '","state-sync":"', if(c_custkey % 4 = 0, 'Incomplete', 'Complete'),
           '"}}},"extended_cpu":{"resource-monitor":{"dp0":{"second":{"cpu-load-average":{"entry":[{"coreid":0,"value":"', c_custkey % 100, '"},{"coreid":1,"value":"10"}]}}}}},"system_info":{"system":{"_uptime_seconds":', c_custkey * 60 % 7200,
           '}}}}},"interfaces":{"fw-', c_nationkey, '":{"success":true,"data":{"interface_counters":{"hw":{"entry":{"name":"eth1","port":{"rx-error":', c_custkey % 5, ',"tx-error":', c_custkey * 11 % 120, '}}}}}}}}')"""
    )
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", per_core=3).select(
        F.timestamp_seconds(F.col("c_custkey") * 60).alias("collected_at"), payload.alias("payload")
    )
    good, _ = snapshots.parsed(rows)
    landed = run_dir(spark, "bronze")
    store.write_collections(snapshots.collections(snapshots.envelopes(good)), landed, gather=False)
    present = {"resource_usage", "environmental", "ha_status", "extended_cpu", "system_info", "interface_counters"}
    return health.with_error_totals(project.points(store.read_collections(spark, landed), present=present, named=named))


POLLED = """with c as (select c_custkey as k, 'fw-' || cast(c_nationkey as varchar) as device from customer),
    h as (select *, 100 - k % 100 as used, case when k % 5 < 3 then 'active' else 'passive' end as state, k * 60 % 7200 as up from c),
    s as (select *, lag(state) over w as old, lag(up) over w as before,
        count(case when used > 80 then 1 end) over (partition by device order by k rows between 2 preceding and current row) as hot from h window w as (partition by device order by k))"""


@query(
    "h1_catalog_classes",
    f"""{POLLED}, v as (
        select device, 'cpu_usage' as measurement, 'cpu_total_used' as field, case when used < 70 then 'ok' when used < 90 then 'warn' else 'critical' end as level from h
        union all select device, 'memory_usage', 'memory_usage_percent', case when k * 7 % 100 < 70 then 'ok' when k * 7 % 100 < 90 then 'warn' else 'critical' end from h
        union all select device, 'swap_usage', 'swap_usage_percent', case when k * 3 % 100 < 30 then 'ok' when k * 3 % 100 < 70 then 'warn' else 'critical' end from h
        union all select device, 'interface_counters_hw', 'errors_total', case when k % 5 + k * 11 % 120 < 1 then 'ok' when k % 5 + k * 11 % 120 < 100 then 'warn' else 'critical' end from h)
      select device, measurement, field, level, count(*) as n from v group by all""",
)
def h1_catalog_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = project.long_metrics(_health_points(spark, sf_dir, health.CLASSED))
    found = health.classified(metrics, health.cut_points(spark), health.metric_columns(metrics)[0])
    return found.groupBy("device", "measurement", "field", "level").agg(F.count("*").alias("n"))


@query(
    "h2_catalog_alerts",
    f"""{POLLED}, a as (
        select k, device, 'cpu_usage' as measurement, 'cpu_total_used' as field, 'warn' as severity from h where used > 80
        union all select k, device, 'cpu_usage', 'cpu_total_used', 'critical' from s where hot = 3
        union all select k, device, 'memory_usage', 'memory_usage_percent', 'warn' from h where k * 7 % 100 > 85
        union all select k, device, 'swap_usage', 'swap_usage_percent', 'warn' from h where k * 3 % 100 > 25
        union all select k, device, 'task_stats', 'tasks_zombie', 'warn' from h where k % 3 > 0
        union all select k, device, 'load_average', 'load_15min', 'warn' from h where k % 8 > 2
        union all select k, device, 'env_thermal', 'temperature_c', 'warn' from h where k % 100 > 81
        union all select k, device, 'env_thermal', 'alarm', 'critical' from h where k % 9 = 0
        union all select k, device, 'env_fan', 'rpm', 'critical' from h where k % 9000 < 1000
        union all select k, device, 'env_power', 'volts', 'critical' from h where k % 40 < 8 or k % 40 > 24
        union all select k, device, 'ha_status', 'state_sync', 'critical' from h where k % 4 = 0
        union all select k, device, 'ha_status', 'local_state', 'critical' from s where old <> state
        union all select k, device, 'cpu_dataplane_cores', 'cpu_utilization_avg', 'critical' from h where k % 100 > 90
        union all select k, device, 'cpu_dataplane_cores', 'imbalance', 'warn' from h where abs(k % 100 - 10) > 50
        union all select k, device, 'system_uptime', 'uptime_seconds', 'warn' from s where before > up)
      select k * 60 as at, device, measurement, field, severity from a""",
)
def h2_catalog_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = run_dir(spark, "points")
    store.write_points(_health_points(spark, sf_dir, health.WATCHED), stored, partitions=("measurement",))
    points = store.read_points(spark, stored)
    found = health.catalog_alerts(points, project.long_metrics(points))
    return found.select(F.unix_seconds("collected_at").alias("at"), "device", "measurement", "field", "severity")


@query(
    "h2_outdated_content",
    """select o_orderkey, date_diff('day', cast(o_orderdate as date), date '1998-01-01') > 7 as outdated, o_custkey % 10 = o_orderkey % 10 as same_priority from orders""",
)
def h2_outdated_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        health.outdated(F.col("o_orderdate"), F.lit("1998-01-01").cast("date")).alias("outdated"),
        health.equal_priority(F.expr("o_custkey % 10"), F.expr("o_orderkey % 10")).alias("same_priority"),
    )


@query(
    "h3_health_report",
    f"""with {LEVELS}, p as (select device, field, max(case level when 'critical' then 2 when 'warn' then 1 else 0 end) as place from l group by 1, 2)
        select device, ['ok', 'warn', 'critical'][max(place) + 1] as worst, coalesce(string_agg(field, ',' order by field) filter (where place > 0), '') as breaching
        from p group by 1""",
)
def h3_health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = health.report(_levels(spark, sf_dir), metric="field")
    return report.withColumn("breaching", F.array_join("breaching", ","))


# ---- catalog --------------------------------------------------------------------------------

ORDER_FIELDS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORDER_LONG = """v as (select o_orderkey, unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) as field,
    unnest([cast(o_custkey as varchar), o_orderstatus, cast(o_totalprice as varchar), o_orderpriority]) as text from orders)"""


def _order_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[F.col(c).cast("string").alias(c) for c in ORDER_FIELDS])
    return rows.unpivot(["o_orderkey"], ORDER_FIELDS, "field", "text")


@query(
    "c1_type_label",
    """select event_id, ['boolean', 'integer', 'float', 'string', 'string'][event_id % 5 + 1] as label from events""",
)
def c1_type_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.expr(
        "parse_json(element_at(array('true', cast(event_id as string), concat(event_id, '.5'), concat('\"', event_type, '\"'), props), cast(event_id % 5 + 1 as int)))"
    )
    docs = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return docs.select("event_id", F.expr(casts.leaf_label("doc")).alias("label"))


@query(
    "c2_value_profile",
    f"""with {ORDER_LONG} select field, count(*) as rows, count(distinct text) as distinct_values,
        case field when 'o_custkey' then 'integer' when 'o_totalprice' then 'float' else 'string' end as types, arg_min(text, o_orderkey) as example from v group by field""",
)
def c2_value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _order_long(spark, sf_dir)
    profile = catalog.value_profile(long, ["field"], "text", F.expr(casts.text_kind("text")), "o_orderkey")
    return profile.withColumn("types", F.array_join("types", ","))


def _part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.queries.documents import part_points

    descriptions = spark.createDataFrame(
        [("stock item", "Parts in stock", "stock", "rarely", "one point per part")],
        "measurement string, description string, category string, update_frequency string, notes string",
    )
    points = part_points(spark, sf_dir).withColumn("tags", F.map_filter("tags", lambda _, v: v.isNotNull() & (v != "")))
    named = F.transform_keys("fields", lambda k, _: F.when(k == "size", "size_mib").otherwise(k))
    return catalog.catalog(
        points.withColumn("fields", F.map_filter(named, lambda k, _: k != "absent")), descriptions
    )


CATALOG = """k as (
         select 'tag' as role, 'name' as key, 'string' as type, count(distinct p_name) as distinct_values, arg_min(p_name, 'dev-' || cast(p_partkey as varchar)) as example, null as unit, 'name' as description from part
         union all select 'tag', 'brand', 'string', count(distinct p_brand) filter (where p_partkey % 3 > 0), arg_min(p_brand, 'dev-' || cast(p_partkey as varchar)) filter (where p_partkey % 3 > 0), null, 'brand' from part
         union all select 'field', 'size_mib', 'integer', count(distinct p_size), cast(arg_min(p_size, 'dev-' || cast(p_partkey as varchar)) as varchar), 'MiB', 'size mib' from part
         union all select 'field', 'retail price', 'float', count(distinct p_retailprice), cast(arg_min(p_retailprice, 'dev-' || cast(p_partkey as varchar)) as varchar), null, 'retail price' from part
         union all select 'field', 'kind', 'string', count(distinct p_type), 'say "' || arg_min(p_type, 'dev-' || cast(p_partkey as varchar)) || '"', null, 'kind' from part
         union all select 'field', 'large', 'boolean', count(distinct p_size > 25), case when arg_min(p_size, 'dev-' || cast(p_partkey as varchar)) > 25 then 'true' else 'false' end, null, 'large' from part)"""


@query(
    "c2_catalog",
    f"""with {CATALOG}
       select 'stock item' as measurement, 'stock' as category, 'low' as cardinality, cast(1 as bigint) as points_per_collection, role, key, type, example, distinct_values, unit, description from k""",
)
def c2_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_catalog(spark, sf_dir)
    both = F.array(
        F.struct(F.lit("tag").alias("role"), F.col("tags").alias("keys")),
        F.struct(F.lit("field").alias("role"), F.col("fields").alias("keys")),
    )
    listed = rows.select("measurement", "category", "cardinality", "points_per_collection", F.inline(both))
    return listed.select("measurement", "category", "cardinality", "points_per_collection", "role", F.inline("keys"))


#: What the catalog has to say of these fields, written by hand: measurement, role, key, unit, description.
SAID = (
    ("cpu_usage", "field", "cpu_total_used", "%", "processor time that was not idle"),
    ("cpu_usage", "field", "cpu_iowait", "%", "processor waiting for disks"),
    ("cpu_usage", "field", "cpu_idle", "%", "idle processor time"),
    ("system_identity", "field", "vm_cores", "cores", "virtual machine cores"),
    ("system_identity", "field", "vm_mem_mb", "MiB", "memory of the virtual machine"),
    ("system_identity", "field", "is_dhcp", None, "1 if the IPv4 address comes from DHCP"),
    ("system_identity", "tag", "serial", None, "serial"),
    ("system_uptime", "field", "uptime_seconds", "s", "uptime seconds"),
    ("task_stats", "field", "tasks_zombie", None, "tasks zombie"),
    ("cpu_dataplane_tasks", "field", "task_flow_mgmt", "%", "task flow management"),
    ("cpu_dataplane_tasks", "field", "cpu_cores", "cores", "processor cores"),
    ("env_thermal", "field", "temperature_c", "°C", "temperature"),
    ("env_fan", "field", "rpm", "RPM", "revolutions"),
    ("env_power", "field", "volts", "V", "volts"),
    ("interface_info", "field", "speed", "Mbps", "speed of the link"),
    ("interface_counters_hw", "field", "rx_bytes", "bytes", "received bytes"),
    ("interface_counters_hw", "field", "rx_unicast", "packets", "received unicast"),
    ("interface_counters_hw", "field", "link_down_count", None, "how often the link went down"),
    ("interface_counters_logical", "field", "tcp_conn", "connections", "TCP connection"),
    ("interface_counters_logical", "field", "noarp", "packets", "packets without an ARP entry"),
    ("ha_status", "field", "av_compat", None, "whether the antivirus versions of the pair match"),
    ("ha_status", "field", "local_state_duration", "s", "local state duration"),
    ("bgp_peer", "field", "state_up", "boolean", "1 while the state is up"),
    ("vpn_tunnel", "field", "kb_limit", "KB", "traffic after which keys are renewed"),
    ("ipsec_sa", "field", "remaining_percent", "%", "remaining percent"),
    ("mac_count", "field", "mac_count", "addresses", "number of hardware addresses"),
    ("memory_usage", "field", "memory_buff_cache_mib", "MiB", "memory buffer cache"),
    ("disk_usage", "field", "use_percent", "%", "use percent"),
)


@query(
    "c2_field_texts",
    "select s.*, u.n as suppliers from (values "
    + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" for v in row) + ")" for row in SAID)
    + ") s(measurement, role, key, unit, description), (select count(*) as n from supplier) u",
)
def c2_field_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and descriptions that the catalog gives to fields of points, one point for each supplier and measurement."""
    one = "cast(struct(null, 1, null, null) as struct<v_bool:boolean,v_int:bigint,v_dbl:double,v_str:string>)"

    def held(measurement: str, role: str, value: str) -> str:
        keys = [key for m, r, key, *_ in SAID if (m, r) == (measurement, role)]
        return f"map_from_arrays(array({', '.join(map(repr, keys))}), array({', '.join([value] * len(keys))}))" if keys else "map()"

    each = [
        f"struct('{m}' as measurement, cast({held(m, 'tag', repr('x'))} as map<string,string>) as tags, "
        f"cast({held(m, 'field', one)} as map<string,struct<v_bool:boolean,v_int:bigint,v_dbl:double,v_str:string>>) as fields)"
        for m in sorted({row[0] for row in SAID})
    ]
    points = table(spark, sf_dir, "supplier").select(
        F.timestamp_seconds("s_suppkey").alias("collected_at"), F.concat(F.lit("dev-"), F.col("s_suppkey")).alias("device"),
        F.expr(f"inline(array({', '.join(each)}))"),
    )
    rows = catalog.catalog(points, catalog.descriptions(spark))
    counted = points.groupBy("measurement").agg(F.countDistinct("device").alias("suppliers"))
    both = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}s").alias("keys")) for r in ("tag", "field")])
    listed = rows.join(counted, "measurement").select("measurement", "suppliers", F.inline(both)).select("measurement", "suppliers", "role", F.inline("keys"))
    return listed.select("measurement", "role", "key", "unit", "description", "suppliers")


@query(
    "a8_catalog_summary",
    f"""with {CATALOG}, n as (select max(n) as n from (select count(*) as n from part group by p_partkey)),
       t as (select count(*) filter (role = 'tag' and distinct_values > 0) as tags, count(*) filter (role = 'field' and distinct_values > 0) as fields from k)
       select category, cast(1 as bigint) as measurements, tags, fields, cast(n <= 1 as bigint) as low_cardinality,
         cast(n > 1 and n <= 100 as bigint) as medium_cardinality, cast(n > 100 as bigint) as high_cardinality
       from t, n, (values ('stock'), ('all')) c(category)""",
)
def a8_catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.summary(_part_catalog(spark, sf_dir))


@query(
    "c3_cardinality",
    """with n as (select event_type as measurement, user_id, cast(ts as date) as d, count(*) as n from events group by all)
       select measurement, max(n) as points_per_collection, case when max(n) <= 1 then 'low' when max(n) <= 3 then 'medium' else 'high' end as cardinality from n group by 1""",
)
def c3_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("measurement"), F.col("user_id").alias("device"), F.to_date("ts").alias("collected_at")
    )
    return catalog.cardinality(points).withColumn("cardinality", catalog.cardinality_class(F.col("points_per_collection"), 3))


@query(
    "c4_type_conflicts",
    rf"""with {ORDER_LONG}, w as (select field, case when field = 'o_totalprice' and o_orderkey % 9 = 0 then cast(o_orderkey as varchar)
             when field = 'o_orderpriority' and o_orderkey % 9 = 1 then substr(text, 1, 1) else text end as text from v),
        k as (select distinct field, case when regexp_matches(text, '^-?[0-9]+$') then 'integer'
             when regexp_matches(text, '^[0-9]+\.[0-9]+$') then 'float' else 'string' end as kind from w)
        select field, count(*) as types, string_agg(kind, ',' order by kind) as seen from k group by field having count(*) > 1""",
)
def c4_type_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _order_long(spark, sf_dir).withColumn(
        "text",
        F.expr(
            """case when field = 'o_totalprice' and o_orderkey % 9 = 0 then cast(o_orderkey as string)
               when field = 'o_orderpriority' and o_orderkey % 9 = 1 then substr(text, 1, 1) else text end"""
        ),
    )
    return catalog.type_conflicts(long, ["field"], F.expr(casts.text_kind("text")))


@query(
    "c5_catalog_export",
    f"""with {CATALOG}, n as (select p_partkey, count(*) as n from part group by 1), m as (select max(n) as n from n)
       select 'stock item' as measurement, 'stock' as category, case when n <= 1 then 'low' else 'medium' end as cardinality, n as points_per_collection,
              role, key, type, example, distinct_values, unit, description from k, m""",
)
def c5_catalog_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "catalog")
    rows = _part_catalog(spark, sf_dir)
    catalog.written(rows, path)
    stored = spark.read.schema(rows.schema).json(path)
    both = F.array(
        F.struct(F.lit("tag").alias("role"), F.col("tags").alias("keys")),
        F.struct(F.lit("field").alias("role"), F.col("fields").alias("keys")),
    )
    listed = stored.select("measurement", "category", "cardinality", "points_per_collection", F.inline(both))
    return listed.select("measurement", "category", "cardinality", "points_per_collection", "role", F.inline("keys"))


# ---- pseudonyms -----------------------------------------------------------------------------


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.lit("hostname").alias("category"), F.col("c_name").alias("original"),
        F.col("c_custkey").alias("position"), F.lit(0).cast("bigint").alias("place"),
    )
    segments = table(spark, sf_dir, "customer").select(
        F.lit("peer_group").alias("category"), F.col("c_mktsegment").alias("original"),
        F.col("c_custkey").alias("position"), F.lit(1).cast("bigint").alias("place"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lit("mac").alias("category"), F.col("s_name").alias("original"),
        F.col("s_suppkey").alias("position"), F.lit(0).cast("bigint").alias("place"),
    )
    serials = table(spark, sf_dir, "orders").select(
        F.lit("serial").alias("category"), F.concat(F.lit("00"), F.col("o_custkey")).alias("original"),
        F.col("o_orderkey").alias("position"), F.lit(0).cast("bigint").alias("place"),
    )
    return customers.unionByName(segments).unionByName(suppliers).unionByName(serials)


DICTIONARY = """n as (select 'hostname' as category, c_name as original, min(c_custkey) as p from customer group by 2
    union all select 'peer_group', c_mktsegment, min(c_custkey) from customer group by 2
    union all select 'mac', s_name, min(s_suppkey) from supplier group by 2
    union all select 'serial', '00' || cast(o_custkey as varchar), min(o_orderkey) from orders group by 2),
  d as (select category, original, row_number() over (partition by category order by p, original) as number from n),
  s as (select *, case category when 'hostname' then 'firewall-' || case when number < 10 then '0' else '' end || cast(number as varchar)
      when 'peer_group' then 'peer-group-' || lpad(cast(number as varchar), 2, '0')
      when 'serial' then '100000' || case when number < 100000 then lpad(cast(number as varchar), 5, '0') else cast(number as varchar) end
      else '00:00:5e:00:' || lpad(lower(to_hex(1 + number // 256)), 2, '0') || ':' || lpad(lower(to_hex(number % 256)), 2, '0') end as surrogate from d)"""


@query("x1_dictionary", f"with {DICTIONARY} select category, original, number, surrogate from s")
def x1_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.dictionary(_names(spark, sf_dir))


@query("x1_incremental_dictionary", f"""with n as (select c_name as original, min(c_custkey) as p, max(c_custkey % 2) as late from customer group by 1),
        d as (select original, row_number() over (order by late, p, original) as number from n)
        select 'hostname' as category, original, number, 'firewall-' || case when number < 10 then '0' else '' end || cast(number as varchar) as surrogate from d""")
def x1_incremental_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir).filter("category = 'hostname'")
    first = pseudonyms.dictionary(names.filter("position % 2 = 0"))
    return pseudonyms.dictionary(names, first)


@query(
    "x2_documentation_ip",
    """select o_orderkey, case when o_orderkey < 254 then '192.0.2.' || cast(o_orderkey + 1 as varchar) when o_orderkey < 508 then '198.51.100.' || cast(o_orderkey - 253 as varchar)
         when o_orderkey < 762 then '203.0.113.' || cast(o_orderkey - 507 as varchar) when o_orderkey < 65535 then '198.18.' || cast((o_orderkey + 1) // 256 as varchar) || '.' || cast((o_orderkey + 1) % 256 as varchar)
         else '240.' || cast((o_orderkey + 1) // 65536 as varchar) || '.' || cast((o_orderkey + 1) // 256 % 256 as varchar) || '.' || cast((o_orderkey + 1) % 256 as varchar) end as ip from orders""",
)
def x2_documentation_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", netaddr.documentation_ip(F.col("o_orderkey") + 1).alias("ip"))


IP_TEXT = """case o_orderkey % 8 when 0 then concat('10.', o_custkey % 300, '.0.1') when 1 then concat('172.', o_custkey % 40, '.3.4') when 2 then concat('192.168.1.', o_custkey % 200)
    when 3 then '169.254.7.7' when 4 then '127.0.0.1' when 5 then '2001:db8::1' when 6 then concat('8.8.', o_custkey % 256, '.8') else concat(o_custkey % 256, '.1.1.1') end"""


@query(
    "x3_ip_class",
    """with t as (select o_orderkey, o_orderkey % 8 as m, o_custkey as c from orders)
       select o_orderkey, case when m = 0 then case when c % 300 > 255 then 'untouched' else 'private' end when m = 1 then case when c % 40 between 16 and 31 then 'private' when c % 40 = 0 then 'public' else 'public' end
         when m in (2, 3) then 'private' when m in (4, 5) then 'untouched' when m = 6 then 'public'
         else case when c % 256 in (0, 127, 255) then 'untouched' when c % 256 = 10 then 'private' else 'public' end end as class from t""",
)
def x3_ip_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", netaddr.ip_class(F.expr(IP_TEXT)).alias("class"))


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One occurrence per order, cycling through keys, contexts and values."""
    pick = """element_at(array({}), cast(o_orderkey % 20 + 1 as int))"""
    keys = "'hostname','serial','mac','ip','peerGroup','incomingUpdatePrefixFilterList','peer-name','name','gw','name','name','fwd','x','x','serial','local-as','dev','p1','vr1','state'"
    contexts = "'','','','','','','','vpn_tunnel','vpn_tunnel','gp_gateway','gp_portal','','','','','','','','',''"
    parents = "'a','a','a','a','a','a','a','a','a','a','a','a','a','a','a','a','system','bgp_peer_status','routing_table','a'"
    roles = "'text','text','text','text','text','text','text','text','text','text','text','text','text','text','number','number','key','key','key','text'"
    value = """case o_orderkey % 20 when 11 then concat('vlan:', o_custkey) when 12 then 'a0:b1:c2:d3:e4:f5' when 13 then concat('at 8.8.8.', o_custkey % 256)
       when 19 then 'N/A' else cast(o_custkey as string) end"""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("position"), F.lit(0).cast("bigint").alias("place"),
        F.expr(pick.format(roles)).alias("role"), F.expr(pick.format(keys)).alias("key"),
        F.expr(pick.format(parents)).alias("parent"), F.expr(pick.format(contexts)).alias("context"),
        F.lit(1).alias("depth"), F.expr(value).alias("value"),
    )


CATEGORIES = "'hostname','serial','mac','ip','peer_group','route_filter','bgp_peer','vpn_tunnel','ike_gateway','gp_gateway','gp_portal','vlan_name','mac','ip','serial',{asn},'hostname','bgp_peer','logical_router',null"


@query("x4_categories", f"select o_orderkey as position, [{CATEGORIES.format(asn='null')}][o_orderkey % 20 + 1] as category from orders")
def x4_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occurrences(spark, sf_dir).select("position", pseudonyms.category("standard").alias("category"))


@query(
    "x5_key_categories",
    """select o_orderkey as position, ['hostname', 'bgp_peer', 'logical_router'][o_orderkey % 20 - 15] as category from orders where o_orderkey % 20 between 16 and 18""",
)
def x5_key_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _occurrences(spark, sf_dir).filter("role = 'key'")
    return keys.select("position", pseudonyms.category("paranoid").alias("category"))


@query(
    "x7_levels",
    f"""select 'paranoid' as level, c as category, count(*) as n from (select [{CATEGORIES.format(asn="'asn'")}][o_orderkey % 20 + 1] as c from orders) where c is not null group by c
        union all select 'minimal', c, count(*) from (select [{CATEGORIES.format(asn='null')}][o_orderkey % 20 + 1] as c from orders) where c is not null and c not in ('mac', 'route_filter', 'vlan_name', 'logical_router') group by c""",
)
def x7_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _occurrences(spark, sf_dir)
    out = None
    for level in ("minimal", "paranoid"):
        counted = (
            rows.select(pseudonyms.category(level).alias("category"))
            .filter("category is not null")
            .groupBy("category")
            .agg(F.count("*").alias("n"))
            .withColumn("level", F.lit(level))
        )
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "x9_placeholders",
    "select c_custkey, c_custkey % 6 = 5 as replaced from customer",
)
def x9_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("text").alias("role"), F.lit("hostname").alias("key"), F.lit("a").alias("parent"), F.lit("").alias("context"),
        F.lit(3).alias("depth"), F.expr("element_at(array('', 'unknown', 'N/A', 'none', 'null', c_name), cast(c_custkey % 6 + 1 as int))").alias("value"),
    )
    return rows.select("c_custkey", pseudonyms.category().isNotNull().alias("replaced"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("position"), F.lit(0).cast("bigint").alias("place"), F.lit("text").alias("role"),
        F.lit("note").alias("key"), F.lit("a").alias("parent"), F.lit("").alias("context"), F.lit(1).alias("depth"),
        F.col("text").alias("value"),
    )


IP = "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}"
TEXT_IPS = f"""f as (select doc_id, unnest(regexp_extract_all(text, '{IP}')) as ip, unnest(range(len(regexp_extract_all(text, '{IP}')))) as piece from documents),
  o as (select *, [cast(x as integer) for x in string_split(ip, '.')] as q from f),
  c as (select *, case when greatest(q[1], q[2], q[3], q[4]) > 255 or q[1] in (0, 127, 255) or regexp_matches(ip, '(^|\\.)0[0-9]') then null
      when q[1] = 10 or (q[1] = 172 and q[2] between 16 and 31) or (q[1] = 192 and q[2] = 168) or (q[1] = 169 and q[2] = 254) then 'private_ip' else 'public_ip' end as category from o),
  seen as (select category, ip, min(doc_id) as p from c where category is not null group by 1, 2),
  numbered as (select *, row_number() over (partition by category order by p, ip) as number from seen),
  named as (select category, ip, number, case when category = 'private_ip' then '10.' || cast(number // 256 % 256 as varchar) || '.' || cast(number % 256 as varchar) || '.' || cast(number * 7 % 256 as varchar)
      when number <= 254 then '192.0.2.' || cast(number as varchar) when number <= 508 then '198.51.100.' || cast(number - 254 as varchar)
      when number <= 762 then '203.0.113.' || cast(number - 508 as varchar) else '198.18.' || cast(number // 256 as varchar) || '.' || cast(number % 256 as varchar) end as surrogate from numbered)"""


@query("j8_address_dictionary", f"with {TEXT_IPS} select category, ip as original, number, surrogate from named")
def j8_address_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.dictionary(pseudonyms.identifiers(_texts(spark, sf_dir)))


@query(
    "x6_compound_text",
    f"""with {TEXT_IPS}, parts as (select doc_id, unnest(string_split_regex(text, '{IP}')) as before, unnest(range(len(string_split_regex(text, '{IP}')))) as piece from documents where regexp_matches(text, '{IP}')),
        joined as (select p.doc_id, p.piece, p.before || coalesce(n.surrogate, c.ip, '') as t, n.surrogate is not null as changed
                   from parts p left join c on c.doc_id = p.doc_id and c.piece = p.piece left join named n on n.category = c.category and n.ip = c.ip)
        select doc_id as position, md5(string_agg(t, '' order by piece)) as text_md5 from joined group by doc_id having bool_or(changed)""",
)
def x6_compound_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pseudonyms.identifiers(_texts(spark, sf_dir))
    replaced = pseudonyms.replaced_texts(pieces, pseudonyms.dictionary(pieces))
    return replaced.select("position", F.md5("text").alias("text_md5"))


@query(
    "j8_substitution",
    f"""with {DICTIONARY} select c_custkey, case when c_custkey % 5 = 0 then c_name else s.surrogate end as name from customer join s on s.category = 'hostname' and s.original = c_name""",
)
def j8_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = pseudonyms.dictionary(_names(spark, sf_dir))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    kind = F.expr("if(c_custkey % 5 = 0, 'serial', 'hostname')")
    return joins.substituted(rows, mapping, "name", kind).select("c_custkey", "name")


@query(
    "a15_mapping_counts",
    f"""with {DICTIONARY} select category, count(*) as "values" from s group by 1 union all select 'total', count(*) from s""",
)
def a15_mapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.mapping_counts(pseudonyms.dictionary(_names(spark, sf_dir)))


@query(
    "x_documents",
    f"""with n as (select '10.9.' || cast(c_nationkey as varchar) || '.1' as ip, min(c_custkey) as p from customer group by 1),
        d as (select ip, row_number() over (order by p, ip) as k from n), h as (select c_custkey, row_number() over (order by c_custkey) as k from customer),
        r as (select c_custkey, h.k as hk, d.k as dk, c_mktsegment from customer join h using (c_custkey) join d on ip = '10.9.' || cast(c_nationkey as varchar) || '.1')
        select c_custkey as position, '{{"system": {{"firewall-' || case when hk < 10 then '0' else '' end || cast(hk as varchar) || '": {{"data": {{"mgmt-ip": "10.0.' || cast(dk as varchar) || '.' || cast(dk * 7 % 256 as varchar)
          || '/24", "list": [1, "' || c_mktsegment || '"], "up": true, "serial": "N/A"}}}}}}}}' as text from r""",
)
def x_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.expr(
        """concat('{"system":{"dev-', c_custkey, '":{"data":{"mgmt-ip":"10.9.', c_nationkey, '.1/24","list":[1,"', c_mktsegment, '"],"up":true,"serial":"N/A"}}}}')"""
    )
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), doc.alias("doc"))
    out, _ = pseudonyms.pseudonymised(docs, "doc")
    return out


@query("x8_mapping_export", f"with {DICTIONARY} select category, original, surrogate from s")
def x8_mapping_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "mapping")
    pseudonyms.mapping_export(pseudonyms.dictionary(_names(spark, sf_dir)), path)
    return spark.read.schema("original string, surrogate string, category string").json(path)


# ---- command output -------------------------------------------------------------------------


def _order_text(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", F.expr(expression).alias("text"))


@query(
    "p09_process_summary",
    """with o as (select *, cast(o_custkey % 100 as double) as c, cast(o_orderkey % 24 as double) as h from orders where o_orderkey % 11 <> 0)
       select o_orderkey, o_custkey % 30 as uptime_days, o_orderkey % 24 as uptime_hours, o_custkey % 50 + 10 as uptime_minutes, c / 4 as load_average_1min, h / 2 as load_average_5min, h as load_average_15min,
         o_custkey as tasks_total, o_orderkey % 24 as tasks_running, o_custkey as tasks_sleeping, cast(3 as bigint) as tasks_stopped, cast(5 as bigint) as tasks_zombie,
         c as cpu_user, h as cpu_system, 0.25::double as cpu_nice, 100.0::double - c as cpu_idle, h / 4 as cpu_iowait, 0.75::double as cpu_hardware_interrupt, 2.5::double as cpu_software_interrupt, 0.5::double as cpu_steal,
         32000.0::double as memory_total_mib, h * 10 as memory_free_mib, c * 100 as memory_used_mib, 250.5::double as memory_buff_cache_mib,
         cast(o_custkey % 3 * 1000 as double) as swap_total_mib, h / 8 as swap_free_mib, c as swap_used_mib, h * 100 as memory_available_mib,
         c * 100 / 32000.0::double * 100 as memory_usage_percent, case when o_custkey % 3 = 0 then 0.0::double else c / cast(o_custkey % 3 * 1000 as double) * 100 end as swap_usage_percent from o""",
)
def p09_process_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, h = "cast(o_custkey % 100 as double)", "cast(o_orderkey % 24 as double)"
    text = rf"""if(o_orderkey % 11 = 0, 'top\nnothing more', concat('\ntop - 08:00:01 up ', o_custkey % 30, ' days,  ', o_orderkey % 24, ':', o_custkey % 50 + 10, ',  12 users,  load average: ', {c} / 4, ', ', {h} / 2, ', ', {h}, '\nTasks: ',
        o_custkey, ' total,   ', o_orderkey % 24, ' running, ', o_custkey, ' sleeping,   3 stopped,   5 zombie\n%Cpu(s):  ', {c}, ' us, ', {h}, ' sy,  0.25 ni, ', 100 - {c}, ' id,  ', {h} / 4, ' wa,  0.75 hi,  2.5 si,  0.5 st\n',
        'MiB Mem :  32000.0 total,    ', {h} * 10, ' free,   ', {c} * 100, ' used,  250.5 buff/cache\nMiB Swap:   ', cast(o_custkey % 3 * 1000 as double), ' total,   ', {h} / 8, ' free,      ', {c}, ' used.   ', {h} * 100, ' avail Mem\n'))"""
    return textparse.process_summary(_order_text(spark, sf_dir, text), F.col("text"), ["o_orderkey"])


@query(
    "p10_disk_table",
    """select o_orderkey, '/' as mount_point, 'tmpfs' as device, cast(o_custkey as varchar) || 'M' as size, '1G' as used, '2G' as available, cast(o_custkey % 100 as varchar) as use_percent from orders
       union all select o_orderkey, '/data', '/dev/sda' || cast(o_custkey as varchar), '20G', '15G', '5G', '75' from orders where o_orderkey % 2 = 0""",
)
def p10_disk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"""concat('Filesystem  Size Used Avail Use% Mounted on\n/dev/root 12G 9G 3G 80% /\n', if(o_orderkey % 2 = 0, concat('/dev/sda', o_custkey, '   20G  15G   5G  75% /data\n'), 'short line\n'),
        'tmpfs ', o_custkey, 'M 1G 2G ', o_custkey % 100, '% / extra\n')"""
    return textparse.disk_table(_order_text(spark, sf_dir, text), F.col("text"), ["o_orderkey"])


@query(
    "p10b_disk_entries",
    """select c_custkey, '/' as mount_point, coalesce(case when c_custkey % 2 = 0 then c_name end, 'N/A') as device, '12G' as size, 'N/A' as used, 'N/A' as available, cast(c_nationkey as varchar) as use_percent from customer where c_custkey % 3 > 0
       union all select c_custkey, 'unknown', 'N/A', 'N/A', '1G', 'N/A', 'N/A' from customer where c_custkey % 3 <> 1""",
)
def p10b_disk_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.operators.nested import explode_entries

    doc = F.expr(
        """parse_json(concat('{"disk-space":{"entry":', case c_custkey % 3 when 0 then '{"used":"1G"}'
             when 1 then concat('{"mount-point":"/",', if(c_custkey % 2 = 0, concat('"device":"', c_name, '",'), ''), '"size":"12G","use-percent":"', c_nationkey, '"}')
             else concat('[{"mount-point":"/",', if(c_custkey % 2 = 0, concat('"device":"', c_name, '",'), ''), '"size":"12G","use-percent":"', c_nationkey, '"},{"used":"0G"},{"used":"1G"}]') end, '}}'))"""
    )
    docs = table(spark, sf_dir, "customer").select("c_custkey", doc.alias("doc"))
    return textparse.disk_entries(explode_entries(docs, casts.leaf("doc", "disk-space", "entry")), "entry", ["c_custkey"])


@query(
    "p11_uptime",
    """select o_orderkey, case o_orderkey % 5 when 0 then o_custkey % 40 * 86400 + o_custkey % 24 * 3600 + 189 when 1 then o_custkey % 24 * 3600 + 189 when 2 then 86400 + 79389 else 0 end as seconds from orders""",
)
def p11_uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "case o_orderkey % 5 when 0 then concat(o_custkey % 40, ' days, ', o_custkey % 24, ':03:09') when 1 then concat(o_custkey % 24, ':03:09') when 2 then '1 day, 22:03:09' when 3 then 'up' end"
    return _order_text(spark, sf_dir, text).select("o_orderkey", textparse.uptime_seconds(F.col("text")).alias("seconds"))


@query(
    "p12_named_numbers",
    """select o_orderkey, 'opened' as counter, o_custkey as value from orders union all select o_orderkey, 'a : b', cast(7 as bigint) from orders""",
)
def p12_named_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"""concat('Counters\nopened   :   1\n\n  a : b: 7  \nbad : 1.5\nopened:', o_custkey, '\nempty :\n')"""
    return textparse.named_numbers(_order_text(spark, sf_dir, text), F.col("text"), ["o_orderkey"])


@query(
    "p12_document_numbers",
    r"""with l as (select doc_id, unnest(string_split(regexp_replace(text, '^\s+|\s+\z', '', 'g'), chr(10))) as line, unnest(range(len(string_split(regexp_replace(text, '^\s+|\s+\z', '', 'g'), chr(10))))) as n from documents),
        w as (select doc_id, n, regexp_extract_all(line, '[0-9]+') as nums, length(line) as len from l)
        select doc_id, arg_max(len, n) as value from w group by doc_id""",
)
def p12_document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents"), "doc_id").withColumn(
        "text",
        F.array_join(
            F.transform(F.split(F.regexp_replace("text", r"^\s+|\s+\z", ""), "\n"), lambda line: F.concat(F.lit("length : "), F.length(line).cast("string"))),
            "\n",
        ),
    )
    return textparse.named_numbers(rows, F.col("text"), ["doc_id"]).select("doc_id", "value")


@query(
    "p13_portal_messages",
    """select o_orderkey, o_custkey as total_messages_dp_to_mp, cast(0 as bigint) as total_invalid_messages_dp_to_mp, case when o_orderkey % 2 = 0 then 3 else 0 end as failed_to_read_messages_dp_to_mp from orders""",
)
def p13_portal_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"""concat('\n Total messages DP => MP : 1\nTotal messages DP => MP: ', o_custkey, if(o_orderkey % 2 = 0, '\nFailed to read messages DP => MP:3', ''), '\nother: 9\n')"""
    return textparse.portal_messages(_order_text(spark, sf_dir, text), F.col("text"), ["o_orderkey"]).withColumn(
        "failed_to_read_messages_dp_to_mp", F.col("failed_to_read_messages_dp_to_mp").cast("int")
    )


@query(
    "p14_portal_summary",
    """select o_orderkey, 'portal-' || cast(o_custkey as varchar) as name, o_custkey as v_int, cast(null as varchar) as v_str from orders
       union all select o_orderkey, 'other', null, 'N/A' from orders""",
)
def p14_portal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"""concat('Portal: successful\nportal-', o_custkey, ' : ', o_custkey, '\n\nother: N/A\nnothing here\n')"""
    rows = textparse.portal_summary(_order_text(spark, sf_dir, text), F.col("text"), ["o_orderkey"])
    return rows.select("o_orderkey", "name", "value.v_int", "value.v_str")


@query(
    "p15_gateway_text",
    """select o_orderkey, cast(1 as bigint) as gateway_no, 'gw-' || cast(o_custkey as varchar) as name, cast(o_custkey % 9 as varchar) as current_users, '0' as previous_users, '5' as current_user,
         '12' as record_gateway_tunnel_count, '77' as record_gateway_tunnel_count_last_check_time from orders
       union all select o_orderkey, 2, '', '0', '4', null, null, null from orders where o_orderkey % 2 = 0""",
)
def p15_gateway_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"""concat('head <Gateway>\n<name>gw-', o_custkey, '</name><CurrentUsers>', o_custkey % 9, '</CurrentUsers></Gateway>\ncurrent-user: 5\n\trecord-gateway-tunnel-count : 12\nrecord-gateway-tunnel-count-last-check-time: 77\n',
        if(o_orderkey % 2 = 0, '<Gateway><PreviousUsers>4</PreviousUsers></Gateway>\n', '<Gateway>unfinished'))"""
    rows = textparse.gateway_summary_text(_order_text(spark, sf_dir, text), F.col("text"), ["o_orderkey"])
    return rows.select(
        "o_orderkey", F.col("gateway_no").cast("bigint").alias("gateway_no"), "name", "current_users", "previous_users", "current_user",
        "record_gateway_tunnel_count", "record_gateway_tunnel_count_last_check_time",
    )


@query(
    "p15_gateway_entries",
    """select c_custkey, cast(0 as bigint) as gateway_no, 'a' || cast(c_custkey as varchar) as name, '3' as current_users, cast(c_nationkey as varchar) as current_user, '10/s' as gateway_max_tunnel_setup_rate from customer
       union all select c_custkey, 1, 'b', '0', case when c_custkey % 2 = 0 then '8' end, null from customer""",
)
def p15_gateway_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr("parse_json(concat('[{\"name\":\"a', c_custkey, '\",\"CurrentUsers\":3},{\"name\":\"b\"}]'))").alias("doc"),
        F.expr(r"concat('\n current-user: ', c_nationkey, '\n  gateway-max-tunnel-setup-rate: 10/s\n', if(c_custkey % 2 = 0, '\n \t\ncurrent-user:8\n', ''))").alias("text"),
    )
    out = textparse.gateway_summary_entries(rows, F.expr(casts.objects_of("doc")), F.col("text"), ["c_custkey"])
    return out.select(
        "c_custkey", F.col("gateway_no").cast("bigint").alias("gateway_no"), "name", "current_users", "current_user", "gateway_max_tunnel_setup_rate"
    )


@query(
    "p15b_gateway_users",
    """select c_custkey, cast(sum(v) as bigint) as total_current_users from (select c_custkey, c_nationkey as v from customer union all select c_custkey, 5 from customer where c_custkey % 2 = 1) group by 1""",
)
def p15b_gateway_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.operators.nested import explode_entries

    doc = F.expr(
        """parse_json(concat('{"Gateway":', if(c_custkey % 2 = 0, concat('{"CurrentUsers":"', c_nationkey, '"}'), concat('[{"CurrentUsers":"', c_nationkey, '"},{"CurrentUsers":5},{"CurrentUsers":"N/A"}]')), '}'))"""
    )
    docs = table(spark, sf_dir, "customer").select("c_custkey", doc.alias("doc"))
    entries = explode_entries(docs, casts.leaf("doc", "Gateway"))
    return entries.groupBy("c_custkey").agg(F.sum(F.expr(casts.int_of_leaf(casts.leaf("entry", "CurrentUsers")))).alias("total_current_users"))


# ---- user hooks -----------------------------------------------------------------------------


def _total(record: dict) -> str:
    if record["event_type"] == "error":
        raise ValueError("no answer")
    return str(record["event_id"] * 2)


@query(
    "e1_per_envelope",
    """select event_id, event_type <> 'error' as success, case when event_type <> 'error' then cast(event_id * 2 as varchar) end as data,
       case when event_type = 'error' then 'ValueError: no answer' end as error from events""",
)
def e1_per_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return hooks.per_envelope(rows, _total, ["event_id"])


@query(
    "e2_sql_functions",
    r"""select p_partkey, case when p_partkey % 2 = 0 then p_partkey end as n, p_type = 'ECONOMY' as flag, replace(p_name, ' ', '\ ') as escaped, replace(replace(p_brand, '#', '_'), ' ', '_') as safe,
        'e' || lpad(cast(length(cast(p_size as varchar)) as varchar), 10, '0') || cast(p_size as varchar) as sort_key,
        cast(cast(p_size as varchar) || '.62' as double) as two_places, cast(p_size as double) as gb, cast(p_size as double) / 2 as share, case when p_size % 2 = 0 then 'bgp' else 'ospf_inter' end as protocol,
        '10.0.0.' || cast(p_size as varchar) as address, round(cast(p_size as double) / 50 * 100, 2) as remaining,
        case when p_size <= 254 then '192.0.2.' || cast(p_size as varchar) end as surrogate, '"' || p_brand || '"' as literal,
        'm,brand=' || replace(p_brand, ' ', '\ ') || ' half=' || cast(cast(p_size as double) / 2 as varchar) || ',size=' || cast(p_size as varchar) || 'i ' || cast(p_partkey as varchar) as line from part""",
)
def e2_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hooks.register_sql_functions(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("fleet_part")
    field = "named_struct('v_bool', cast(null as boolean), 'v_int', {}, 'v_dbl', {}, 'v_str', {})"
    size = field.format("cast(p_size as bigint)", "cast(null as double)", "cast(null as string)")
    half = field.format("cast(null as bigint)", "p_size / 2", "cast(null as string)")
    brand = field.format("cast(null as bigint)", "cast(null as double)", "p_brand")
    return spark.sql(
        f"""select p_partkey, fleet_safe_int(if(p_partkey % 2 = 0, concat(' ', p_partkey), concat(p_partkey, 'd'))) as n, coalesce(fleet_yes_no(if(p_type = 'ECONOMY', 'yes', 'no')), false) as flag,
                  fleet_escape_key(p_name) as escaped, fleet_safe_key(p_brand) as safe, fleet_natural_key(concat('e00', p_size)) as sort_key,
                  fleet_safe_float(concat(p_size, '.625')) as two_places, fleet_size_gb(concat(p_size, 'G')) as gb, fleet_percent(concat(p_size / 2, '%')) as share,
                  fleet_route_protocol(if(p_size % 2 = 0, '', ' OSPF inter'), 'AB') as protocol, fleet_identity_ip(concat('gw(ipaddr:10.0.0.', p_size, ')')) as address,
                  fleet_remaining_percent(p_size, 50) as remaining, fleet_documentation_ip(p_size) as surrogate, fleet_field_literal({brand}) as literal,
                  fleet_line('m', map('brand', p_brand), map('size', {size}, 'half', {half}), p_partkey) as line from fleet_part"""
    )
