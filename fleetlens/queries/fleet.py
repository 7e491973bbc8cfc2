"""Filters, joins, counts, rankings and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import casts, display, naming, netaddr
from fleetlens.operators import filters, joins, project, rank, rollup
from fleetlens.plans.ticks import polls, spread, table
from fleetlens.queries import query
from fleetlens.sources import snapshots

POLLS = """polls as (
  select user_id as device, event_type as iface, epoch_us(ts) as ts_us, event_id,
         cast(round(value * 100) as bigint) as octets from events)"""

# ---- filters --------------------------------------------------------------------------------


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("collected_at"),
        F.col("event_type").alias("module"),
        F.col("user_id").alias("device"),
        F.when(F.col("event_type") == "error", False).when(F.col("event_id") % 40 != 0, True).alias("success"),
        F.when(F.col("value") > 10, F.concat(F.lit("code "), F.col("event_id"))).alias("error"),
        "event_id",
    )


@query("f01_success_filter", "select event_id from events where event_type <> 'error' and event_id % 40 <> 0")
def f01_success_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.succeeded(_envelopes(spark, sf_dir)).select("event_id")


@query(
    "f01_failures",
    """select event_type as module, user_id as device, case when value > 10 then 'code ' || cast(event_id as varchar) else 'Unknown error' end as error
       from events where event_type = 'error' or event_id % 40 = 0""",
)
def f01_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.failed(_envelopes(spark, sf_dir)).drop("collected_at")


@query("f02_presence", "select event_id, event_id % 6 > 3 as present from events")
def f02_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.expr(
        """parse_json(element_at(array('{}', '{"a":null}', '{"a":{}}', '{"a":""}', concat('{"a":', value, '}'), concat('{"a":', props, '}')),
           cast(event_id % 6 + 1 as int)))"""
    )
    docs = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return docs.select("event_id", F.expr(casts.present(casts.leaf("doc", "a"))).alias("present"))


COLLECTION_RULES = """select * from (values
    ('BUILDING', null, null, false), ('MACHINERY', null, '3', false), ('MACHINERY', null, '4', true),
    ('HOUSEHOLD', 'c1', null, false), ('HOUSEHOLD', 'c1', '7', true), ('FURNITURE', 'c2', '9', false)
  ) as t(module, collection, device, enabled)"""


@query(
    "f04_collection_toggle",
    """with c as (select c_custkey, c_mktsegment as m, 'c' || cast(c_custkey % 3 as varchar) as c, cast(c_nationkey as varchar) as d from customer)
       select c_custkey from c where m <> 'BUILDING' and not (m = 'MACHINERY' and d = '3')
         and not (m = 'HOUSEHOLD' and c = 'c1' and d <> '7') and not (m = 'FURNITURE' and c = 'c2' and d = '9')""",
)
def f04_collection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("m"), F.concat(F.lit("c"), F.col("c_custkey") % 3).alias("c"),
        F.col("c_nationkey").cast("string").alias("d"),
    )
    return filters.collectable(rows, spark.sql(COLLECTION_RULES), "m", "c", "d").select("c_custkey")


FLAG = """case c_custkey % 7 when 0 then 'true' when 1 then 'FALSE' when 2 then 'Yes' when 3 then ' on ' when 4 then '1'
          when 5 then 'off' end"""


@query("f05_enabled_devices", "select c_custkey from customer where c_custkey % 7 not in (1, 5)")
def f05_enabled_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.enabled_devices(table(spark, sf_dir, "customer"), f"({FLAG})").select("c_custkey")


@query("f06_device_subset", "select event_id, user_id from events where user_id in (3, 5, 8, 13, 21)")
def f06_device_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.only_devices(table(spark, sf_dir, "events"), "user_id", [3, 5, 8, 13, 21, -1]).select("event_id", "user_id")


@query("f07_up_only", "select o_orderkey from orders where o_orderkey % 3 = 0 or (o_orderkey % 3 = 1 and o_custkey % 2 = 0)")
def f07_up_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr(
        "case o_orderkey % 3 when 0 then concat('10000/full/UP', o_custkey) when 1 then if(o_custkey % 2 = 0, 'Up', 'down') end"
    )
    return table(spark, sf_dir, "orders").filter(filters.is_up(status)).select("o_orderkey")


def _quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr("concat(c_custkey % 300, '.', c_nationkey, '.0.1')").alias("ip"),
        F.expr("case c_custkey % 4 when 0 then '::1' when 1 then '2001:db8::a' when 2 then '1:2:3' else 'gg::1' end").alias("ip6"),
        F.expr("case c_custkey % 4 when 0 then concat('fw-', c_custkey, '.example.com.') when 1 then '-bad' when 2 then '' else repeat('a', 64) end").alias("host"),
        F.expr("cast(c_custkey * 97 as string)").alias("port"),
        F.expr("cast(c_custkey % 400 as string)").alias("timeout"),
        F.expr("case c_custkey % 7 when 0 then concat('ethernet1/', c_custkey) when 1 then 'AE5' when 2 then 'tunnel.9' when 3 then 'vlan.' when 4 then 'all' when 5 then 'loopback.1x' end").alias("iface"),
        F.expr("case c_custkey % 5 when 0 then '2024-05-06T07:08:09' when 1 then '2024-05-06T07:08:09Z' when 2 then '2024-13-06T07:08:09' when 3 then 'yesterday' else '2024-05-06' end").alias("at"),
        "c_acctbal",
    )


def _quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quality_rows(spark, sf_dir)
    return filters.expectations(
        rows,
        ["c_custkey"],
        {
            "ip": filters.is_ip(F.col("ip")),
            "ipv6": filters.is_ip(F.col("ip6")),
            "host": filters.is_hostname(F.col("host")),
            "port": filters.is_port("port"),
            "timeout": filters.is_timeout("timeout"),
            "interface": filters.is_interface(F.col("iface")),
            "time": filters.is_timestamp(F.col("at")),
            "balance": filters.is_between("c_acctbal", 0.0, 5000.0),
        },
    )


QUALITY = """with q as (select c_custkey as k, c_custkey % 4 as m4, c_custkey % 5 as m5, c_custkey % 7 as m7, * from customer),
  c as (
    select k, 'ip' as rule, k % 300 > 255 as violated from q
    union all select k, 'ipv6', m4 > 1 from q
    union all select k, 'host', m4 <> 0 from q
    union all select k, 'port', not (k * 97 between 1 and 65535) from q
    union all select k, 'timeout', not (k % 400 between 1 and 300) from q
    union all select k, 'interface', m7 not in (0, 1, 2, 4) from q
    union all select k, 'time', m5 in (2, 3) from q
    union all select k, 'balance', not (c_acctbal between 0 and 5000) from q)"""


@query("f08_expectations", f"{QUALITY} select k as c_custkey, rule, violated from c")
def f08_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality_checks(spark, sf_dir)


@query(
    "f08_pass_ratio",
    f"""{QUALITY} select rule, count(*) as checked, count(*) filter (where violated) as violations,
        cast(count(*) filter (where not violated) as double) / count(*) as passed_share from c group by rule""",
)
def f08_pass_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.pass_ratio(_quality_checks(spark, sf_dir))


@query(
    "f08_envelope_rules",
    """select event_id, 'success_present' as rule, event_id % 4 = 0 as violated from events
       union all select event_id, 'success_boolean', event_id % 4 = 1 from events
       union all select event_id, 'timestamp_valid', event_id % 4 = 2 from events""",
)
def f08_envelope_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.expr(
        """parse_json(case event_id % 4 when 0 then '{"data":1}' when 1 then '{"success":"true"}' when 2 then '{"success":true,"timestamp":"now"}'
           else concat('{"success":false,"timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '"}') end)"""
    )
    docs = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return filters.expectations(docs, ["event_id"], filters.envelope_rules(F.col("doc")))


SECRET = r"(?i)(password|api[_-]?key|token|secret|auth)\s*[:=]\s*\S+"


@query("f09_sensitive_text", f"select doc_id from documents where not regexp_matches(text, '{SECRET}')")
def f09_sensitive_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id").filter(~naming.is_sensitive(F.col("text"))).select("doc_id")


@query(
    "p24_mask_secrets",
    r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text,
          '(?i)(api[_-]?key\s*[:=]\s*)(\S{4})(\S+)(\S{4})', '\1\2***\4', 'g'), '(?i)(password\s*[:=]\s*)(\S+)', '\1***', 'g'),
          '(?i)(token\s*[:=]\s*)(\S{4})(\S+)', '\1\2***', 'g')) as masked_md5 from documents""",
)
def p24_mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.md5(naming.masked(F.col("text"))).alias("masked_md5"))


# ---- joins ----------------------------------------------------------------------------------


@query(
    "j1_hostname",
    """select c_custkey, coalesce(case when c_custkey % 3 = 0 then nullif(case when c_custkey % 2 = 0 then '' else c_name end, '') end,
            n_name, r_name, 'dev-' || cast(c_custkey as varchar)) as hostname
       from customer left join (select * from nation where n_nationkey % 2 = 0) n on n_nationkey = c_nationkey
            left join (select * from region where r_regionkey < 3) r on r_regionkey = c_nationkey % 5""",
)
def j1_hostname(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    region = table(spark, sf_dir, "region").filter("r_regionkey < 3")
    devices = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(region, F.col("r_regionkey") == F.expr("c_nationkey % 5"), "left")
        .select(
            "c_custkey",
            F.lit(None).cast("timestamp").alias("collected_at"),
            F.concat(F.lit("dev-"), F.col("c_custkey")).alias("device"),
            F.expr("case when c_custkey % 3 = 0 then if(c_custkey % 2 = 0, '', c_name) end").alias("hostname"),
            F.col("n_name"),
            F.col("r_name").alias("data_hostname"),
        )
    )
    hosts = devices.filter("n_name is not null").select("collected_at", "device", F.col("n_name").alias("reported"))
    return joins.resolve_hosts(devices, hosts).select("c_custkey", "hostname")


@query(
    "j1_hostname_landed",
    """select c_custkey as total_flows, coalesce(
            case when c_custkey % 3 = 0 and c_custkey % 2 = 1 then c_name end, case when c_custkey % 5 <> 0 and c_custkey % 7 <> 0 then c_mktsegment end,
            case when c_custkey % 4 = 0 then 'n-' || cast(c_nationkey as varchar) end, 'dev-' || cast(c_custkey as varchar)) as hostname
       from customer""",
)
def j1_hostname_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host names of points whose snapshots resolved them on landing: no join."""
    payload = F.expr(
        """concat('{"system":{"dev-', c_custkey, '":{"success":', if(c_custkey % 5 = 0, '0', 'true'), ',"hostname":null,"data":{"system_info":{"system":{"hostname":"',
           if(c_custkey % 7 = 0, '', c_mktsegment), '"}}}}},"vpn":{"dev-', c_custkey, '":{"success":true',
           if(c_custkey % 3 = 0, concat(',"hostname":"', if(c_custkey % 2 = 0, '', c_name), '"'), ''), ',"data":{',
           if(c_custkey % 4 = 0, concat('"_hostname":"n-', c_nationkey, '",'), ''), '"vpn_flows":{"num_ipsec":1,"total":', c_custkey, '}}}}}')"""
    )
    raw = table(spark, sf_dir, "customer").select(payload.alias("payload"), F.lit(0).cast("timestamp").alias("collected_at"))
    good, _ = snapshots.parsed(raw)
    collections = snapshots.collections(snapshots.envelopes(good))
    points = project.with_hostname(project.points(collections, present={"vpn_flows"}))
    return points.filter("measurement = 'vpn_flows'").select(
        F.col("fields")["total_flows"]["v_int"].alias("total_flows"), F.col("tags")["hostname"].alias("hostname")
    )


@query(
    "j2_interface_dimension",
    """with hw as (select l_partkey as p, arg_max(l_returnflag, pos) as status from
          (select *, l_orderkey * 10 + l_linenumber * 1.0 + l_suppkey / 1000000 + l_extendedprice / 1e12 as pos from lineitem) where l_partkey % 2 = 0 group by 1)
       select o_orderkey, o_custkey, coalesce(status, 'N/A') as status from orders left join hw on p = o_custkey""",
)
def j2_interface_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    ports = table(spark, sf_dir, "lineitem").filter("l_partkey % 2 = 0").select(
        F.col("l_partkey").alias("o_custkey"),
        F.expr("l_orderkey * 10 + l_linenumber * cast(1 as double) + l_suppkey / cast(1000000 as double) + l_extendedprice / cast(1e12 as double)").alias("pos"),
        F.col("l_returnflag").alias("status"),
    )
    logical = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.interface_dimension(logical, ports, ["o_custkey"], "pos", ["status"])


@query(
    "j3_source_merge",
    """with li as (select l_orderkey as k, arg_min(l_quantity, pos) as q, arg_min(l_extendedprice, pos) as p from
          (select *, cast(l_linenumber as bigint) * 1000000000 + l_partkey * 1000 + l_suppkey + l_extendedprice / 1e7 as pos from lineitem) group by 1)
       select o_orderkey, coalesce(case when o_orderkey % 3 <> 0 then o_totalprice end, p) as price,
              coalesce(case when o_orderkey % 2 <> 0 then cast(o_custkey as double) end, q) as quantity
       from orders left join li on k = o_orderkey""",
)
def j3_source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    primary = orders.select(
        "o_orderkey",
        F.lit(0).alias("pos"),
        F.expr("case when o_orderkey % 3 <> 0 then o_totalprice end").alias("price"),
        F.expr("case when o_orderkey % 2 <> 0 then cast(o_custkey as double) end").alias("quantity"),
    )
    secondary = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.expr("l_linenumber * 1000000000L + l_partkey * 1000 + l_suppkey + l_extendedprice / cast(1e7 as double)").alias("pos"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
    )
    return joins.merged_counters(orders.select("o_orderkey"), primary, secondary, ["o_orderkey"], "pos", ["price", "quantity"])


@query(
    "j3_hardware_names",
    """select name, count(*) as entries from (select unnest(list_distinct([c_mktsegment, case when c_custkey % 2 = 0 then c_mktsegment else n end])) as name
         from (select *, case when c_custkey % 3 = 0 then 'port' || cast(c_nationkey as varchar) end as n from customer)) where name is not null group by 1""",
)
def j3_hardware_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_mktsegment").alias("name"),
        F.expr("case when c_custkey % 2 = 0 then c_mktsegment when c_custkey % 3 = 0 then concat('port', c_nationkey) end").alias("interface"),
    )
    return joins.hardware_by_name(entries, "name", "interface").groupBy("name").agg(F.count("*").alias("entries"))


@query(
    "j4_known_selection",
    "select distinct c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')",
)
def j4_known_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.known_selection(table(spark, sf_dir, "customer").select("c_custkey"), known, ["c_custkey"])


@query(
    "j5_positional_zip",
    """select o_orderkey, cast(i as bigint) as pos, 'g' || cast(i as varchar) as entry,
              case when i < o_custkey % 3 then 's' || cast(o_custkey + i as varchar) end as section
       from orders, range(5) t(i) where i <= o_orderkey % 4""",
)
def j5_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.expr("transform(sequence(0, cast(o_orderkey % 4 as int)), i -> concat('g', i))")
    sections = F.expr(
        "if(o_custkey % 3 = 0, cast(array() as array<string>), transform(sequence(0, cast(o_custkey % 3 - 1 as int)), i -> concat('s', o_custkey + i)))"
    )
    zipped = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(joins.zip_by_position(entries, sections)).alias("z"))
    return zipped.select("o_orderkey", F.col("z.pos").cast("bigint").alias("pos"), "z.entry", "z.section")


@query(
    "j6_validity",
    f"""with {POLLS}, n as (select *, case when iface = 'error' then ts_us end as noted_at,
             case when iface = 'error' then octets end as noted from polls),
        s as (select *, last_value(noted_at ignore nulls) over k as cached_at, last_value(noted ignore nulls) over k as held
              from n window k as (partition by device order by ts_us, event_id rows between unbounded preceding and current row))
        select device, event_id, case when ts_us < cached_at + 21600000000 then held end as hostname from s where iface <> 'error'""",
)
def j6_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = polls(spark, sf_dir)
    noted = samples.filter("iface = 'error'").select(
        "device", "ts_us", "event_id", F.col("octets").alias("hostname"), (F.col("ts_us") + 21_600_000_000).alias("until")
    )
    others = samples.filter("iface <> 'error'").select("device", "ts_us", "event_id")
    return joins.valid_lookup(others, noted, "device", "ts_us", "event_id", "hostname", "until").select(
        "device", "event_id", "hostname"
    )


@query(
    "j7_inventory",
    """with o as (select o_custkey, max(o_totalprice) as price, min(o_orderpriority) as priority from orders group by 1)
       select c_custkey, coalesce(price, case when c_custkey % 2 = 0 then c_acctbal end, 443) as port,
              coalesce(priority, c_mktsegment, 'Unknown') as location from customer left join o on o_custkey = c_custkey""",
)
def j7_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("port"), F.min("o_orderpriority").alias("location")
    )
    configured = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("case when c_custkey % 2 = 0 then c_acctbal end").alias("port"), F.col("c_mktsegment").alias("location")
    )
    return joins.inventory(configured, live, "c_custkey", {"port": 443.0, "location": "Unknown"})


# ---- counts ---------------------------------------------------------------------------------


@query(
    "a1_protocol_counts",
    """select user_id as device, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error,
       count(*) filter (where event_type = 'purchase') as purchase, count(*) filter (where event_type = 'signup') as signup,
       count(*) filter (where event_type = 'view') as view, count(*) as routes_total from events group by 1""",
)
def a1_protocol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = table(spark, sf_dir, "events").withColumnRenamed("user_id", "device")
    fields = rollup.protocol_fields(routes, ["device"], F.col("event_type"))
    names = ("click", "error", "purchase", "signup", "view")
    return fields.select(
        "device",
        *[F.coalesce(F.col("routes_by_protocol")[f"routes_{n}"], F.lit(0)).alias(n) for n in names],
        "routes_total",
    )


@query(
    "a1_shown_protocols",
    """with r as (select o_custkey % 10 as vrf, case o_orderkey % 6 when 0 then 'bgp' when 1 then 'static' when 2 then 'connected' else 'x' || cast(o_orderkey % 6 as varchar) end as p from orders)
       select vrf, count(*) as total, count(*) filter (where p = 'bgp') as bgp, count(*) filter (where p = 'static') as static,
              count(*) filter (where p = 'connected') as connected, count(*) filter (where p like 'x%') as other from r group by vrf""",
)
def a1_shown_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.expr("element_at(array('A B', 'A S', 'C', 'O', '?', ''), cast(o_orderkey % 6 + 1 as int))")
    routes = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("vrf"), flags.alias("flags"))
    return rollup.shown_protocols(routes, ["vrf"], rollup.route_protocol(F.lit(None).cast("string"), F.col("flags")))


@query("a2_fallback_totals", "select l_suppkey as device, count(*) as static_routes from lineitem group by 1")
def a2_fallback_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.row_totals(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "device"), ["device"], "static_routes")


@query(
    "a3_category_min5",
    """with big as (select n_name from supplier join nation on s_nationkey = n_nationkey group by 1 having count(*) >= 5)
       select n_name as category, s_name as counter, s_acctbal as value from supplier join nation on s_nationkey = n_nationkey
       where n_name in (select n_name from big)""",
)
def a3_category_min5(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return rollup.category_counters(
        entries.withColumnRenamed("s_acctbal", "value"), [], F.col("n_name"), F.col("s_name"), ["value"], "s_suppkey"
    )


@query(
    "a4_peer_states",
    """select o_orderpriority as device, count(*) as total, count(*) filter (where o_orderstatus = 'F') as established,
       count(*) filter (where o_orderstatus = 'O') as active, count(*) filter (where o_orderstatus = 'P') as inactive,
       count(*) - count(*) filter (where o_orderstatus = 'F' and o_orderkey % 2 = 0) as down from orders group by 1""",
)
def a4_peer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.expr(
        "case o_orderstatus when 'F' then if(o_orderkey % 2 = 0, 'Established', 'ESTABLISHED') when 'O' then 'OpenActive' when 'P' then if(o_orderkey % 2 = 0, 'Idle', null) end"
    )
    peers = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "device")
    return rollup.peer_states(peers, state, ["device"])


@query(
    "a5_csv_mean",
    """select event_id, case when event_id % 5 = 0 then null when event_id % 5 = 1 then null
         else round((user_id + event_id % 100 + 3 * 7) / 3.0::double, 2) end as mean from events""",
)
def a5_csv_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.expr(
        """case event_id % 5 when 0 then concat(user_id, ',x') when 1 then ' , ,'
           else concat(' ', user_id, ', ', event_id % 100, ',,21 ') end"""
    )
    return table(spark, sf_dir, "events").withColumn("packed", packed).select("event_id", F.expr(casts.mean_of_csv("packed")).alias("mean"))


@query(
    "a6_success_ratio",
    """select event_type as module, count(*) filter (where event_type not in ('error') and (event_type = 'view' or event_id % 40 <> 0)) as ok, count(*) as total,
       case when event_type = 'error' then 'none' when event_type = 'view' then 'all' else 'some' end as status from events group by 1""",
)
def a6_success_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "module")
    success = F.expr("case when module = 'error' then false when module = 'view' then true when event_id % 40 <> 0 then true end")
    return rollup.success_ratio(rows, ["module"], success)


@query(
    "a7_conversion_stats",
    """with e as (select event_type as module, event_type <> 'error' and event_id % 40 <> 0 as ok from events),
        s as (select module, count(*) filter (where ok) as lines, count(*) filter (where not ok) as errors from e group by 1)
       select * from s union all select 'all', cast(sum(lines) as bigint), cast(sum(errors) as bigint) from s""",
)
def a7_conversion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _envelopes(spark, sf_dir)
    return rollup.conversion_stats(snapshots.succeeded(rows), snapshots.failed(rows))


@query(
    "a9_points_per_collection",
    """select event_type as measurement, user_id as device, cast(ts as date) as collected_at, count(*) as points from events group by all""",
)
def a9_points_per_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("measurement"), F.col("user_id").alias("device"), F.to_date("ts").alias("collected_at")
    )
    return rollup.points_per_collection(points)


@query(
    "a11_inventory_counts",
    """select c_nationkey as site, count(*) as total, count(*) filter (where c_custkey % 7 not in (1, 5)) as enabled,
       count(*) filter (where c_custkey % 7 in (1, 5)) as disabled from customer group by 1""",
)
def a11_inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "site")
    return rollup.enabled_counts(devices, F.coalesce(F.expr(casts.loose_boolean(f"({FLAG})")), F.lit(True)), ["site"])


@query(
    "a13_core_balance",
    f"""with {POLLS}, c as (select device, iface, ts_us // 86400000000 as day, event_id as core, octets % 100 as load from polls)
        select device, day, max(load) - min(load) as imbalance, cast(sum(load) as double) / count(*) as mean_load,
               arg_min(core, -load * 1000000000 + core) as hottest_core from c group by 1, 2""",
)
def a13_core_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = polls(spark, sf_dir).select(
        "device", F.expr("ts_us div 86400000000").alias("day"), F.col("event_id").alias("core"), (F.col("octets") % 100).alias("load")
    )
    return rollup.core_balance(cores, ["device", "day"], "core", "load")


@query(
    "a14_error_total",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(case when l_partkey % 3 > 0 then l_quantity end, 0) + l_tax as errors from lineitem""",
)
def a14_error_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx = F.expr("case when l_partkey % 3 > 0 then l_quantity end")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rollup.error_total(rx, F.col("l_tax")).alias("errors")
    )


# ---- order, top, sets -----------------------------------------------------------------------


@query(
    "k1_natural_order",
    """select 'if' || rpad(cast(p_partkey + 1 as varchar), 30, '7') || '/' || cast(p_size as varchar) as name,
       'if0000000030' || rpad(cast(p_partkey + 1 as varchar), 30, '7') || '/' || lpad(cast(length(cast(p_size as varchar)) as varchar), 10, '0') || cast(p_size as varchar) as sort_key from part""",
)
def k1_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.expr("concat('if', rpad(p_partkey + 1, 30, '7'), '/', p_size)").alias("name"))
    return rank.in_natural_order(names, "name").select("name", naming.natural_key(F.col("name")).alias("sort_key"))


@query(
    "k1_first_in_natural_order",
    """with p as (select p_brand as device, 'eth' || cast(p_size as varchar) || '/' || cast(p_partkey as varchar) as iface, p_size, p_partkey from part),
       r as (select *, row_number() over (partition by device order by p_size, p_partkey) as place from p)
       select device, iface, place from r where place <= 5""",
)
def k1_first_in_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("device"), F.expr("concat('eth', p_size, '/', p_partkey)").alias("iface")
    )
    first = rank.first_per_group(rows, ["device"], [naming.natural_key(F.col("iface"))], rank.SHOWN_INTERFACES)
    return first.withColumn("place", F.col("place").cast("bigint"))


@query(
    "k2_shown_counters",
    """with c as (select *, dense_rank() over (partition by c_mktsegment order by c_nationkey) as cp from customer),
        r as (select *, row_number() over (partition by c_mktsegment, c_nationkey order by c_custkey) as place from c where cp <= 5)
       select c_mktsegment, c_nationkey, c_custkey, place from r where place <= 10""",
)
def k2_shown_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = rank.shown_counters(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_nationkey", "c_custkey")
    return shown.select("c_mktsegment", "c_nationkey", "c_custkey", F.col("place").cast("bigint").alias("place"))


@query(
    "k3_top_by_value",
    """with r as (select o_orderpriority, o_orderkey, o_totalprice, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as place from orders)
       select * from r where place <= 3""",
)
def k3_top_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = rank.top_by_value(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", 3)
    return top.select("o_orderpriority", "o_orderkey", "o_totalprice", F.col("place").cast("bigint").alias("place"))


@query(
    "k4_first_interfaces",
    """with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as place from events)
       select * from r where place <= 5""",
)
def k4_first_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = rank.first_per_group(
        table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], [F.col("event_id")], rank.SHOWN_INTERFACES
    )
    return first.withColumn("place", F.col("place").cast("bigint"))


@query(
    "k6_first_examples",
    "select user_id, arg_min(event_type, event_id) as event_type, arg_min(value, event_id) as value from events group by 1",
)
def k6_first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.first_examples(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "value"])


@query(
    "u1_union_in_order",
    """select cast(0 as integer) as module_place, c_name as name, c_acctbal as balance from customer
       union all select cast(1 as integer), s_name, s_acctbal from supplier""",
)
def u1_union_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return rank.union_in_order([customers, suppliers])


@query(
    "u2_fallback",
    """with p as (select o_custkey as device, count(*) as routes, 'table' as source from orders where o_orderstatus = 'F' group by 1)
       select * from p union all select o_custkey, count(*), 'protocol' from orders where o_custkey not in (select device from p) group by 1""",
)
def u2_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "device")
    primary = rollup.row_totals(orders.filter("o_orderstatus = 'F'"), ["device"], "routes").withColumn("source", F.lit("table"))
    fallback = rollup.row_totals(orders, ["device"], "routes").withColumn("source", F.lit("protocol"))
    return rank.with_fallback(primary, fallback, ["device"])


@query(
    "u3_selection_changes",
    """with a as (select distinct user_id from events where event_type = 'error' and value > 20), b as (select distinct user_id from events where event_type = 'view' and value > 20)
       select coalesce(a.user_id, b.user_id) as user_id, case when a.user_id is null then 'add' when b.user_id is null then 'remove' else 'keep' end as change
       from a full join b on a.user_id = b.user_id""",
)
def u3_selection_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("value > 20")
    return rank.selection_changes(
        events.filter("event_type = 'error'"), events.filter("event_type = 'view'"), ["user_id"]
    )


@query("u4_distinct_names", "select distinct p_type || ' ' || p_brand as measurement from part")
def u4_distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.distinct_names(table(spark, sf_dir, "part").select(F.expr("concat(p_type, ' ', p_brand)").alias("measurement")), "measurement")


# ---- scalar steps of the jobs ---------------------------------------------------------------


@query(
    "p01_safe_int",
    """select o_orderkey, case o_orderkey % 6 when 0 then o_custkey when 1 then -o_custkey when 2 then cast(trunc(o_totalprice) as bigint) end as v from orders""",
)
def p01_safe_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.expr(
        """parse_json(case o_orderkey % 6 when 0 then concat('{"v":" ', o_custkey, ' "}') when 1 then concat('{"v":', -o_custkey, '}')
           when 2 then concat('{"v":', o_totalprice, '}') when 3 then concat('{"v":"', o_totalprice, '"}') when 4 then '{"v":"12d"}' else '{"v":null}' end)"""
    )
    docs = table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc"))
    return docs.select("o_orderkey", F.expr(casts.int_of_leaf(casts.leaf("doc", "v"))).alias("v"))


@query(
    "p02_safe_float",
    """select o_orderkey, case o_orderkey % 5 when 0 then cast(o_custkey as double) when 1 then o_custkey + 0.25::double when 2 then 1500::double end as v from orders""",
)
def p02_safe_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        "case o_orderkey % 5 when 0 then cast(o_custkey as string) when 1 then concat(o_custkey, '.25 ') when 2 then '1.5e3' when 3 then '12d' else '' end"
    )
    return table(spark, sf_dir, "orders").withColumn("text", text).select("o_orderkey", F.expr(casts.float_of_text("text")).alias("v"))


@query(
    "p03_size_gb",
    """select o_orderkey, case o_orderkey % 7 when 0 then o_custkey / 1::double when 1 then o_custkey * (1::double / 1048576) when 2 then o_custkey * (1::double / 1073741824)
         when 3 then o_custkey * 1024::double when 4 then o_custkey + 0.5::double when 5 then 0::double end as gb from orders""",
)
def p03_size_gb(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        """case o_orderkey % 7 when 0 then concat(o_custkey, 'G') when 1 then concat(o_custkey, 'm') when 2 then concat(' ', o_custkey, 'K')
           when 3 then concat(o_custkey, 'T') when 4 then concat(o_custkey, '.5') when 5 then '' else 'invalid' end"""
    )
    return table(spark, sf_dir, "orders").withColumn("text", text).select("o_orderkey", F.expr(casts.gigabytes_of_text("text")).alias("gb"))


@query(
    "p04_yes_no",
    "select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false end as flag from orders",
)
def p04_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("case o_orderstatus when 'F' then 'yes' when 'O' then 'no' else 'Yes' end")
    return table(spark, sf_dir, "orders").withColumn("text", text).select("o_orderkey", F.expr(casts.yes_no("text")).alias("flag"))


@query("p05_percent", "select event_id, case when event_id % 9 = 0 then null else value end as percent from events")
def p05_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("if(event_id % 9 = 0, 'n/a%', concat(value, '%'))")
    return table(spark, sf_dir, "events").withColumn("text", text).select("event_id", F.expr(casts.percent_of_text("text")).alias("percent"))


@query(
    "p06_route_protocol",
    """select o_orderkey, case o_orderkey % 8 when 0 then 'bgp' when 1 then 'static' when 2 then 'connected' when 3 then 'ospf' when 4 then 'rip' when 5 then 'other'
         when 6 then lower(replace(o_orderpriority, ' ', '_')) else 'bgp' end as protocol from orders""",
)
def p06_route_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.expr("element_at(array('A B S', 'A S C', 'A C O', 'O R', 'R', 'x', 'B', 'B?'), cast(o_orderkey % 8 + 1 as int))")
    named = F.expr("case when o_orderkey % 8 = 6 then concat(' ', o_orderpriority, ' ') when o_orderkey % 8 = 7 then '' end")
    return table(spark, sf_dir, "orders").select("o_orderkey", rollup.route_protocol(named, flags).alias("protocol"))


@query(
    "p07_identity_ip",
    """select c_custkey, case when c_custkey % 2 = 0 then '10.0.0.' || cast(c_custkey as varchar) else c_name end as ip from customer""",
)
def p07_identity_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("if(c_custkey % 2 = 0, concat(c_name, '(ipaddr:10.0.0.', c_custkey, ')'), c_name)")
    return table(spark, sf_dir, "customer").withColumn("text", text).select("c_custkey", F.expr(netaddr.identity_ip("text")).alias("ip"))


@query(
    "p08_remaining_percent",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity <> 0 and l_partkey % 5 > 0 then cast(printf('%.2f', l_quantity / (l_partkey % 5 * 64) * 100) as double) end as remaining_percent from lineitem""",
)
def p08_remaining_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.expr(casts.share_left("l_quantity", "l_partkey % 5 * 64"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", share.alias("remaining_percent"))


@query(
    "p17_escape",
    r"""select doc_id, md5(regexp_replace(text, '([,= ])', '\\\1', 'g')) as escaped_md5 from documents""",
)
def p17_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.functions.lineproto import escaped

    return spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.md5(escaped(F.col("text"))).alias("escaped_md5"))


@query(
    "p18_field_literal",
    r"""select event_id, case event_id % 4 when 0 then cast(event_id as varchar) || 'i' when 1 then cast(value as varchar)
          when 2 then '"' || replace(props, '"', '\"') || '"' else case when value > 10 then 'true' else 'false' end end as literal from events""",
)
def p18_field_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.functions.lineproto import field_text

    value = F.struct(
        F.expr("if(event_id % 4 = 0, event_id, null)").alias("v_int"),
        F.expr("if(event_id % 4 = 1, value, null)").alias("v_dbl"),
        F.expr("if(event_id % 4 = 2, props, null)").alias("v_str"),
        F.expr("if(event_id % 4 = 3, value > 10, null)").alias("v_bool"),
    )
    return table(spark, sf_dir, "events").select("event_id", field_text(value).alias("literal"))


SPREAD = "case o_orderkey % 4 when 0 then o_custkey when 1 then o_custkey * 1000 when 2 then o_custkey * 4000000 else o_custkey * 3000000000 end"


@query(
    "p20_bit_rate",
    f"""with v as (select o_orderkey, cast({SPREAD} as double) as v from orders)
        select o_orderkey, case when v >= 1e9 then printf('%.2f Gb/s', v / 1e9) when v >= 1e6 then printf('%.2f Mb/s', v / 1e6)
               when v >= 1e3 then printf('%.2f Kb/s', v / 1e3) else printf('%.0f b/s', v) end as shown from v""",
)
def p20_bit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("v", F.expr(SPREAD.replace("3000000000", "3000000000L")).cast("double"))
    return rows.select("o_orderkey", display.bit_rate("v").alias("shown"))


@query(
    "p21_byte_volume",
    f"""with v as (select o_orderkey, cast({SPREAD.replace("* 3000000000", "* 3000000000 * 1024")} as bigint) as v from orders)
        select o_orderkey, case when v >= 1073741824 then printf('%.2f GB', v / 1073741824::double) when v >= 1048576 then printf('%.2f MB', v / 1048576::double)
               when v >= 1024 then printf('%.2f KB', v / 1024::double) else cast(v as varchar) || ' B' end as binary_units,
               case when v >= 1e12 then printf('%.2f TB', v / 1e12) when v >= 1e9 then printf('%.2f GB', v / 1e9) when v >= 1e6 then printf('%.2f MB', v / 1e6)
               when v >= 1e3 then printf('%.2f KB', v / 1e3) else cast(v as varchar) || ' B' end as decimal_units from v""",
)
def p21_byte_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("v", F.expr(SPREAD.replace("* 3000000000", "* 3000000000L * 1024")))
    return rows.select(
        "o_orderkey", display.byte_volume("v").alias("binary_units"), display.byte_volume("v", 1000).alias("decimal_units")
    )


@query(
    "p22_packet_rate",
    f"""with v as (select o_orderkey, cast({SPREAD} as double) as v from orders)
        select o_orderkey, case when v >= 1e6 then printf('%.2fM', v / 1e6) when v >= 1e3 then printf('%.2fk', v / 1e3) else printf('%.1f', v) end as shown from v""",
)
def p22_packet_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("v", F.expr(SPREAD.replace("3000000000", "3000000000L")).cast("double"))
    return rows.select("o_orderkey", display.packet_rate("v").alias("shown"))


@query(
    "p23_duration",
    """with v as (select o_orderkey, o_custkey * (case o_orderkey % 3 when 0 then 1 when 1 then 60 else 997 end) as s from orders)
       select o_orderkey, case when s >= 86400 then cast(s // 86400 as varchar) || 'd ' || cast(s % 86400 // 3600 as varchar) || 'h'
         when s >= 3600 then cast(s // 3600 as varchar) || 'h ' || cast(s % 3600 // 60 as varchar) || 'm'
         when s >= 60 then cast(s // 60 as varchar) || 'm ' || cast(s % 60 as varchar) || 's' else cast(s as varchar) || 's' end as uptime,
         case when s = 0 then 'N/A' else cast(s // 60 as varchar) || 'm ' || cast(s % 60 as varchar) || 's' end as remaining from v""",
)
def p23_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.expr("o_custkey * case o_orderkey % 3 when 0 then 1 when 1 then 60 else 997 end")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", display.duration(seconds).alias("uptime"), display.remaining(seconds).alias("remaining")
    )


@query(
    "p25_safe_key",
    "select doc_id, md5(regexp_replace(text, '[^a-zA-Z0-9_\\-]', '_', 'g')) as safe_md5 from documents",
)
def p25_safe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = F.transform_keys(F.create_map(F.col("text"), F.lit(1)), lambda k, _: naming.safe_key(k))
    return spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.md5(F.map_keys(keyed)[0]).alias("safe_md5"))


@query(
    "p27_sensor_alarm",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity < 10 or l_quantity > 40 as out_of_range, l_quantity > 45 * 0.9::double as near_limit from lineitem""",
)
def p27_sensor_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.operators import health

    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        health.sensor_alarm(F.col("l_quantity"), F.lit(10.0), F.lit(40.0)).alias("out_of_range"),
        health.near_limit(F.col("l_quantity"), F.lit(45.0)).alias("near_limit"),
    )
