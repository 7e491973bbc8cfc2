"""Sources, sinks and the reshaping of nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import casts, lineproto
from fleetlens.operators import nested, project, rollup, textparse
from fleetlens.plans.ticks import spread, table
from fleetlens.queries import query
from fleetlens.session import run_dir
from fleetlens.sources import linesink, snapshots, store

# ---- sources and sinks ----------------------------------------------------------------------


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot document per order: two modules, the second one failed for status F."""
    payload = F.expr(
        """concat('{"system":{"dev-', o_custkey, '":{"success":true,"hostname":"h', o_orderkey,
           '","error":null,"data":{"total":', o_totalprice, ',"priority":"', o_orderpriority, '"}}},"vpn":{"dev-',
           o_custkey, '":{"success":', if(o_orderstatus = 'F', 'false', 'true'), ',"error":',
           if(o_orderstatus = 'F', '"timed out"', 'null'), ',"data":', if(o_orderstatus = 'F', 'null', '{}'), '}}}')"""
    )
    broken = F.expr("o_orderkey % 50 = 0")
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey",
        F.lit(None).cast("timestamp").alias("collected_at"),
        F.when(broken, F.substr(payload, F.lit(1), F.lit(40))).otherwise(payload).alias("payload"),
    )


@query("s1_snapshot_scan", "select o_orderkey, o_orderkey % 50 <> 0 as readable from orders")
def s1_snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = snapshots.parsed(_order_documents(spark, sf_dir))
    return good.select("o_orderkey", F.lit(True).alias("readable")).unionByName(
        bad.select("o_orderkey", F.lit(False).alias("readable"))
    )


@query(
    "s1_snapshot_file",
    """select s_suppkey as id, 'system' as module, 'fw-' || cast(s_suppkey as varchar) as device, s_suppkey % 3 <> 0 as success, s_name as hostname, case when s_suppkey % 3 = 0 then 'off' end as error, s_acctbal as balance, s_suppkey as at from supplier where s_suppkey % 7 <> 0
       union all
       select s_suppkey, 'vpn', 'fw-' || cast(s_suppkey as varchar), false, null, 'Malformed envelope', null, s_suppkey from supplier where s_suppkey % 7 <> 0 and s_suppkey % 2 = 0
       union all
       select s_suppkey, 'vpn', 'fw-' || cast(s_suppkey as varchar), true, s_name, null, cast(s_nationkey as double), s_suppkey from supplier where s_suppkey % 7 <> 0 and s_suppkey % 2 = 1
       union all
       select s_suppkey, null, null, false, null, 'no document', null, null from supplier where s_suppkey % 7 = 0""",
)
def s1_snapshot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each supplier: extra top-level values, broken envelopes beside good ones, some files cut off."""
    payload = F.expr(
        """concat('{"timestamp":"', date_format(timestamp_seconds(s_suppkey), "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","version":3,"notes":{"by":{"success":true}},"system":{"fw-', s_suppkey, '":{"success":',
           if(s_suppkey % 3 = 0, '0,"error":"off"', if(s_suppkey % 3 = 1, '"yes"', 'true')), ',"hostname":"', s_name, '","data":{"v":', s_acctbal, '}}},"vpn":{"fw-', s_suppkey, '":',
           if(s_suppkey % 2 = 0, '"broken"', concat('{"success":1,"hostname":"', s_name, '","data":{"v":', s_nationkey, '}}')), '}}')"""
    )
    path = run_dir(spark, "snapshots")
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.substr(payload, F.lit(1), F.lit(60))).otherwise(payload).alias("value")
    )
    # A file costs far more than its bytes: a given number of tasks, which are not put together by their bytes, write and commit.
    tasks = spark.sparkContext.defaultParallelism * 3
    writer = rows.repartition(tasks, "s_suppkey").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy("s_suppkey").text(path)
    raw = snapshots.read_snapshots(spark, path).withColumn(
        "id", F.regexp_extract("source", "s_suppkey=([0-9]+)", 1).cast("bigint")
    )
    good, bad = snapshots.parsed(raw)
    found = snapshots.envelopes(good).select(
        "id", "module", "device", "success", "hostname", "error",
        F.try_variant_get("data", F.lit("$.v"), "double").alias("balance"), F.unix_seconds("collected_at").alias("at"),
    )
    lost = bad.selectExpr(
        "id", "cast(null as string) as module", "cast(null as string) as device", "false as success",
        "cast(null as string) as hostname", "'no document' as error", "cast(null as double) as balance", "cast(null as bigint) as at",
    )
    return found.unionByName(lost)


@query(
    "s1_envelope_scan",
    """select event_id, 'dev-' || cast(user_id as varchar) as device, event_type as module,
       event_type <> 'error' as success, value, cast(json_extract_string(props, '$.k') as bigint) as k from events""",
)
def s1_envelope_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "envelopes")
    table(spark, sf_dir, "events").select(
        F.concat(F.lit("dev-"), F.col("user_id")).alias("device"),
        F.col("event_type").alias("module"),
        (F.col("event_type") != "error").alias("success"),
        F.struct("event_id", "value", "props").alias("data"),
    ).write.json(path)
    landed = snapshots.read_envelopes(spark, path)
    return landed.select(
        F.try_variant_get("data", "$.event_id", "bigint").alias("event_id"),
        "device",
        "module",
        "success",
        F.try_variant_get("data", "$.value", "double").alias("value"),
        F.expr(f"try_variant_get(try_parse_json({casts.leaf_text('data', 'props')}), '$.k', 'bigint')").alias("k"),
    )


@query(
    "s2_envelope_explode",
    """with o as (select * from orders where o_orderkey % 50 <> 0)
       select o_orderkey, 'system' as module, 'dev-' || cast(o_custkey as varchar) as device, true as success,
              'h' || cast(o_orderkey as varchar) as hostname, cast(null as varchar) as error, o_totalprice as total from o
       union all
       select o_orderkey, 'vpn', 'dev-' || cast(o_custkey as varchar), o_orderstatus <> 'F', null,
              case when o_orderstatus = 'F' then 'timed out' end, null from o""",
)
def s2_envelope_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = snapshots.parsed(_order_documents(spark, sf_dir))
    return snapshots.envelopes(good).select(
        "o_orderkey", "module", "device", "success", "hostname", "error",
        F.try_variant_get("data", "$.total", "double").alias("total"),
    )


@query(
    "s3_response_decode",
    """select o_orderkey, o_orderkey % 4 = 0 as success, case when o_orderkey % 4 = 0 then o_orderpriority end as result,
       case o_orderkey % 4 when 1 then 'API error: denied ' || cast(o_custkey as varchar)
            when 2 then 'Unexpected response status: pending' when 3 then 'Invalid response format' end as error from orders""",
)
def s3_response_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr(
        """case o_orderkey % 4
           when 0 then concat('<response status="success"><result>', o_orderpriority, '</result></response>')
           when 1 then concat('<response status="error"><msg>denied ', o_custkey, '</msg></response>')
           when 2 then '<response status="pending"></response>'
           else concat('<html>', o_orderkey, '</html>') end"""
    )
    raw = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    return snapshots.decoded_responses(raw, F.col("body")).select("o_orderkey", "success", "result", "error")


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the part table: text, whole, real and boolean fields, an empty and a missing tag."""
    nothing = {t: F.lit(None).cast(t) for t in project.VALUE_TYPES}

    def slot(kind: str, value) -> F.Column:
        return F.struct(*[(value if t == kind else nothing[t]).alias(s) for t, s in project.VALUE_TYPES.items()])

    # a small file is one split, and a part gives nine rows of a catalog
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        F.concat(F.lit("dev-"), F.col("p_partkey")).alias("device"),
        F.lit("stock item").alias("measurement"),
        F.create_map(
            F.lit("name"), F.col("p_name"), F.lit("brand"), F.when(F.expr("p_partkey % 3 > 0"), F.col("p_brand")),
            F.lit("empty"), F.lit(""),
        ).alias("tags"),
        F.create_map(
            F.lit("size"), slot("bigint", F.col("p_size").cast("bigint")),
            F.lit("retail price"), slot("double", F.col("p_retailprice")),
            F.lit("kind"), slot("string", F.concat(F.lit('say "'), F.col("p_type"), F.lit('"'))),
            F.lit("large"), slot("boolean", F.col("p_size") > 25),
            F.lit("absent"), slot("string", nothing["string"]),
        ).cast(project.FIELD_MAP).alias("fields"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("collected_at"),
    )


LINES = r"""select 'x_stock\ item' || case when p_partkey % 3 > 0 then ',brand=' || p_brand else '' end
    || ',name=' || replace(p_name, ' ', '\ ') || ' kind="say \"' || p_type || '\""'
    || ',large=' || case when p_size > 25 then 'true' else 'false' end
    || ',retail\ price=' || cast(p_retailprice as varchar) || ',size=' || cast(p_size as varchar) || 'i'
    || ' 1704067200000000000' as line from part"""


@query("p19_line", LINES)
def p19_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.lines(part_points(spark, sf_dir), prefix="x_")


@query("s4_line_sink", LINES)
def s4_line_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "lines")
    store.write_lines(part_points(spark, sf_dir), path, prefix="x_")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("s4_line_sink_committed", LINES)
def s4_line_sink_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines through the sink that moves files into place when the whole job has ended."""
    path = run_dir(spark, "committed-lines")
    spark.dataSource.register(linesink.LineSink)
    store.lines(part_points(spark, sf_dir), prefix="x_").write.format("line_sink").mode("append").save(path)
    return spark.read.text(f"{path}/part-*.txt").withColumnRenamed("value", "line")


@query("s5_json_sink", "select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders")
def s5_json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "json")
    store.write_json(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path)
    return spark.read.schema("o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string").json(path)


@query(
    "s6_measurement_store",
    """select event_id, user_id as device, value from events
       where event_type in ('click', 'error') and ts >= timestamp '2024-01-10'""",
)
def s6_measurement_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "store")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("device"), "value", F.col("event_type").alias("measurement"),
        F.to_date("ts").alias("dt"),
    )
    # two writes: the second one brings other days and leaves the first ones
    early = F.col("dt") < F.lit("2024-01-15").cast("date")
    store.write_points(rows.filter(~early), path)
    store.write_points(rows.filter(early), path)
    return store.read_points(spark, path, ["click", "error"], "2024-01-10").select("event_id", "device", "value")


STRIPPED = r"regexp_replace(text, '^\s+|\s+\z', '', 'g')"


@query(
    "s7_raw_output",
    rf"""with l as (select doc_id, unnest(string_split({STRIPPED}, chr(10))) as line from documents)
         select doc_id, count(*) as n_lines, cast(sum(length(regexp_replace(line, '^\s+|\s+\z', '', 'g'))) as bigint) as chars
         from l group by doc_id""",
)
def s7_raw_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = textparse.lines(spread(table(spark, sf_dir, "documents"), "doc_id"), F.col("text"), ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


# ---- nested data ----------------------------------------------------------------------------


def _customer_json(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.expr(f"parse_json({expression})").alias("doc")
    )


@query(
    "n01_one_or_many",
    """select c_custkey, cast(0 as bigint) as pos, c_name as name from customer
       union all select c_custkey, cast(1 as bigint), c_mktsegment from customer where c_custkey % 2 = 1""",
)
def n01_one_or_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _customer_json(
        spark, sf_dir,
        """if(c_custkey % 2 = 0, concat('{"entry":{"name":"', c_name, '"}}'),
           concat('{"entry":[{"name":"', c_name, '"},{"name":"', c_mktsegment, '"},"skipped",7]}'))""",
    )
    return nested.explode_entries(docs, casts.leaf("doc", "entry")).select(
        "c_custkey", F.col("pos").cast("bigint").alias("pos"), F.expr(casts.leaf_text("entry", "name")).alias("name")
    )


@query(
    "n02_alternate_path",
    """select c_custkey, case when c_custkey % 3 = 0 then 'dp0' when c_custkey % 3 = 1 then 's1dp0' end as found,
       case when c_custkey % 3 < 2 then c_acctbal end as load from customer""",
)
def n02_alternate_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _customer_json(
        spark, sf_dir, "concat('{\"', element_at(array('dp0', 's1dp0', 'dp7'), cast(c_custkey % 3 + 1 as int)), '\":{\"load\":', c_acctbal, '}}')"
    )
    keys = ["dp0", "s1dp0"]
    load = casts.first_path("doc", [(k, "load") for k in keys])
    return docs.selectExpr("c_custkey", f"{casts.first_key('doc', keys)} as found", f"{casts.get_as(load, 'double')} as load")


@query(
    "n03_map_explode",
    """select o_orderkey, 'k' || cast(o_custkey as varchar) as entry_key, o_totalprice as price from orders
       union all select o_orderkey, o_orderpriority, null from orders""",
)
def n03_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(
            """parse_json(concat('{"k', o_custkey, '":{"price":', o_totalprice, '},"', o_orderpriority, '":{}}'))"""
        ).alias("doc"),
    )
    rows = nested.explode_map(docs, "doc")
    return rows.select("o_orderkey", "entry_key", F.try_variant_get("entry", "$.price", "double").alias("price"))


GATHERED = ", ".join(f"case when l_linenumber > {i} and l_partkey % 7 <> {i} then 'd' || cast(l_suppkey + {i} as varchar) end" for i in range(10))


@query(
    "n04_gather_numbered",
    f"""with v as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, [{GATHERED}] as vals from lineitem),
        c as (select *, case when list_position(vals, null) is null then 10 else list_position(vals, null) - 1 end as kept from v)
        select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(kept as bigint) as kept,
               coalesce(array_to_string(vals[1:kept], ','), '') as gathered from c""",
)
def n04_gather_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = [
        F.expr(f"case when l_linenumber > {i} and l_partkey % 7 <> {i} then concat('d', l_suppkey + {i}) end") for i in range(10)
    ]
    gathered = nested.gather_numbered(slots)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.size(gathered).cast("bigint").alias("kept"), F.array_join(gathered, ",").alias("gathered"),
    )


@query(
    "n05_promote_json",
    """select event_id, 'name' as key, event_type as value from events
       union all select event_id, 'k', json_extract_string(props, '$.k') from events where event_id % 50 <> 0 and event_id % 3 <> 1
       union all select event_id, 'json', props || '}' from events where event_id % 50 = 0
       union all select event_id, 'json', cast(event_id as varchar) from events where event_id % 50 <> 0 and event_id % 3 = 1""",
)
def n05_promote_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.expr(
        "case when event_id % 50 = 0 then concat(props, '}') when event_id % 3 = 1 then cast(event_id as string) else props end"
    )
    fields = F.create_map(F.lit("name"), F.col("event_type"), F.lit("json"), held)
    promoted = table(spark, sf_dir, "events").select("event_id", nested.promote_json(fields).alias("m"))
    return promoted.select("event_id", F.explode("m").alias("key", "value"))


MIXED = """case o_orderkey % 8 when 0 then cast(o_custkey as string) when 1 then '-' || cast(o_custkey as string)
    when 2 then cast(o_custkey as string) || '.5' when 3 then 'True' when 4 then 'false' when 5 then o_orderpriority
    when 6 then '1e3' else '+' || cast(o_custkey as string) end"""


@query(
    "n06_type_inference",
    """with t as (select o_orderkey, o_orderkey % 8 as m, o_custkey as c, o_orderpriority as p from orders)
       select o_orderkey, case when m < 2 then 'integer' when m in (2, 6, 7) then 'float' when m in (3, 4) then 'boolean' else 'string' end as type,
              case m when 0 then c when 1 then -c end as v_int,
              case m when 2 then c + 0.5::double when 6 then 1000::double when 7 then c::double end as v_dbl,
              case m when 3 then true when 4 then false end as v_bool, case when m = 5 then p end as v_str from t""",
)
def n06_type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(casts.typed_text(f"({MIXED})")).alias("t"))
    return typed.select("o_orderkey", "t.*")


@query(
    "p16_convert_value",
    """with t as (select o_orderkey, o_orderkey % 8 as m, o_custkey as c, o_orderpriority as p from orders)
       select o_orderkey, case when m in (0, 1, 7) then 'integer' when m in (2, 6) then 'float' else 'string' end as type,
              case when m in (0, 7) then c when m = 1 then -c end as v_int,
              case m when 2 then c + 0.5::double when 6 then 1000::double end as v_dbl,
              case m when 3 then 'True' when 4 then 'false' when 5 then p end as v_str from t""",
)
def p16_convert_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(casts.converted_text(f"({MIXED})")).alias("t"))
    return typed.select("o_orderkey", "t.*")


def _older_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One older-layout document per customer with two peers of the same name on odd keys."""
    return _customer_json(
        spark, sf_dir,
        """concat('{"entry":[{"@vr":"x","@peer":"p', c_custkey, '","status":"Idle","peer-address":"10.0.0.1","other":"1"},',
           '{', if(c_custkey % 2 = 1, concat('"@peer":"p', c_custkey, '"'), concat('"peer-name":"q', c_custkey, '"')),
           ',"status":"Established","status-duration":', c_custkey, ',"peer-group":"', c_mktsegment, '"}',
           if(c_custkey % 3 = 0, ',{"status":"Active"}', ''), ']}')""",
    )


@query(
    "n07_peer_layout",
    """with p as (
         select c_custkey, 'p' || cast(c_custkey as varchar) as peer_name, 'Idle' as state, cast(null as varchar) as status_time,
                cast(null as varchar) as peer_group_name, '10.0.0.1' as peer_ip, 3 as fields from customer where c_custkey % 2 = 0
         union all
         select c_custkey, case when c_custkey % 2 = 1 then 'p' else 'q' end || cast(c_custkey as varchar), 'Established',
                cast(c_custkey as varchar), c_mktsegment, null, case when c_custkey % 2 = 1 then 3 else 4 end from customer
         union all select c_custkey, 'unknown', 'Active', null, null, null, 1 from customer where c_custkey % 3 = 0)
       select c_custkey, peer_name, state, status_time, peer_group_name, peer_ip, cast(fields as bigint) as fields from p""",
)
def n07_peer_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    peers = nested.peer_rows(_older_peers(spark, sf_dir), "doc", ["c_custkey"])

    def text(name: str) -> F.Column:
        return F.try_variant_get(F.col("fields")[name], "$", "string")

    return peers.select(
        "c_custkey", "peer_name", text("state").alias("state"), text("status-time").alias("status_time"),
        text("peer-group-name").alias("peer_group_name"), text("peer-ip").alias("peer_ip"),
        F.size("fields").cast("bigint").alias("fields"),
    )


def _older_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One older-layout route list per order: two routes, or one bare object on even keys."""
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.lit(None).cast("timestamp").alias("collected_at"),
        F.concat(F.lit("dev-"), F.col("o_orderkey")).alias("device"),
        F.lit(None).cast("string").alias("hostname"),
        F.lit(None).cast("string").alias("data_hostname"),
        F.lit("routing").alias("module"),
        F.lit("routing_table").alias("collection"),
        F.expr("if(o_orderkey % 3 = 0, 'advanced', 'legacy')").alias("routing_mode"),
        F.lit(False).alias("superseded"),
        F.expr(
            """parse_json(case when o_orderkey % 3 = 0 then
               concat('{"vr', o_custkey % 5, '":{"10.0.0.0/8":[{"protocol":"BGP Local"},{"protocol":"static"}],"0.0.0.0/0":[{"flags":"A S"}]}}')
               when o_orderkey % 2 = 0 then concat('{"entry":{"destination":"d', o_custkey, '","flags":"A C","virtual-router":"vr', o_custkey % 5, '"}}')
               else concat('{"entry":[{"destination":"d1","flags":"A B"},{"flags":"A O","virtual-router":"vr1"},',
                           '{"destination":"d1","flags":"?","virtual-router":"vr1"}]}') end)"""
        ).alias("body"),
    )


ROUTES = """with o as (select o_orderkey, o_custkey, 'dev-' || cast(o_orderkey as varchar) as device from orders), r as (
    select device, 'vr' || cast(o_custkey % 5 as varchar) as vrf, '10.0.0.0/8' as destination, 'bgp_local' as protocol from o where o_orderkey % 3 = 0
    union all select device, 'vr' || cast(o_custkey % 5 as varchar), '10.0.0.0/8', 'static' from o where o_orderkey % 3 = 0
    union all select device, 'vr' || cast(o_custkey % 5 as varchar), '0.0.0.0/0', 'static' from o where o_orderkey % 3 = 0
    union all select device, 'vr' || cast(o_custkey % 5 as varchar), 'd' || cast(o_custkey as varchar), 'connected' from o
      where o_orderkey % 3 <> 0 and o_orderkey % 2 = 0
    union all select device, 'default', 'd1', 'bgp' from o where o_orderkey % 3 <> 0 and o_orderkey % 2 = 1
    union all select device, 'vr1', 'unknown', 'ospf' from o where o_orderkey % 3 <> 0 and o_orderkey % 2 = 1
    union all select device, 'vr1', 'd1', 'other' from o where o_orderkey % 3 <> 0 and o_orderkey % 2 = 1)"""


@query("n08_route_layout", f"{ROUTES} select device, vrf, destination, protocol from r")
def n08_route_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = project.route_list(_older_routes(spark, sf_dir), "routing_table")
    return routes.select(
        "device", "vrf", "destination", rollup.route_protocol(F.col("protocol"), F.col("flags")).alias("protocol")
    )


@query(
    "pj25_routing_table_counts",
    f"""{ROUTES}, c as (select device, vrf, 'routes_' || protocol as field, count(*) as routes from r group by all)
        select * from c union all select device, vrf, 'routes_total', count(*) from r group by device, vrf""",
)
def pj25_routing_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = project.route_points(_older_routes(spark, sf_dir))
    return points.select("device", F.col("tags")["vrf"].alias("vrf"), F.explode("fields").alias("field", "v")).select(
        "device", "vrf", "field", F.col("v.v_int").alias("routes")
    )


def _named(rows: DataFrame, collection: str) -> DataFrame:
    return rows.withColumn("collection", F.lit(collection))


@query("pj26_static_routes_count", f"{ROUTES} select device, count(*) as static_routes from r group by device")
def pj26_static_routes_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = project.route_points(_named(_older_routes(spark, sf_dir), "static_routes"))
    return points.select("device", F.col("fields")["static_routes"]["v_int"].alias("static_routes"))


@query("pj27_bgp_routes_count", f"{ROUTES} select device, count(*) as bgp_routes from r group by device")
def pj27_bgp_routes_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = project.route_points(_named(_older_routes(spark, sf_dir), "bgp_routes"))
    return points.select("device", F.col("fields")["bgp_routes"]["v_int"].alias("bgp_routes"))


@query(
    "n09_summary_layout",
    """select c_custkey, case when c_custkey % 2 = 0 then 'vr-' || cast(c_nationkey as varchar) else 'default' end as vrf,
       c_acctbal as balance, cast(1 as bigint) as fields from customer""",
)
def n09_summary_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _customer_json(
        spark, sf_dir,
        """concat('{"entry":{', if(c_custkey % 2 = 0, concat('"@virtual-router":"vr-', c_nationkey, '",'), '"@id":"1",'),
           '"balance":', c_acctbal, '}}')""",
    )
    return nested.summary_rows(docs, "doc", ["c_custkey"]).select(
        "c_custkey", "vrf", F.try_variant_get(F.col("fields")["balance"], "$", "double").alias("balance"),
        F.size("fields").cast("bigint").alias("fields"),
    )


@query(
    "n10_mode_gate",
    """select o_orderkey, case when o_orderpriority = '1-URGENT' and o_orderstatus <> 'F' then 'older' else 'newer' end as layout from orders""",
)
def n10_mode_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    mode = F.when(F.col("o_orderpriority") == "1-URGENT", "legacy").when(F.col("o_orderpriority") == "5-LOW", "advanced")
    older, newer = nested.by_routing_mode(orders, mode, F.col("o_orderstatus") != "F")
    return older.select("o_orderkey", F.lit("older").alias("layout")).unionByName(
        newer.select("o_orderkey", F.lit("newer").alias("layout"))
    )


@query(
    "n11_leaf_profile",
    """select event_id, unnest(['id', 'env', 'env.success', 'env.data.k', 'env.error', 'tags', 'value']) as path,
       unnest(['integer', 'envelope', 'boolean', 'integer', 'null', 'array', 'float']) as kind from events""",
)
def n11_leaf_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        """concat('{"id":', event_id, ',"env":{"success":true,"data":', props, ',"error":null},"tags":["', event_type, '"],"value":', value, '}')"""
    )
    docs = table(spark, sf_dir, "events").select("event_id", text.alias("doc"))
    return nested.leaf_profile(docs, "doc", ["event_id"])


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        """concat('{"id":', event_id, ',"env":{"success":true,"data":', props, ',"error":null},"tags":["', event_type, '"],"value":', value, '}')"""
    )
    nested.register_functions(spark)
    return table(spark, sf_dir, "events").select("event_id", text.alias("doc"))


LEAVES = """select event_id, unnest(['id', 'env', 'env.success', 'env.data.k', 'env.error', 'tags', 'value']) as path,
       unnest(['integer', 'envelope', 'boolean', 'integer', 'null', 'array', 'float']) as kind from events"""


@query("e3_flatten", LEAVES)
def e3_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves by a lateral call in SQL."""
    docs = _profiled(spark, sf_dir)
    return spark.sql("select d.event_id, f.path, f.kind from {docs} d, lateral leaf_flatten(d.doc) f", docs=docs)


@query("e3_flatten_table", LEAVES)
def e3_flatten_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a whole table, dealt out by key."""
    docs = _profiled(spark, sf_dir)
    return spark.sql("select * from leaf_flatten(table({docs}) partition by (event_id), 'doc')", docs=docs)


@query(
    "n12_unwrap_text",
    """select o_orderkey, case o_orderkey % 4 when 0 then o_orderpriority when 1 then o_orderstatus when 2 then cast(o_custkey as varchar) end as text from orders""",
)
def n12_unwrap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.expr(
        """parse_json(case o_orderkey % 4 when 0 then concat('"', o_orderpriority, '"') when 1 then concat('{"text":"', o_orderstatus, '"}')
           when 2 then concat('{"result":"', o_custkey, '"}') else '[1]' end)"""
    )
    docs = table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc"))
    return docs.select("o_orderkey", F.expr(casts.unwrapped_text("doc")).alias("text"))


# ---- points and long form -------------------------------------------------------------------


@query(
    "pj45_wide_to_long",
    """select l_orderkey, l_linenumber, field, value from (select * from lineitem where l_orderkey is not null)
       unpivot (value for field in (l_quantity, l_extendedprice, l_discount, l_tax))""",
)
def pj45_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return project.melt(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], values)


@query(
    "pj45_long_metrics",
    """select 'dev-' || cast(p_partkey as varchar) as device, 
         case when p_partkey % 3 > 0 then 'brand=' || p_brand || ',' else '' end || 'name=' || p_name as series, f.field,
         case when f.field = 'size' then cast(p_size as bigint) end as v_int, case when f.field = 'retail price' then p_retailprice end as v_dbl,
         case when f.field = 'kind' then 'say "' || p_type || '"' end as v_str, case when f.field = 'large' then p_size > 25 end as v_bool
       from part, (values ('size'), ('retail price'), ('kind'), ('large')) f(field)""",
)
def pj45_long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = part_points(spark, sf_dir)
    live = points.withColumns(
        {"tags": lineproto.live_tags(F.col("tags")), "fields": lineproto.live_fields(F.col("fields"))}
    )
    return project.long_metrics(live).select("device", "series", "field", "v_int", "v_dbl", "v_str", "v_bool")


@query(
    "f03_null_drop",
    """select 'dev-' || cast(p_partkey as varchar) as device, case when p_partkey % 3 > 0 then 'brand,name' else 'name' end as tags,
       'kind,large,retail price,size' as fields from part""",
)
def f03_null_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    def names(column) -> F.Column:
        return F.array_join(F.array_sort(F.map_keys(column)), ",")

    return part_points(spark, sf_dir).select(
        "device",
        names(lineproto.live_tags(F.col("tags"))).alias("tags"),
        names(lineproto.live_fields(F.col("fields"))).alias("fields"),
    )


@query(
    "k5_key_order",
    """select event_id, 'a=' || cast(user_id as varchar) || ',b=' || event_type || ',c=' || cast(value as varchar) as pairs from events""",
)
def k5_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(
        F.lit("c"), F.col("value").cast("string"), F.lit("a"), F.col("user_id").cast("string"), F.lit("b"), F.col("event_type")
    )
    pairs = F.transform(lineproto.sorted_pairs(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(pairs, ",").alias("pairs"))


def _counter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One counter document per supplier: categories of 3 to 8 entries, unnamed and repeated names."""
    entry = """concat('{"name":"', if(i = 6, '', concat('c', if(i = 5, 4, i))), '","value":', s_suppkey * 10 + i, ',"rate":', i,
        if(i % 2 = 0, ',"category":"flow"', if(s_suppkey % 4 = 0, ',"category":"tcp"', '')), '}')"""
    body = f"""parse_json(concat('{{"global":{{"counters":{{"entry":[', array_join(transform(sequence(0, cast(6 + s_suppkey % 10 as int)), i -> {entry}), ','), ']}}}}}}'))"""
    return table(spark, sf_dir, "supplier").select(
        F.lit(None).cast("timestamp").alias("collected_at"),
        F.concat(F.lit("dev-"), F.col("s_suppkey")).alias("device"),
        F.lit(None).cast("string").alias("hostname"),
        F.lit(None).cast("string").alias("data_hostname"),
        F.lit("counters").alias("module"),
        F.lit("global_counters").alias("collection"),
        F.lit("advanced").alias("routing_mode"),
        F.lit(False).alias("superseded"),
        F.expr(body).alias("body"),
    )


@query(
    "pj28_category_counters",
    """with e as (select s_suppkey, i, 'dev-' || cast(s_suppkey as varchar) as device,
           case when i = 6 then '' else 'c' || cast(case when i = 5 then 4 else i end as varchar) end as name,
           s_suppkey * 10 + i as value, case when i % 2 = 0 then 'flow' when s_suppkey % 4 = 0 then 'tcp' else 'other' end as category
         from supplier, range(17) t(i) where i <= 6 + s_suppkey % 10),
       big as (select device, category from e group by 1, 2 having count(*) >= 5),
       last as (select device, category, name, max(i) as i from e where name <> '' group by 1, 2, 3)
       select l.device, 'counters_' || l.category as measurement, l.name || s.suffix as field,
              cast(case when s.suffix = '' then e.value else l.i end as bigint) as value
       from last l join big using (device, category) join e on e.device = l.device and e.i = l.i, (values (''), ('_rate')) s(suffix)""",
)
def pj28_category_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = project.category_points(_counter_documents(spark, sf_dir))
    return points.select("device", "measurement", F.explode("fields").alias("field", "v")).select(
        "device", "measurement", "field", F.col("v.v_int").alias("value")
    )


@query(
    "pj47_management_counters",
    "select 'dev-' || cast(c_custkey as varchar) as device, 'm-' || c_mktsegment as counter, cast(c_nationkey as bigint) as value from customer",
)
def pj47_management_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.operators.specs import REPORT_VIEWS

    rows = table(spark, sf_dir, "customer").select(
        F.lit(None).cast("timestamp").alias("collected_at"), F.concat(F.lit("dev-"), F.col("c_custkey")).alias("device"),
        F.lit(None).cast("string").alias("hostname"), F.lit(None).cast("string").alias("data_hostname"),
        F.lit("counters").alias("module"), F.lit("management_server_counters").alias("collection"), F.lit(False).alias("superseded"),
        F.expr("parse_json(concat('{\"m-', c_mktsegment, '\":', c_nationkey, '}'))").alias("body"),
    )
    return project.wide(rows, REPORT_VIEWS["management_counters"]).select("device", "counter", "value")
