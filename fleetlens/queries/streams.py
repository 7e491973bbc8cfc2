"""Streaming jobs run over everything that is there now, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.plans.ticks import micros, polls, table, ticks
from fleetlens.queries import query
from fleetlens.queries.series import POLLS, RATES, TICKS
from fleetlens.session import prepare, run_dir
from fleetlens.streaming import flows, gates, ordered, state

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    state.use_state_store(spark)
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Everything a stream emits for its present input, through a folder sink."""
    work = run_dir(spark, label)
    running = flows.each_batch(stream, flows.to_folder_per_batch(f"{work}/out"), f"{work}/checkpoint", mode)
    running.awaitTermination()
    return spark.read.parquet(f"{work}/out").drop("batch_id")


def _polled(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("device"), micros("ts").alias("ts_us"), F.col("event_id").alias("tie"),
        F.col("event_type").alias("state"), F.col("event_type").isin("error", "view").alias("failed"), "value",
    )


@query(
    "ts1_ingest",
    """with e as (select event_id, 'dev-' || cast(user_id as varchar) as device, user_id, value from events where event_type <> 'error')
       select device, event_id as at, 'load_1min' as field, value as v_dbl from e""",
)
def ts1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = run_dir(spark, "ingest")
    table(spark, sf_dir, "events").select(
        F.timestamp_micros(F.col("event_id") * 1_000_000).alias("collected_at"),
        F.lit("system").alias("module"),
        F.concat(F.lit("dev-"), F.col("user_id")).alias("device"),
        (F.col("event_type") != "error").alias("success"),
        F.struct(F.struct(F.col("value").alias("load_average_1min"), F.lit("x").alias("cpu_idle")).alias("resource_usage")).alias("data"),
    ).write.json(f"{work}/landing")
    flows.ingest(spark, f"{work}/landing", f"{work}/metrics", f"{work}/checkpoint").awaitTermination()
    metrics = spark.read.parquet(f"{work}/metrics").filter("measurement = 'load_average'")
    return metrics.select("device", F.unix_seconds("collected_at").alias("at"), "field", "v_dbl")


@query(
    "ts2_stream_rate",
    f"""with {RATES} select device, iface, event_id, cast(delta as bigint) as delta_octets, bps,
        max(bps) over (partition by device, iface order by ts_us, event_id rows between 69 preceding and current row) as peak_bps from bps""",
)
def ts2_stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    state.use_state_store(spark)
    landed = run_dir(spark, "ticks")
    samples = ticks(spark, sf_dir).select(
        "device", "iface", "ts_us", F.col("event_id").alias("tie"), F.col("c_octets").alias("counter")
    )
    samples.write.parquet(landed)
    stream = spark.readStream.schema(samples.schema).parquet(landed)
    return _drained(spark, state.stream_rates(stream), "rates").withColumnRenamed("tie", "event_id").drop("ts_us")


def _in_any_order(spark: SparkSession, rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A stream over files that each hold rows of all times, then a heartbeat; and a delay that covers the disorder."""
    landed = run_dir(spark, label)
    rows = rows.withColumn("kind", F.col("kind") if "kind" in rows.columns else F.lit(ordered.SAMPLE))
    rows.repartition(3, F.xxhash64("tie")).write.parquet(landed)
    span = rows.agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last")).first()
    delay = ((span["last"] or 0) - (span["first"] or 0)) // 1_000_000 + 1
    beat = {"ts_us": (span["last"] or 0) + (delay + 1) * 1_000_000, "kind": ordered.HEARTBEAT}
    spark.range(1).select(*[F.lit(beat.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(landed)
    return stream, f"{delay} seconds"


def _drained_in_order(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    work = run_dir(spark, label)
    flows.each_batch(stream, ordered.to_folders(f"{work}/out", f"{work}/side"), f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out").drop("batch_id")


#: Time of a key's rows that are sorted together: keys of the events table have few rows a day.
SPARSE = 10 * 86_400_000_000


@query(
    "ts2_rates_of_shuffled_files",
    f"""with {RATES} select device, iface, event_id, cast(delta as bigint) as delta_octets, bps,
        max(bps) over (partition by device, iface order by ts_us, event_id rows between 69 preceding and current row) as peak_bps from bps""",
)
def ts2_rates_of_shuffled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of the batch job from files in no order of time."""
    state.use_state_store(spark)
    samples = ticks(spark, sf_dir).select(
        "device", "iface", "ts_us", F.col("event_id").alias("tie"), F.col("c_octets").alias("counter")
    )
    stream, delay = _in_any_order(spark, samples, "shuffled-ticks")
    rates = _drained_in_order(spark, ordered.ordered_rates(stream, delay, bucket_us=SPARSE, groups=state.GROUPS), "ordered-rates")
    return rates.withColumnRenamed("tie", "event_id").drop("ts_us")


@query(
    "ts3_bucket_mean",
    f"""with {POLLS}, w as (select (max(ts_us) - 600000000) // 1000 * 1000 as mark from polls)
        select device, ts_us - ts_us % 300000000 as bucket_us, count(*) as samples, cast(sum(octets) as bigint) as total,
               cast(sum(octets) as double) / count(*) as mean_value
        from polls, w where ts_us - ts_us % 300000000 + 300000000 <= mark group by 1, 2""",
)
def ts3_bucket_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir).select(
        F.col("user_id").alias("device"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("octets")
    )
    return _drained(spark, flows.bucket_means(events, "octets", ["device"]), "means")


@query(
    "ts3_bucket_mean_complete",
    f"""with {POLLS} select device, ts_us - ts_us % 300000000 as bucket_us, count(*) as samples, cast(sum(octets) as bigint) as total,
               cast(sum(octets) as double) / count(*) as mean_value from polls group by 1, 2""",
)
def ts3_bucket_mean_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, open ones too: what append mode leaves out until the watermark passes."""
    events = _event_stream(spark, sf_dir).select(
        F.col("user_id").alias("device"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("octets")
    )
    work = run_dir(spark, "all-means")
    means = flows.bucket_means(events, "octets", ["device"])
    flows.each_batch(means, flows.to_folder_per_batch(f"{work}/out"), f"{work}/checkpoint", "complete").awaitTermination()
    every = spark.read.parquet(f"{work}/out")
    latest = every.agg(F.max("batch_id").alias("batch_id"))
    return every.join(latest, "batch_id", "left_semi").drop("batch_id")


@query(
    "ts4_state_changes",
    f"""with {POLLS}, l as (select *, lag(iface) over (partition by device order by ts_us, event_id) as old from polls)
        select device, event_id, old as prev_state, iface as state from l where old <> iface""",
)
def ts4_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _polled(_event_stream(spark, sf_dir)).select("device", "ts_us", "tie", "state")
    changes = _drained(spark, state.stream_changes(samples), "changes")
    return changes.withColumnRenamed("tie", "event_id").drop("ts_us")


@query(
    "ts4_pauses",
    f"""with {POLLS}, n as (select *, case when iface in ('error', 'view') then 1 else 0 end as bad from polls),
        r as (select *, sum(bad) over (k rows between 2 preceding and current row) as run, coalesce(lag(bad, 3) over k, 0) as before
              from n window k as (partition by device order by ts_us, event_id))
        select device, event_id, cast(3 as bigint) as length from r where run = 3 and before = 0""",
)
def ts4_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = _polled(_event_stream(spark, sf_dir)).select("device", "ts_us", "tie", "failed")
    return _drained(spark, state.stream_pauses(polls), "pauses").withColumnRenamed("tie", "event_id").drop("ts_us")


@query(
    "ts4_changes_of_shuffled_files",
    f"""with {POLLS}, l as (select *, lag(iface) over (partition by device order by ts_us, event_id) as old from polls)
        select device, event_id, old as prev_state, iface as state from l where old <> iface""",
)
def ts4_changes_of_shuffled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions from files in no order of time."""
    state.use_state_store(spark)
    samples = _polled(table(spark, sf_dir, "events")).select("device", "ts_us", "tie", "state")
    stream, delay = _in_any_order(spark, samples, "shuffled-states")
    changes = _drained_in_order(spark, ordered.ordered_changes(stream, delay, SPARSE, groups=state.GROUPS), "ordered-changes")
    return changes.withColumnRenamed("tie", "event_id").drop("ts_us")


@query(
    "ts5_changing_selection",
    f"""with {TICKS}, m as (
          select device, iface, ts_us, event_id, 0 as ctl, c_octets, null as kind from ticks
          union all select device, iface, ts_us, event_id, 1, null, case when octets > 9000 then 'deselected' else 'selected' end
          from polls where octets > 9000 or octets < 1500),
        n as (
          select *, last_value(kind ignore nulls) over k as sel, sum(case when kind = 'deselected' then 1 else 0 end) over k as times
          from m window k as (partition by device, iface order by ts_us, event_id, ctl rows between unbounded preceding and current row)),
        l as (
          select *, lag(c_octets) over k as pc, lag(ts_us) over k as pt from n where ctl = 0 and coalesce(sel, 'selected') = 'selected'
          window k as (partition by device, iface, times order by ts_us, event_id)),
        r as (
          select *, case when pc is null or pc = 0 or c_octets < pc then 0 else c_octets - pc end as delta,
                 coalesce(ts_us - pt, 10000000) as elapsed_us from l),
        b as (select *, cast(delta * 8 as double) * 1000000.0 / cast(elapsed_us as double) as bps from r)
        select device, iface, event_id, cast(delta as bigint) as delta_octets, bps,
               max(bps) over (partition by device, iface, times order by ts_us, event_id rows between 69 preceding and current row) as peak_bps
        from b""",
)
def ts5_changing_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of interfaces while they are selected; a control row in the stream selects or deselects one from then on."""
    state.use_state_store(spark)
    samples = ticks(spark, sf_dir).select(
        "device", "iface", "ts_us", (F.col("event_id") * 2).alias("tie"), F.col("c_octets").alias("counter"),
        F.lit(ordered.SAMPLE).alias("kind"),
    )
    controls = polls(spark, sf_dir).filter("octets > 9000 or octets < 1500").select(
        "device", "iface", "ts_us", (F.col("event_id") * 2 + 1).alias("tie"), F.lit(0).cast("bigint").alias("counter"),
        F.when(F.col("octets") > 9000, ordered.DESELECTED).otherwise(ordered.SELECTED).alias("kind"),
    )
    stream, delay = _in_any_order(spark, samples.unionByName(controls), "selection")
    rates = _drained_in_order(spark, ordered.ordered_rates(stream, delay, bucket_us=SPARSE, groups=state.GROUPS), "selected-rates")
    return rates.select("device", "iface", (F.col("tie") / 2).cast("bigint").alias("event_id"), "delta_octets", "bps", "peak_bps")


@query(
    "ts5_selection",
    """select event_id, user_id, event_type from events
       where user_id in (select user_id from events where event_type = 'signup' and value > 50)""",
)
def ts5_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    def chosen(session: SparkSession) -> DataFrame:
        return table(session, sf_dir, "events").filter("event_type = 'signup' and value > 50").select("user_id")

    stream = _event_stream(spark, sf_dir).select("event_id", "user_id", "event_type")
    work = run_dir(spark, "selected")
    write = flows.selecting(chosen, ["user_id"], flows.to_folder_per_batch(f"{work}/out"))
    flows.each_batch(stream, write, f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out").drop("batch_id")


@query("ts6_without_repeats", "select user_id, event_type, epoch_us(ts) as ts_us, value from events")
def ts6_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = run_dir(spark, "repeats")
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value")
    events.unionByName(events.filter("value > 5")).write.parquet(landed)
    state.use_state_store(spark)
    stream = spark.readStream.schema(events.schema).parquet(landed)
    once = flows.without_repeats(stream, ["user_id", "event_type"], "60 days")
    return _drained(spark, once, "once").select("user_id", "event_type", F.unix_micros("ts").alias("ts_us"), "value")


@query(
    "ts7_line_sink",
    """select 'x_vpn_flows,hostname=dev-' || cast(user_id as varchar) || ' num_ipsec=' || cast(event_id % 9 as varchar) || 'i,num_sslvpn=0i,total_flows='
         || cast(event_id as varchar) || 'i ' || cast(event_id as varchar) || case when event_id = 0 then '' else '000000000' end as line from events""",
)
def ts7_line_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.sources import snapshots

    work = run_dir(spark, "lines")
    table(spark, sf_dir, "events").select(
        F.timestamp_micros(F.col("event_id") * 1_000_000).alias("collected_at"),
        F.lit("vpn").alias("module"),
        F.concat(F.lit("dev-"), F.col("user_id")).alias("device"),
        F.lit(True).alias("success"),
        F.struct(F.struct((F.col("event_id") % 9).alias("num_ipsec"), F.col("event_id").alias("total")).alias("vpn_flows")).alias("data"),
    ).write.json(f"{work}/landing")
    stream = snapshots.read_envelopes(spark, f"{work}/landing", streaming=True)
    write = flows.to_lines_and_metrics(f"{work}/lines", f"{work}/metrics", prefix="x_")
    flows.each_batch(stream, write, f"{work}/checkpoint").awaitTermination()
    return spark.read.text(f"{work}/lines").select(F.col("value").alias("line"))


@query("f08_stream_gate", "select event_id, value from events where event_id % 4 < 2")
def f08_stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches, of which the third has a third of its values below zero: the stream halts there."""
    work = run_dir(spark, "gate")
    events = table(spark, sf_dir, "events").select("event_id", "value")
    for i in range(4):
        spoilt = F.when((F.col("event_id") % 3 == 0) & (F.lit(i) == 2), -1.0).otherwise(F.col("value"))
        events.filter(F.col("event_id") % 4 == i).withColumn("value", spoilt).coalesce(1).write.mode("append").parquet(f"{work}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    write = gates.gated({"not negative": F.col("value") >= 0}, {"not negative": 0.9}, flows.to_folder_per_batch(f"{work}/out"), f"{work}/held")
    if not gates.ended_at_gate(flows.each_batch(stream, write, f"{work}/checkpoint")):
        raise RuntimeError("the gate let a bad batch pass")
    return spark.read.parquet(f"{work}/out").drop("batch_id")
