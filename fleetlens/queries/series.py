"""Counter rates, rolling peaks, state changes, streaks and time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.display import bit_rate, rate_band
from fleetlens.operators import rollup, series
from fleetlens.plans.ticks import polls, ticks
from fleetlens.queries import query

ORDER = ("ts_us", "event_id")
TICK = {"octets": ("c_octets",), "order": ORDER}

POLLS = """polls as (
  select user_id as device, event_type as iface, epoch_us(ts) as ts_us, event_id,
         cast(round(value * 100) as bigint) as octets from events)"""
TICKS = (
    POLLS
    + """, ticks as (
  select device, iface, ts_us, event_id, octets,
         cast(sum(octets) over (partition by device, iface order by ts_us, event_id) % 50000 as bigint) as c_octets
  from polls)"""
)
RATES = (
    TICKS
    + """, lagged as (
  select *, lag(c_octets) over k as pc, lag(ts_us) over k as pt from ticks
  window k as (partition by device, iface order by ts_us, event_id)),
rates as (
  select *, case when pc is null or pc = 0 or c_octets < pc then 0 else c_octets - pc end as delta,
         coalesce(ts_us - pt, 10000000) as elapsed_us from lagged),
bps as (select *, cast(delta * 8 as double) * 1000000.0 / cast(elapsed_us as double) as bps from rates)"""
)
FRAME = "partition by device, iface order by ts_us, event_id"


@query(
    "w1_counter_rate",
    f"with {RATES} select device, iface, event_id, cast(delta as bigint) as delta_octets, bps from bps",
)
def w1_counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = series.counter_rates(ticks(spark, sf_dir), **TICK)
    return rates.select(
        "device", "iface", "event_id", F.col("delta_c_octets").alias("delta_octets"), F.col("c_octets_bps").alias("bps")
    )


@query(
    "w1_packet_rate",
    f"""with {RATES} select device, iface, event_id,
        cast(case when pc is null or c_octets < pc then 0 else c_octets - pc end as double) * 1000000.0
          / cast(elapsed_us as double) as pps from bps""",
)
def w1_packet_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = series.counter_rates(
        ticks(spark, sf_dir), octets=(), packets=("c_octets",), order=ORDER, zero_is_unknown=False
    )
    return rates.select("device", "iface", "event_id", F.col("c_octets_pps").alias("pps"))


@query(
    "w2_error_delta",
    f"""with {RATES} select device, iface, event_id,
        cast(case when pc is null then 0 else greatest(c_octets - pc, 0) end as bigint) as delta_errors from rates""",
)
def w2_error_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = series.counter_rates(ticks(spark, sf_dir), octets=(), events=("c_octets",), order=ORDER)
    return rates.select("device", "iface", "event_id", F.col("delta_c_octets").alias("delta_errors"))


@query(
    "w3_elapsed",
    f"with {RATES} select device, iface, event_id, elapsed_us, pt is null as is_first from rates",
)
def w3_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = series.counter_rates(polls(spark, sf_dir), octets=(), order=ORDER)
    return rates.select("device", "iface", "event_id", "elapsed_us", "is_first")


@query(
    "w4_rolling_peak",
    f"""with {RATES} select device, iface, event_id,
        max(bps) over ({FRAME} rows between 69 preceding and current row) as peak_bps from bps""",
)
def w4_rolling_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = series.poll_records(ticks(spark, sf_dir), **TICK)
    return records.select("device", "iface", "event_id", F.col("c_octets_peak_bps").alias("peak_bps"))


@query(
    "w5_poll_history",
    f"""with {RATES}, kept as (
        select *, row_number() over (partition by device, iface order by ts_us desc, event_id desc) as recency
        from bps where pc is not null)
        select device, iface, event_id, cast(delta as bigint) as delta_octets, bps, recency from kept where recency <= 70""",
)
def w5_poll_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = series.poll_history(series.counter_rates(ticks(spark, sf_dir), **TICK), order=ORDER)
    return history.select(
        "device",
        "iface",
        "event_id",
        F.col("delta_c_octets").alias("delta_octets"),
        F.col("c_octets_bps").alias("bps"),
        F.col("recency").cast("bigint").alias("recency"),
    )


@query(
    "w6_significant_change",
    f"""with {RATES}, before as (select *, coalesce(lag(bps) over ({FRAME}), 0.0) as old from bps)
        select device, iface, event_id from before where abs(bps - old) / greatest(old, 1.0) > 0.01""",
)
def w6_significant_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = series.poll_records(ticks(spark, sf_dir), **TICK)
    return records.filter("changed").select("device", "iface", "event_id")


@query(
    "w7_area_graph",
    f"""with {RATES}, kept as (
        select *, row_number() over (partition by device, iface order by ts_us desc, event_id desc) as recency from bps),
        scaled as (select *, greatest(max(bps) over (partition by device, iface), 1000.0) * 1.1 as scale_max
                   from kept where recency <= 70)
        select device, iface, cast(recency as bigint) as slot_from_right, scale_max,
               least(greatest(bps / scale_max * 24, 0.0), 24.0) as level from scaled""",
)
def w7_area_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = series.area_graph(
        series.counter_rates(ticks(spark, sf_dir), **TICK), "c_octets_bps", "c_octets_bps", order=ORDER
    )
    slots = graph.select("device", "iface", "scale_max", F.posexplode("levels").alias("pos", "level"))
    return slots.filter(F.col("level").isNotNull()).select(
        "device", "iface", (F.lit(70) - F.col("pos")).cast("bigint").alias("slot_from_right"), "scale_max", "level"
    )


@query(
    "w8_derivative",
    f"""with {RATES} select device, iface, event_id,
        cast(c_octets - pc as double) * 1000000.0 / cast(ts_us - pt as double) as per_second
        from rates where c_octets >= pc and ts_us > pt""",
)
def w8_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = series.derivative(ticks(spark, sf_dir), ("device", "iface"), "c_octets", ORDER)
    return grown.select("device", "iface", "event_id", "per_second")


@query(
    "w9_state_change",
    f"""with {POLLS}, l as (select *, lag(iface) over (partition by device order by ts_us, event_id) as old from polls)
        select device, event_id, old as prev_state, iface as state from l where old <> iface""",
)
def w9_state_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = series.state_changes(polls(spark, sf_dir), "iface", ("device",), ORDER)
    return changes.select("device", "event_id", F.col("prev_iface").alias("prev_state"), F.col("iface").alias("state"))


@query(
    "w9_flap_rise",
    f"with {RATES} select device, iface, event_id, c_octets - pc as rise from rates where c_octets > pc",
)
def w9_flap_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rises = series.counter_rises(ticks(spark, sf_dir), "c_octets", ("device", "iface"), ORDER)
    return rises.select("device", "iface", "event_id", (F.col("c_octets") - F.col("prev_c_octets")).alias("rise"))


@query(
    "w10_sustained",
    f"""with {POLLS}, r as (select *,
          sum(case when octets > 1000 then 1 else 0 end)
            over (partition by device order by ts_us, event_id rows between 2 preceding and current row) as run
        from polls)
        select device, event_id, octets from r where run = 3""",
)
def w10_sustained(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = series.sustained(polls(spark, sf_dir), F.col("octets") > 1000, 3, ("device",), ORDER)
    return held.select("device", "event_id", "octets")


@query(
    "w11_failure_streak",
    f"""with {POLLS}, n as (select *,
          sum(case when iface <> 'error' then 1 else 0 end) over (partition by device order by ts_us, event_id) as run
        from polls)
        select device, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as length
        from n where iface = 'error' group by device, run having count(*) >= 2""",
)
def w11_failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.failure_streaks(polls(spark, sf_dir), F.col("iface") == "error", ("device",), ORDER, 2)


@query(
    "w11_auto_pause",
    f"""with {POLLS}, n as (select *, case when iface in ('error', 'view') then 1 else 0 end as bad from polls),
        r as (select *, sum(bad) over (k rows between 2 preceding and current row) as run,
                     coalesce(lag(bad, 3) over k, 0) as before
              from n window k as (partition by device order by ts_us, event_id))
        select device, event_id, ts_us from r where run = 3 and before = 0""",
)
def w11_auto_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("iface").isin("error", "view")
    return series.pauses(polls(spark, sf_dir), failed, ("device",), ORDER).select("device", "event_id", "ts_us")


@query(
    "w12_reboot",
    f"""with {RATES} select device, iface, event_id, pc as prev_uptime, c_octets as uptime
        from rates where pc > c_octets""",
)
def w12_reboot(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = series.reboots(ticks(spark, sf_dir), "c_octets", ("device", "iface"), ORDER)
    return down.select(
        "device", "iface", "event_id", F.col("prev_c_octets").alias("prev_uptime"), F.col("c_octets").alias("uptime")
    )


@query(
    "w13_epoch_reset",
    f"""with {POLLS}, e as (select *,
          cast(sum(case when iface = 'signup' then 1 else 0 end)
            over (partition by device order by ts_us, event_id) as bigint) as epoch
        from polls),
        d as (select *, lag(octets) over (partition by device, epoch order by ts_us, event_id) as p from e)
        select device, event_id, epoch, case when p is null or octets < p then 0 else octets - p end as delta from d""",
)
def w13_epoch_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = series.with_epochs(polls(spark, sf_dir), F.col("iface") == "signup", ("device",), ORDER)
    rates = series.counter_rates(
        numbered, octets=("octets",), keys=("device", "epoch"), order=ORDER, zero_is_unknown=False
    )
    return rates.select("device", "event_id", "epoch", F.col("delta_octets").alias("delta"))


def _bucket_sql(width_us: int) -> str:
    return f"""with {RATES}
        select device, cast(ts_us - ts_us % {width_us} as bigint) as bucket_us, count(*) as samples,
               cast(sum(delta) as bigint) as octets,
               cast(sum(delta * 8000000 // elapsed_us) as bigint) as sum_bps,
               cast(max(delta * 8000000 // elapsed_us) as bigint) as max_bps
        from rates group by 1, 2"""


def _bucket_rate(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    rates = series.counter_rates(ticks(spark, sf_dir), **TICK)
    return rollup.time_buckets(rates, ("device",), seconds).agg(
        F.count("*").alias("samples"),
        F.sum("delta_c_octets").alias("octets"),
        F.expr("sum(delta_c_octets * 8000000 div elapsed_us)").alias("sum_bps"),
        F.expr("max(delta_c_octets * 8000000 div elapsed_us)").alias("max_bps"),
    )


@query("a10_bucket_rate_5min", _bucket_sql(300_000_000))
def a10_bucket_rate_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucket_rate(spark, sf_dir, 300)


@query("a10_bucket_rate_1day", _bucket_sql(86_400_000_000))
def a10_bucket_rate_1day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucket_rate(spark, sf_dir, 86_400)


@query(
    "a10_bucket_mean",
    f"""with {POLLS}
        select device, cast(ts_us - ts_us % 3600000000 as bigint) as bucket_us,
               cast(sum(octets) as double) / count(*) as mean_value, min(octets) as min_value, max(octets) as max_value,
               cast(sum(octets) as bigint) as sum_value, count(*) as samples,
               arg_min(octets, ts_us) as first_value, arg_max(octets, ts_us) as last_value
        from polls where ts_us > (select max(ts_us) from polls) - 864000000000 group by 1, 2""",
)
def a10_bucket_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = polls(spark, sf_dir)
    return rollup.bucket_stats(rollup.last_interval(samples, 10 * 86_400), "octets", ("device",), 3600)


@query(
    "a12_fleet_total",
    f"""with {RATES}, latest as (
        select *, row_number() over (partition by device, iface order by ts_us desc, event_id desc) as n from rates)
        select count(*) as interfaces, cast(sum(delta) as bigint) as delta_octets,
               cast(sum(delta * 8000000 // elapsed_us) as bigint) as total_bps from latest where n = 1""",
)
def a12_fleet_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = series.counter_rates(ticks(spark, sf_dir), **TICK)
    return rollup.fleet_total(
        rates,
        ("device", "iface"),
        ORDER,
        interfaces=F.count("*"),
        delta_octets=F.sum("delta_c_octets"),
        total_bps=F.expr("sum(delta_c_octets * 8000000 div elapsed_us)"),
    )


@query(
    "h4_rate_band",
    f"""with {RATES}, v as (select *, cast(delta as double) * 20000 as r from rates)
        select device, iface, event_id,
               case when r >= 1e9 then '1G' when r >= 1e8 then '100M' when r >= 1e7 then '10M'
                    when r >= 1e6 then '1M' else 'low' end as band,
               case when r >= 1e9 then format('{{:.2f}} Gb/s', r / 1e9) when r >= 1e6 then format('{{:.2f}} Mb/s', r / 1e6)
                    when r >= 1e3 then format('{{:.2f}} Kb/s', r / 1e3) else format('{{:.0f}} b/s', r) end as rate
        from v""",
)
def h4_rate_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = series.counter_rates(ticks(spark, sf_dir), **TICK)
    scaled = rates.withColumn("r", F.col("delta_c_octets").cast("double") * 20000)
    return scaled.select("device", "iface", "event_id", rate_band(F.col("r")).alias("band"), bit_rate("r").alias("rate"))
