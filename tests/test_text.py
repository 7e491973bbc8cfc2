"""Scalars, line text, command output, filters."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import casts, display, lineproto, naming
from fleetlens.operators import filters, textparse


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    e = F.expr(expression) if isinstance(expression, str) else expression
    return [r.v for r in df.select("i", e.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "make, values, expected",
    [
        (casts.int_of_text, ["42", " -7 ", "12.5", "12d", "", None, "x"], [42, -7, None, None, None, None, None]),
        (casts.float_of_text, ["2.675", "0.125", "12d", "1e2", None], [2.67, 0.12, None, 100.0, None]),
        (casts.percent_of_text, ["0%", "12.5%", "", None, "x%"], [0.0, 12.5, None, None, None]),
        (
            casts.gigabytes_of_text,
            ["12G", "6.9G", "1024M", "1048576K", "2T", "0", None, "invalid"],
            [12.0, 6.9, 1 / 1024, 0.0009765625, 2048.0, 0.0, 0.0, None],
        ),
        (casts.mean_of_csv, ["0,0,1", " 4 , ,5", "1,x", "", None], [0.33, 4.5, None, None, None]),
        (casts.yes_no, ["yes", "no", "Yes", None], [True, False, None, None]),
        (textparse.uptime_seconds, ["3 days, 04:05:06", "04:05:06", "1 day, 0:00:07", "", None, "junk", "junk, 1:2:3", "2 days, junk"], [273906, 14706, 86407, 0, 0, 0, 0, 0]),
        (casts.text_kind, ["123", "-5", "1.5", "nan", "True", "abc", "+5"], ["integer", "integer", "float", "float", "boolean", "string", "float"]),
    ],
)
def test_scalars(spark, make, values, expected):
    expression = make(F.col("x")) if make is textparse.uptime_seconds else make("x")
    assert column(spark, values, expression) == expected


def test_binary_size_units(spark):
    assert column(spark, ["1024M", "1048576K"], casts.gigabytes_of_text("x", "binary")) == [1.0, 1.0]


def test_rounding_and_float_text_follow_the_exact_value(spark):
    values = [2.675, 1.005, 0.125, 0.375, -2.675, 1e16, 1.5e-7, 0.0001, 12345678.9, 100.0, 1 / 3, 1.7976931348623157e308]
    assert column(spark, values, casts.exact_round("x", 2), "double") == [round(v, 2) for v in values]
    assert column(spark, values, lineproto.float_text(F.col("x")), "double") == [str(v) for v in values]


def test_rounding_of_many_values(spark):
    rng = random.Random(11)
    values = [rng.randrange(10**8) / rng.choice([8, 16, 100, 1000, 10000]) for _ in range(20_000)]
    for digits in (0, 1, 2, 4):
        assert column(spark, values, casts.exact_round("x", digits), "double") == [float(round(v, digits)) for v in values]
    short = [round(v, 4) for v in values]
    assert column(spark, short, lineproto.float_text(F.col("x")), "double") == [str(v) for v in short]


def test_escape_round_trip(spark):
    rng = random.Random(12)
    values = ["".join(rng.choice("ab,= 1") for _ in range(rng.randrange(9))) for _ in range(300)]
    escaped = column(spark, values, lineproto.escaped(F.col("x")))
    assert [e.replace("\\,", ",").replace("\\=", "=").replace("\\ ", " ") for e in escaped] == values


def point(spark, tags, fields, strict=False):
    df = spark.createDataFrame(
        [("test", tags, fields, 99)],
        "m string, tags map<string,string>, fields map<string,struct<v_int:bigint,v_dbl:double,v_str:string,v_bool:boolean>>, ts bigint",
    )
    return df.select(lineproto.line(F.col("m"), F.col("tags"), F.col("fields"), F.col("ts"), strict).alias("l")).first().l


def test_lines(spark):
    assert point(spark, {}, {"value": (1, None, None, None)}) == "test value=1i 99"
    assert point(spark, {"a": "x"}, {"v": (None, None, None, None)}) is None
    fields = {"s": (None, None, 'say "hi"', None), "f": (None, 3.14, None, None), "b": (None, None, None, True), "n": (None,) * 4}
    assert point(spark, {"z": "1", "host": "val=ue, with spaces", "e": "", "n": None}, fields) == (
        r'test,host=val\=ue\,\ with\ spaces,z=1 b=true,f=3.14,s="say \"hi\"" 99'
    )
    assert point(spark, {}, {"s": (None, None, "a\\b\nc", None)}, strict=True) == 'test s="a\\\\b\\nc" 99'


def test_natural_order(spark):
    names = ["ethernet1/10", "ethernet1/2", "ae1", "ethernet1/1"]
    keys = column(spark, names, naming.natural_key(F.col("x")))
    assert [n for _, n in sorted(zip(keys, names))] == ["ae1", "ethernet1/1", "ethernet1/2", "ethernet1/10"]


def test_masks(spark):
    texts = ["api_key: abcd1234wxyz", "password=hunter2 ok", "token = abcdefgh", "plain"]
    assert column(spark, texts, naming.masked(F.col("x"))) == ["api_key: abcd***wxyz", "password=*** ok", "token = abcd***", "plain"]
    assert column(spark, texts, naming.is_sensitive(F.col("x"))) == [True, True, True, False]


def test_display(spark):
    assert column(spark, [999.0, 1335.0, 2.5e6, 1e9], display.bit_rate("x"), "double") == ["999 b/s", "1.33 Kb/s", "2.50 Mb/s", "1.00 Gb/s"]
    assert column(spark, [1023, 1536, 1 << 30], display.byte_volume("x"), "bigint") == ["1023 B", "1.50 KB", "1.00 GB"]
    assert column(spark, [90061, 3700, 65, 9], display.duration(F.col("x")), "bigint") == ["1d 1h", "1h 1m", "1m 5s", "9s"]
    assert column(spark, [0, 125], display.remaining(F.col("x")), "bigint") == ["N/A", "2m 5s"]


TOP = """top - 03:14:15 up 42 days,  7:05,  3 users,  load average: 1.25, 0.50, 2.75
Tasks: 310 total,   4 running, 300 sleeping,   5 stopped,   1 zombie
%Cpu(s): 12.5 us,  3.5 sy,  0.5 ni, 80.0 id,  2.0 wa,  0.3 hi,  0.7 si,  0.5 st
MiB Mem :   8000.0 total,   1000.5 free,   6000.0 used,    999.5 buff/cache
MiB Swap:   2048.0 total,   2000.0 free,     48.0 used.   1500.5 avail Mem
"""


def test_process_summary(spark):
    df = spark.createDataFrame([(1, TOP), (2, "too\nshort")], "k int, text string")
    rows = textparse.process_summary(df, F.col("text"), ["k"]).collect()
    assert len(rows) == 1
    cut = spark.createDataFrame([(1, TOP.replace("5 stopped", "").replace(" days", ""))], "k int, text string")
    less = textparse.process_summary(cut, F.col("text"), ["k"]).first()
    assert less.tasks_total is None and less.uptime_days is None and less.load_average_1min == 1.25 and less.cpu_steal == 0.5
    r = rows[0]
    assert (r.uptime_days, r.load_average_5min, r.tasks_sleeping, r.cpu_idle, r.memory_available_mib) == (42, 0.5, 300, 80.0, 1500.5)
    assert r.memory_usage_percent == 75.0 and r.swap_usage_percent == 48.0 / 2048.0 * 100


def test_disk_table(spark):
    text = "Filesystem Size Used Avail Use% Mounted on\n/dev/root 12G 9G 3G 80% /\n/dev/sda 20G 15G 5G 75% /data\nshort"
    rows = textparse.disk_table(spark.createDataFrame([(1, text)], "k int, t string"), F.col("t"), ["k"]).collect()
    assert {r.mount_point: r.use_percent for r in rows} == {"/": "80", "/data": "75"}


def test_raw_output_scan(spark, tmp_path):
    from fleetlens.sources.snapshots import read_output

    folder = tmp_path / "fw1"
    folder.mkdir()
    (folder / "show-system.txt").write_text(TOP)
    row = read_output(spark, str(tmp_path / "*")).first()
    assert (row.device, row.command, row.text) == ("fw1", "show-system", TOP)


def test_validators(spark):
    assert column(spark, ["1.2.3.4", "256.1.1.1", "::1", "fe80::1", "x", None], filters.is_ip(F.col("x"))) == [True, False, True, True, False, False]
    assert column(spark, ["443", "0", "65536", "x", None], filters.is_port("x")) == [True, False, False, False, False]
    assert column(spark, ["2024-01-01T00:00:00Z", "2024-02-30", "nope", ""], filters.is_timestamp(F.col("x"))) == [True, False, False, False]
    assert column(spark, ["a.b-c.de", "-a", "a..b", ""], filters.is_hostname(F.col("x"))) == [True, False, False, False]


def test_toggles(spark):
    rules = spark.createDataFrame(
        [("m", None, None, True), ("m", None, "d1", False), ("off", None, None, False), ("off", None, "d1", True), ("m", "c", None, False), ("m", "c", "d2", True)],
        "module string, collection string, device string, enabled boolean",
    )
    cases = [("m", "c", "d1"), ("m", "c", "d2"), ("m", "c", "d3"), ("m", "x", "d3"), ("off", "c", "d1"), ("new", "c", "d1")]
    df = spark.createDataFrame(cases, "m string, c string, d string")
    kept = {tuple(r) for r in filters.collectable(df, rules, "m", "c", "d").select("m", "c", "d").collect()}
    assert kept == {("m", "c", "d2"), ("m", "x", "d3"), ("new", "c", "d1")}
