"""Headline queries timed on the given tables; prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    cores of the local session (default 8)
BENCH_RUNS    runs per query, the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlens.queries import all_queries
from fleetlens.session import local_session

HEADLINE = (
    "a10_bucket_rate_5min",
    "w1_counter_rate",
    "w4_rolling_peak",
    "w11_failure_streak",
    "j3_source_merge",
    "j6_validity",
    "a1_protocol_counts",
    "k3_top_by_value",
    "n01_one_or_many",
    "pj10_disk_usage",
    "pj21_interface_counters_logical",
    "pj25_routing_table_counts",
    "pj45_wide_to_long",
    "p12_named_numbers",
    "p19_line",
    "p24_mask_secrets",
    "h2_alerts",
    "c2_value_profile",
    "x1_dictionary",
    "x6_compound_text",
    "x_documents",
    "s2_envelope_explode",
    "w13_epoch_reset",
    "ts2_stream_rate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="12g")
    registered = all_queries()
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            started = time.time()
            registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - started)
        seconds[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
