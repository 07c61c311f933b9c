"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs twice and the second run is reported; results go to the no-op sink, so all
columns are computed and nothing is collected.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "monthly_habits", "active_time_union", "capped_gap_durations", "longest_burst", "error_recovery", "grounded_writes",
    "strict_recovery_classes", "edit_run_depth", "category_counts_grouping_sets", "depth_stats_nearest_rank", "fanout_stats",
    "cumulative_to_delta", "coverage_months", "nested_coverage", "per_message_accounting", "human_prompts", "safe_quotes",
    "cli_heads", "dedup_rank", "session_eligibility", "axis_values",
]


def main() -> None:
    from pyspark.sql import SparkSession
    from loomtrace import catalog
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("loomtrace-bench").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    reg = catalog.load()
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            t0 = time.time()
            reg[name].run(spark, root).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
    sf = root.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
