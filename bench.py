"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and three times timed, its rows consumed by a no-op sink; the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from telespark.plans.queries import all_queries  # noqa: E402

HEADLINE = (
    "fleet_status", "fleet_analytics", "fleet_health_trend", "mission_completions", "recent_per_robot", "overlay_live",
    "normalize_telemetry", "validate_telemetry", "unified_feed", "coalesce_live_minute", "create_commands", "dispatch_pending",
    "apply_status_updates", "update_outcomes", "geofence_alerts", "hysteresis_thermal", "pick_dispatch_candidates",
    "request_summary", "latency_percentiles", "rate_limit_decisions", "retention_job", "ingest_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    timings = {}
    for name in names:
        runs = []
        for _ in range(4):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        timings[name] = round(median(runs[1:]), 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
