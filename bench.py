"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "circuit_health", "circuit_health_daily", "transformer_hourly_load", "daily_usage", "peak_hours", "hour_profile", "segment_consumption", "voltage_issue_meters",
    "monthly_usage", "join_interval", "rolling_avg", "lag_features", "consecutive_run", "composite_risk", "high_risk_transformers", "meters_near", "nearest_match",
    "bfs_waves", "degree_reach", "pagerank", "load_model", "text_search", "chunk_text", "semantic_query", "global_sequence", "merge_upsert", "stream_tumbling",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from wattline.plans.catalog import runner
    from wattline.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        runs = []
        for _ in range(repeats + 1):  # the first run warms up
            start = time.perf_counter()
            runner(name)(spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
