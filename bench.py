"""Time the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs to completion (all rows and columns computed, written to the noop sink).
"""

from __future__ import annotations

import json
import os
import time

from tidemark.session import build_session
from tidemark.workload.registry import all_queries
from tidemark.workload.views import Views, flat

HEADLINE = [
    "latest_version", "merge_insert_only", "merge_upsert_newest", "validate_market",
    "validate_usage", "asof_lookback", "asof_join", "silver_changes", "silver_dominance",
    "silver_comparison", "asset_enriched", "macro_context", "market_features", "gold_rankings",
    "gold_movers", "latest_movers", "serving_readiness", "route_health", "release_readiness",
    "alert_backlog", "run_readiness", "evaluate_alerts", "p95_floor", "event_alerts",
    "readiness_blockers", "cost_by_tier", "latency_quartiles", "classify_route", "classify_tier",
    "sanitize", "merge_sources", "drift_psi", "rate_limit", "anomaly_scores"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = all_queries(), {}
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    for name in HEADLINE:
        started = time.perf_counter()
        flat(known[name][0](Views(spark, folder))).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
