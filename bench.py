"""Times the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from fundlens.plans.registry import load_all
from fundlens.session import build_session

HEADLINE = (
    "vendor_stats", "category_benchmarks", "risk_profiles", "top_risk_works", "score_proposals",
    "mp_dashboard", "district_dashboard", "region_rollup", "split_invoicing_runs", "duplicate_works",
    "latest_alert_state", "district_comparison", "upsert_works", "assign_vendor_ids", "validate_rows",
    "triage_keywords", "invoice_diffs", "assess_feedback", "audit_answers", "top_k_vectors",
    "rate_limit", "duplicate_photos", "cosine_pairs", "cooccurrence_edges", "connected_components",
    "alert_details", "union_signals", "double_funding_pairs", "complaint_clusters", "ingest_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    # Starts the JVM paths and a Python worker outside the timings.
    queries["record_counts"].run(spark, sf_dir).collect()
    queries["top_k_vectors"].run(spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
