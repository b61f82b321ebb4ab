"""Named queries over the driver tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fundlens.sources.driver_tables import shared_lines

# Queries that read the works more than once: their lines are scanned once and stored.
SHARED_WORKS = frozenset((
    "alerts_from_works", "latest_alert_state", "audit_rows", "action_notifications", "sla_tiers", "escalation_queue",
    "sla_warnings", "live_counters", "scoped_alerts", "search_alerts", "alert_details", "case_bundles",
    "evidence_counts", "district_alerts", "top_risk_queue", "district_comparison", "photo_time_check", "risk_profiles",
    "top_risk_works", "work_risk_signals", "score_proposals", "score_factors", "factor_reasons", "fill_vendor_history", "score_signals",
    "recommendations", "score_by_label", "proposal_alerts", "union_signals", "assess_feedback", "rejected_feedback",
    "feedback_alerts", "sla_monitor_stream", "feedback_stream", "reference_band", "threshold_sweep", "category_benchmarks",
    "near_duplicate_works", "near_duplicate_members", "feedback_sinks_stream",
))

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None


QUERIES: dict[str, Query] = {}


def _sharing(fn: QueryFn) -> QueryFn:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with shared_lines():
            return fn(spark, sf_dir)

    return run


def query(sql: str | None = None):
    """Register the decorated function under its name."""

    def add(fn: QueryFn) -> QueryFn:
        if fn.__name__ in QUERIES:
            raise ValueError(f"duplicate query {fn.__name__}")
        QUERIES[fn.__name__] = Query(fn.__name__, _sharing(fn) if fn.__name__ in SHARED_WORKS else fn, sql)
        return fn

    return add


def load_all() -> dict[str, Query]:
    from fundlens.plans import (  # noqa: F401
        alert_queries,
        dashboard_queries,
        ingest_queries,
        network_queries,
        risk_queries,
        signal_queries,
        stream_queries,
        text_queries,
    )

    return QUERIES
