"""Risk profile of sanctioned works and signal handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.functions.numbers import count_when

# Rule limits and severities.
OVERRUN_FACTOR = 1.5
OVERRUN_SCALE = 2.5
GHOST_FINANCIAL_FROM = 80
GHOST_PHYSICAL_UPTO = 20
GHOST_SEVERITY = 0.95
STALLED_SEVERITY = 0.70
HUB_SEVERITY = 0.65
BASE_RISK = 0.1
HUB_NETWORK_RISK = 0.88
PLAIN_NETWORK_RISK = 0.25


def is_overrun(factor: float = OVERRUN_FACTOR, bound: str = "benchmark_max") -> Column:
    amount = F.col("sanction_amount").cast("double")
    return F.coalesce(amount > F.col(bound) * F.lit(factor), F.lit(False))


def is_ghost() -> Column:
    return (F.col("financial_progress_pct") >= GHOST_FINANCIAL_FROM) & (
        F.col("physical_progress_pct") <= GHOST_PHYSICAL_UPTO
    )


def _signal(when: Column, kind: str, severity: Column, reason: Column) -> Column:
    return F.when(
        when,
        F.struct(F.lit(kind).alias("signal_type"), severity.alias("severity"), reason.alias("reason")),
    )


def flag_hub_vendor(works: DataFrame, vendors: DataFrame) -> DataFrame:
    """Adds ``is_hub_vendor``: the work's vendor is marked as a hub."""
    hubs = vendors.where("is_hub").select("vendor_id", F.lit(True).alias("is_hub_vendor")).distinct()
    return works.join(hubs, "vendor_id", "left").withColumn(
        "is_hub_vendor", F.coalesce("is_hub_vendor", F.lit(False))
    )


def risk_profiles(works: DataFrame, benchmarks: DataFrame, vendors: DataFrame) -> DataFrame:
    """Every work with ``risk_signals``, ``total_risk_signals``, ``composite_risk_score`` and
    ``risk_bucket``."""
    bound = benchmarks.select("work_category", F.col("max").alias("benchmark_max"))
    amount = F.col("sanction_amount").cast("double")
    signals = F.array_compact(
        F.array(
            _signal(
                is_overrun(),
                "COST_OVERRUN_ANOMALY",
                F.least(F.lit(1.0), amount / (F.col("benchmark_max") * OVERRUN_SCALE)),
                F.format_string(
                    "Sanction amount %,.2f exceeds benchmark maximum %,.2f by more than 50%%",
                    amount, F.col("benchmark_max"),
                ),
            ),
            _signal(
                is_ghost(),
                "GHOST_PROJECT_SUSPECT",
                F.lit(GHOST_SEVERITY),
                F.format_string(
                    "Financial progress is %.0f%% but physical completion is only %.0f%%",
                    F.col("financial_progress_pct"), F.col("physical_progress_pct"),
                ),
            ),
            _signal(
                F.col("work_status") == "Stalled",
                "WORK_STALLED",
                F.lit(STALLED_SEVERITY),
                F.lit("Work is officially flagged as stalled."),
            ),
            _signal(
                F.col("is_hub_vendor"),
                "HUB_VENDOR_CONCENTRATION",
                F.lit(HUB_SEVERITY),
                F.concat(F.lit("Vendor "), F.col("vendor_id"), F.lit(" is a high-concentration hub.")),
            ),
        )
    )
    joined = flag_hub_vendor(works.join(bound, "work_category", "left"), vendors)
    score = F.coalesce(
        F.array_max(F.transform("risk_signals", lambda s: s.severity)), F.lit(BASE_RISK)
    )
    return (
        joined.withColumn("risk_signals", signals)
        .withColumn("total_risk_signals", F.size("risk_signals"))
        .withColumn("composite_risk_score", score)
        .withColumn("risk_bucket", risk_bucket(F.col("composite_risk_score")))
    )


def risk_bucket(score: Column) -> Column:
    return F.when(score >= 0.7, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")


def profile_signals(profiles: DataFrame, key: str = "unique_work_number") -> DataFrame:
    """One row per signal of a work."""
    return profiles.select(key, F.explode("risk_signals").alias("s")).select(key, "s.*")


def vendor_network_flags(vendors: DataFrame) -> DataFrame:
    hub = F.coalesce(F.col("is_hub"), F.lit(False))
    return vendors.select(
        "vendor_id",
        F.when(hub, F.lit(HUB_NETWORK_RISK)).otherwise(F.lit(PLAIN_NETWORK_RISK)).alias(
            "risk_score"
        ),
        F.when(hub, F.lit("High-concentration hub vendor."))
        .otherwise(F.lit("Normal contractor network metrics."))
        .alias("reason"),
    )


def union_signals(**by_module: DataFrame) -> DataFrame:
    """All modules' signals in one frame: module, subject_id, signal_type, severity, reason.

    The first column of each input names the subject.
    """
    parts = [
        df.select(
            F.lit(module).alias("module"),
            F.col(df.columns[0]).cast("string").alias("subject_id"),
            "signal_type",
            F.col("severity").cast("double").alias("severity"),
            "reason",
        )
        for module, df in by_module.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def detector_quality(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """TP, FP, FN, TN, precision, recall and F1 of a detector against labels, in one pass."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    counts = df.agg(
        count_when(p & a).alias("tp"),
        count_when(p & ~a).alias("fp"),
        count_when(~p & a).alias("fn"),
        count_when(~p & ~a).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )
