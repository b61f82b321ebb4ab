"""Pre-sanction score of work proposals: six explainable factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.functions.numbers import round_even

# Factor weights, concern thresholds, monsoon months, level limits.
DEFAULT_WEIGHTS = {
    "vendor_delay_history": 0.25,
    "vendor_anomaly_history": 0.20,
    "amount_vs_benchmark": 0.20,
    "new_vendor": 0.15,
    "seasonal_risk": 0.10,
    "region_risk": 0.10,
}
DEFAULT_THRESHOLDS = {
    "delay_ratio_concern": 0.30,
    "anomaly_ratio_concern": 0.20,
    "amount_overshoot_pct": 20.0,
}
MONSOON_MONTHS = (6, 7, 8, 9)
HIGH_FROM = 0.6
MEDIUM_FROM = 0.3
KEY_FACTOR_FROM = 0.05
# Fixed texts: what to do at each level.
RECOMMENDATIONS = {
    "HIGH": "Flag for scrutiny: high risk detected across historical factors.",
    "MEDIUM": "Review recommended: moderate risk signals present.",
    "LOW": "Proceed to sanction: low risk profile.",
    "INSUFFICIENT_DATA": "Hold proposal: insufficient data for reliable scoring.",
}


def fill_vendor_history(proposals: DataFrame, stats: DataFrame) -> DataFrame:
    """Take history from the vendor statistics where the caller gave none."""
    history = stats.select("vendor_id", "total", "delays", "anomalies")
    ask = (F.col("vendor_total_projects") == 0) & F.col("total").isNotNull()
    return (
        proposals.join(history, "vendor_id", "left")
        .withColumns(
            {
                "vendor_past_delays": F.when(ask, F.col("delays")).otherwise(
                    F.col("vendor_past_delays")
                ),
                "vendor_past_anomalies": F.when(ask, F.col("anomalies")).otherwise(
                    F.col("vendor_past_anomalies")
                ),
                "vendor_total_projects": F.when(ask, F.col("total")).otherwise(
                    F.col("vendor_total_projects")
                ),
            }
        )
        .drop("total", "delays", "anomalies")
    )


def fill_benchmark(proposals: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Take the category median where the caller gave no benchmark amount."""
    medians = benchmarks.select(F.col("work_category").alias("category"), "median")
    return (
        proposals.join(medians, "category", "left")
        .withColumn(
            "category_benchmark_amount", F.coalesce("category_benchmark_amount", "median")
        )
        .drop("median")
    )


def _percent_text(ratio: Column) -> Column:
    return F.concat(F.rint(ratio * 100).cast("int").cast("string"), F.lit("%"))


def _factor(name: str, raw: Column, weight: float, contribution: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(name).alias("factor_name"),
        raw.cast("double").alias("raw_value"),
        F.lit(float(weight)).alias("weight"),
        round_even(contribution, 4).alias("contribution"),
        reason.alias("reason"),
    )


def _history_factor(name: str, word: str, count: str, weight: float, concern: float) -> Column:
    total, bad = F.col("vendor_total_projects"), F.col(count)
    ratio = bad / total
    known = total != 0
    share = F.concat(bad.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" past projects"))
    limit = F.concat(F.lit(f"{concern * 100:.0f}% concern threshold"))
    reason = (
        F.when(~known, F.lit(f"No prior projects on record; {word} history unavailable."))
        .when(
            ratio > concern,
            F.concat(
                F.lit(f"Vendor {word} rate is "), _percent_text(ratio), F.lit(" ("), share,
                F.lit("), above the "), limit, F.lit("."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit(f"Vendor {word} rate is "), _percent_text(ratio), F.lit(" ("), share,
                F.lit("), within acceptable range."),
            )
        )
    )
    return _factor(
        name,
        F.when(known, round_even(ratio, 3)),
        weight,
        F.when(known, F.least(F.lit(1.0), ratio) * weight).otherwise(F.lit(0.0)),
        reason,
    )


def _amount_factor(weight: float, overshoot_pct: float) -> Column:
    amount = F.col("sanction_amount").cast("double")
    benchmark = F.col("category_benchmark_amount").cast("double")
    usable = benchmark.isNotNull() & (benchmark != 0)
    over = F.when(usable, (amount - benchmark) / benchmark * 100)
    contribution = (
        F.when(over > overshoot_pct, F.least(F.lit(1.0), over / 100.0) * weight)
        .when(over > 0, (over / overshoot_pct) * 0.3 * weight)
        .otherwise(F.lit(0.0))
    )
    over_text = F.format_string("%+.1f%%", round_even(over, 1))
    reason = (
        F.when(benchmark.isNull(), "No category benchmark amount; cannot judge the amount.")
        .when(benchmark == 0, "Category benchmark is zero; cannot compute overshoot.")
        .when(
            over > overshoot_pct,
            F.concat(
                F.lit("Proposed amount is "), over_text,
                F.lit(f" against the benchmark, above the {overshoot_pct:.0f}% concern threshold."),
            ),
        )
        .when(
            over > 0,
            F.concat(
                F.lit("Proposed amount is "), over_text,
                F.lit(" against the benchmark, within acceptable range."),
            ),
        )
        .otherwise(
            F.concat(F.lit("Proposed amount is at or below the benchmark ("), over_text, F.lit(")."))
        )
    )
    return _factor("amount_vs_benchmark", round_even(over, 2), weight, contribution, reason)


def _new_vendor_factor(weight: float) -> Column:
    new = F.col("vendor_total_projects") == 0
    return _factor(
        "new_vendor",
        F.when(new, F.lit(1.0)).otherwise(F.lit(0.0)),
        weight,
        F.when(new, F.lit(weight * 0.7)).otherwise(F.lit(0.0)),
        F.when(new, F.lit("New vendor without prior projects; track record unknown.")).otherwise(
            F.concat(
                F.lit("Vendor has "), F.col("vendor_total_projects").cast("string"),
                F.lit(" prior project(s) on record."),
            )
        ),
    )


def _season_factor(weight: float) -> Column:
    wet = F.col("season_month").isin(*MONSOON_MONTHS)
    month = F.col("season_month").cast("string")
    return _factor(
        "seasonal_risk",
        F.when(wet, F.lit(1.0)).otherwise(F.lit(0.0)),
        weight,
        F.when(wet, F.lit(weight * 0.8)).otherwise(F.lit(0.0)),
        F.when(
            wet, F.concat(F.lit("Month "), month, F.lit(" is in the monsoon season (Jun-Sep)."))
        ).otherwise(F.concat(F.lit("Month "), month, F.lit(" is outside the monsoon season."))),
    )


def _region_factor(weight: float) -> Column:
    score = F.col("region_risk_score")
    text = F.format_string("%.2f", round_even(score, 2))
    return _factor(
        "region_risk",
        score,
        weight,
        F.coalesce(score * weight, F.lit(0.0)),
        F.when(score.isNull(), F.lit("No region risk score supplied; factor not evaluated."))
        .when(
            score > 0.6,
            F.concat(
                F.lit("Region '"), F.col("region"), F.lit("' has an elevated risk score of "), text,
                F.lit("."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Region '"), F.col("region"), F.lit("' has a normal risk score of "), text,
                F.lit("."),
            )
        ),
    )


def score_proposals(
    proposals: DataFrame,
    weights: dict[str, float] | None = None,
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """Adds ``factors``, ``overall_score``, ``risk_level``, ``warnings`` and ``recommendation``."""
    w = {**DEFAULT_WEIGHTS, **(weights or {})}
    t = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    factors = F.array(
        _history_factor(
            "vendor_delay_history", "delay", "vendor_past_delays",
            w["vendor_delay_history"], t["delay_ratio_concern"],
        ),
        _history_factor(
            "vendor_anomaly_history", "anomaly", "vendor_past_anomalies",
            w["vendor_anomaly_history"], t["anomaly_ratio_concern"],
        ),
        _amount_factor(w["amount_vs_benchmark"], t["amount_overshoot_pct"]),
        _new_vendor_factor(w["new_vendor"]),
        _season_factor(w["seasonal_risk"]),
        _region_factor(w["region_risk"]),
    )
    total = F.aggregate("factors", F.lit(0.0), lambda acc, f: acc + f.contribution)
    missing = F.size(F.filter("factors", lambda f: f.raw_value.isNull()))
    level = (
        F.when(missing >= 3, "INSUFFICIENT_DATA")
        .when(F.col("overall_score") >= HIGH_FROM, "HIGH")
        .when(F.col("overall_score") >= MEDIUM_FROM, "MEDIUM")
        .otherwise("LOW")
    )
    advice = F.lit(RECOMMENDATIONS["INSUFFICIENT_DATA"])
    for name in ("HIGH", "MEDIUM", "LOW"):
        advice = F.when(F.col("risk_level") == name, RECOMMENDATIONS[name]).otherwise(advice)
    warning = F.concat(
        missing.cast("string"), F.lit(" of 6 factors could not be evaluated for lack of data.")
    )
    return (
        proposals.withColumn("factors", factors)
        .withColumn(
            "overall_score",
            round_even(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4),
        )
        .withColumn("risk_level", level)
        .withColumn("warnings", F.array_compact(F.array(F.when(missing >= 3, warning))))
        .withColumn("recommendation", advice)
    )


def score_signals(scored: DataFrame, key: str) -> DataFrame:
    """PRE_SANCTION_RISK and INSUFFICIENT_SCORING_DATA signals, at most one per proposal."""
    top = F.slice(F.filter("factors", lambda f: f.contribution > KEY_FACTOR_FROM), 1, 3)
    causes = F.concat_ws("; ", F.transform(top, lambda f: f.reason))
    risky = F.col("risk_level").isin("HIGH", "MEDIUM")
    unknown = F.col("risk_level") == "INSUFFICIENT_DATA"
    return scored.where(risky | unknown).select(
        key,
        F.when(risky, "PRE_SANCTION_RISK").otherwise("INSUFFICIENT_SCORING_DATA").alias(
            "signal_type"
        ),
        F.when(risky, F.col("overall_score")).otherwise(F.lit(0.4)).alias("severity"),
        F.when(
            risky,
            F.concat(
                F.lit("Pre-sanction risk score is "), F.format_string("%.2f", round_even(F.col("overall_score"), 2)),
                F.lit(" ("), F.col("risk_level"), F.lit("). Key factors: "), causes,
            ),
        )
        .otherwise(F.element_at("warnings", 1))
        .alias("reason"),
    )
