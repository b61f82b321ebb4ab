"""Vendor statistics, category cost benchmarks and region risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.functions.numbers import count_when, sum_money
from fundlens.operators.pairing import order_statistic

STALLED = "Stalled"
UPPER_MEDIAN = "n div 2 + 1"


def vendor_stats(works: DataFrame) -> DataFrame:
    """Projects, amount, delays and anomalies per vendor."""
    return (
        works.where(F.coalesce(F.col("vendor_id"), F.lit("")) != "")
        .groupBy("vendor_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            sum_money(F.col("sanction_amount")).alias("amount"),
            count_when(F.col("work_status") == STALLED).alias("delays"),
            count_when(F.col("is_anomaly")).alias("anomalies"),
        )
    )


def _paise(c: str) -> Column:
    return (F.col(c) * 100).cast("bigint")


def amount_statistic(works: DataFrame, group: list[str], rank: str, name: str) -> DataFrame:
    """An exact order statistic of the sanctioned amount per group."""
    found = order_statistic(works, group, _paise("sanction_amount"), F.expr(rank))
    return found.select(*group, (F.col("value") / F.lit(100.0)).alias(name))


def computed_benchmarks(works: DataFrame) -> DataFrame:
    """Minimum, maximum and upper median of the amounts per category."""
    rows = works.where(F.coalesce(F.col("work_category"), F.lit("")) != "")
    ends = rows.groupBy("work_category").agg(
        F.min("sanction_amount").cast("double").alias("min"),
        F.max("sanction_amount").cast("double").alias("max"),
    )
    return ends.join(
        amount_statistic(rows, ["work_category"], UPPER_MEDIAN, "median"), "work_category"
    )


def explicit_benchmarks(works: DataFrame, row_id: Column) -> DataFrame:
    """Bounds stated by the first row per category that has both; median is their midpoint."""
    low, high = F.col("category_benchmark_min"), F.col("category_benchmark_max")
    has_both = low.isNotNull() & high.isNotNull()
    named = F.coalesce(F.col("work_category"), F.lit("")) != ""
    first = F.min_by(F.struct(low.alias("min"), high.alias("max")), row_id)
    return (
        works.where(has_both & named)
        .groupBy("work_category")
        .agg(first.alias("b"))
        .select(
            "work_category",
            F.col("b.min").cast("double").alias("min"),
            F.col("b.max").cast("double").alias("max"),
            ((F.col("b.min") + F.col("b.max")) / 2).cast("double").alias("median"),
        )
    )


def category_benchmarks(works: DataFrame, row_id: Column) -> DataFrame:
    """Explicit bounds where a category has them, otherwise computed from its amounts."""
    stated = explicit_benchmarks(works, row_id)
    rest = works.join(stated.select("work_category"), "work_category", "left_anti")
    return stated.unionByName(computed_benchmarks(rest))


def merge_benchmarks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old benchmarks, plus new ones for categories not yet known."""
    return old.unionByName(new.join(old.select("work_category"), "work_category", "left_anti"))


def with_reference_band(works: DataFrame) -> DataFrame:
    """Works plus the usual cost band of their category: the 10 % and 50 % row by amount."""
    low = amount_statistic(works, ["work_category"], "n div 10 + 1", "category_benchmark_min")
    high = amount_statistic(works, ["work_category"], UPPER_MEDIAN, "category_benchmark_max")
    return works.join(low.join(high, "work_category"), "work_category", "left")


def region_risk(works: DataFrame, *level: str) -> DataFrame:
    """Share of anomalous works per region."""
    return works.groupBy(*level).agg(
        F.count(F.lit(1)).alias("works"),
        (count_when(F.col("is_anomaly")) / F.count(F.lit(1))).alias("region_risk_score"),
    )


def hub_vendors(vendors: DataFrame, stats: DataFrame, limit: int | None = 25) -> DataFrame:
    """Vendors by project count, largest first."""
    ranked = vendors.join(stats.drop("delays", "anomalies"), "vendor_id", "left").select(
        "vendor_id",
        "vendor_name",
        "state",
        F.coalesce("total", F.lit(0)).alias("project_count"),
        F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("total_sanction_amount"),
        "is_hub",
    )
    if limit is None:
        return ranked
    return ranked.orderBy(F.desc("project_count"), "vendor_id").limit(limit)
