"""Benchmarks, scoring, risk profiles, anomaly rules and detector evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.functions.numbers import round_even
from fundlens.operators import anomalies as an
from fundlens.operators import alerts as al
from fundlens.operators import benchmarks as bm
from fundlens.operators import dashboards as db
from fundlens.operators import risk
from fundlens.operators import scoring as sc
from fundlens.plans import common as cm
from fundlens.plans.common import works_sql
from fundlens.plans.registry import query
from fundlens.sources import driver_tables as dt

APPROVED = "date_of_administrative_approval"
RECEIVED = "date_of_receipt_of_work_proposal_from_mp"
# Limits scaled to the amounts of the driver tables.
SPLIT_LIMIT = 400_000.0


@query(works_sql("""SELECT unique_work_number, total_risk_signals, composite_risk_score,
  CASE WHEN composite_risk_score >= 0.7 THEN 'HIGH' WHEN composite_risk_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_bucket
FROM scored""", *cm.profile_ctes()))
def risk_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return cm.profiles(spark, sf).select(
        "unique_work_number", "total_risk_signals", "composite_risk_score", "risk_bucket"
    )


@query(works_sql("""SELECT unique_work_number, state, nodal_district, sanction_amount_d AS sanction_amount, total_risk_signals, composite_risk_score
FROM (SELECT *, CAST(sanction_amount AS DOUBLE) AS sanction_amount_d FROM scored)
ORDER BY composite_risk_score DESC, total_risk_signals DESC, unique_work_number LIMIT 100""", *cm.profile_ctes()))
def top_risk_works(spark: SparkSession, sf: str) -> DataFrame:
    return (
        cm.profiles(spark, sf, "state", "nodal_district")
        .orderBy(F.desc("composite_risk_score"), F.desc("total_risk_signals"), "unique_work_number")
        .limit(100)
        .select(
            "unique_work_number", "state", "nodal_district",
            F.col("sanction_amount").cast("double").alias("sanction_amount"),
            "total_risk_signals", "composite_risk_score",
        )
    )


@query(works_sql("""SELECT unique_work_number, 'COST_OVERRUN_ANOMALY' AS signal_type, overrun_severity AS severity,
  'Sanction amount ' || format('{:,.2f}', CAST(sanction_amount AS DOUBLE)) || ' exceeds benchmark maximum ' || format('{:,.2f}', bound) || ' by more than 50%' AS reason FROM scored WHERE s_overrun
UNION ALL SELECT unique_work_number, 'GHOST_PROJECT_SUSPECT', 0.95, 'Financial progress is ' || printf('%.0f', round(financial_progress_pct)) || '% but physical completion is only ' || printf('%.0f', round(physical_progress_pct)) || '%' FROM scored WHERE s_ghost
UNION ALL SELECT unique_work_number, 'WORK_STALLED', 0.7, 'Work is officially flagged as stalled.' FROM scored WHERE s_stalled
UNION ALL SELECT unique_work_number, 'HUB_VENDOR_CONCENTRATION', 0.65, 'Vendor ' || vendor_id || ' is a high-concentration hub.' FROM scored WHERE hub""", *cm.profile_ctes()))
def work_risk_signals(spark: SparkSession, sf: str) -> DataFrame:
    return risk.profile_signals(cm.profiles(spark, sf))


@query(works_sql("""SELECT vendor_id, count(*) AS total, CAST(sum(sanction_amount) AS DOUBLE) AS amount,
  count(*) FILTER (work_status = 'Stalled') AS delays, count(*) FILTER (is_anomaly) AS anomalies FROM works GROUP BY vendor_id"""))
def vendor_stats(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "vendor_id", "sanction_amount", "work_status", "is_anomaly")
    return bm.vendor_stats(w).withColumn("amount", F.col("amount").cast("double"))


@query(works_sql("""SELECT work_category, "min", "max", median FROM benchmarks""", cm.BENCHMARKS_SQL))
def category_benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    return bm.computed_benchmarks(dt.works(spark, sf, "work_category", "sanction_amount"))


@query(works_sql("""SELECT work_category, CAST(stated_min AS DOUBLE) AS "min", CAST(stated_max AS DOUBLE) AS "max",
  (CAST(stated_min AS DOUBLE) + CAST(stated_max AS DOUBLE)) / 2 AS median FROM (
  SELECT *, row_number() OVER (PARTITION BY work_category ORDER BY order_key) AS rn FROM (
    SELECT work_category, order_key, CASE WHEN order_key % 3 = 1 THEN sanction_amount / 2 END AS stated_min,
      CASE WHEN order_key % 2 = 1 THEN sanction_amount * 2 END AS stated_max FROM works WHERE work_category <> 'PROMO')
  WHERE stated_min IS NOT NULL AND stated_max IS NOT NULL) WHERE rn = 1
UNION ALL SELECT work_category, "min", "max", median FROM benchmarks WHERE work_category = 'PROMO'""", cm.BENCHMARKS_SQL))
def stated_benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "order_key", "work_category", "sanction_amount")
    stated = F.col("work_category") != "PROMO"
    key = F.col("order_key")
    rows = w.withColumns(
        {
            "category_benchmark_min": F.when(stated & (key % 3 == 1), F.col("sanction_amount").cast("double") / 2),
            "category_benchmark_max": F.when(stated & (key % 2 == 1), F.col("sanction_amount").cast("double") * 2),
        }
    )
    return bm.category_benchmarks(rows, key)


@query(works_sql("""SELECT work_category, "min", "max" FROM benchmarks WHERE work_category < 'P'
UNION ALL SELECT work_category, "min" / 2, "max" FROM benchmarks WHERE work_category >= 'P'""", cm.BENCHMARKS_SQL))
def merge_benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    new = bm.computed_benchmarks(dt.works(spark, sf, "work_category", "sanction_amount"))
    old = new.where("work_category >= 'P'").withColumn("min", F.col("min") / 2)
    return bm.merge_benchmarks(old, new).drop("median")


@query(works_sql("""SELECT unique_work_number, low10 AS category_benchmark_min, median AS category_benchmark_max
FROM works JOIN benchmarks USING (work_category)""", cm.BENCHMARKS_SQL))
def reference_band(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "unique_work_number", "work_category", "sanction_amount")
    return bm.with_reference_band(w).select(
        "unique_work_number", "category_benchmark_min", "category_benchmark_max"
    )


@query(works_sql("""SELECT vendor_id, vendor_name, state, coalesce(n, 0) AS project_count, coalesce(amount, 0) AS total_sanction_amount, is_hub
FROM vendors LEFT JOIN (SELECT vendor_id, count(*) AS n, CAST(sum(sanction_amount) AS DOUBLE) AS amount FROM works GROUP BY 1) USING (vendor_id)
ORDER BY project_count DESC, vendor_id LIMIT 25""", dt.VENDORS_SQL))
def hub_vendors(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "vendor_id", "sanction_amount", "work_status", "is_anomaly")
    return bm.hub_vendors(dt.vendors(spark, sf), bm.vendor_stats(w))


@query(works_sql("""SELECT state, nodal_district, count(*) AS works, CAST(count(*) FILTER (is_anomaly) AS DOUBLE) / count(*) AS region_risk_score
FROM works GROUP BY 1, 2"""))
def region_risk(spark: SparkSession, sf: str) -> DataFrame:
    return bm.region_risk(dt.works(spark, sf, "state", "nodal_district", "is_anomaly"), "state", "nodal_district")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "vendor_id", "work_status", "is_anomaly", "sanction_amount")
    p = sc.fill_vendor_history(cm.proposals(spark, sf), bm.vendor_stats(w))
    bounds = dt.works(spark, sf, "work_category", "sanction_amount")
    medians = bm.amount_statistic(bounds, ["work_category"], bm.UPPER_MEDIAN, "median")
    p = sc.fill_benchmark(p, medians)
    regions = bm.region_risk(dt.works(spark, sf, "state", "is_anomaly"), "state")
    p = p.join(regions.select(F.col("state").alias("region"), "region_risk_score"), "region", "left")
    return sc.score_proposals(p)


@query(works_sql("""SELECT proposal_id, overall_score, risk_level FROM scored_proposals""", *cm.proposal_ctes()))
def score_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("proposal_id", "overall_score", "risk_level")


@query(works_sql("""SELECT proposal_id, 'vendor_delay_history' AS factor_name, CASE WHEN t > 0 THEN round_even(CAST(d AS DOUBLE) / t * 1000, 0) / 1000 END AS raw_value, c1 AS contribution FROM scored_proposals
UNION ALL SELECT proposal_id, 'vendor_anomaly_history', CASE WHEN t > 0 THEN round_even(CAST(a AS DOUBLE) / t * 1000, 0) / 1000 END, c2 FROM scored_proposals
UNION ALL SELECT proposal_id, 'amount_vs_benchmark', round_even(over * 100, 0) / 100, c3 FROM scored_proposals
UNION ALL SELECT proposal_id, 'new_vendor', CASE WHEN t = 0 THEN 1 ELSE 0 END, c4 FROM scored_proposals
UNION ALL SELECT proposal_id, 'seasonal_risk', CASE WHEN season_month IN (6,7,8,9) THEN 1 ELSE 0 END, c5 FROM scored_proposals
UNION ALL SELECT proposal_id, 'region_risk', region_risk_score, c6 FROM scored_proposals""", *cm.proposal_ctes()))
def score_factors(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("proposal_id", F.explode("factors").alias("f")).select(
        "proposal_id", "f.factor_name", "f.raw_value", "f.contribution"
    )


@query(works_sql("""SELECT proposal_id, t AS vendor_total_projects, d AS vendor_past_delays, a AS vendor_past_anomalies, benchmark AS category_benchmark_amount FROM filled""", *cm.proposal_ctes()))
def fill_vendor_history(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(
        "proposal_id", "vendor_total_projects", "vendor_past_delays", "vendor_past_anomalies",
        "category_benchmark_amount",
    )


def _history_sql(word: str, count: str, concern: float) -> str:
    rate = f"'Vendor {word} rate is ' || CAST(round_even(CAST({count} AS DOUBLE) / t * 100, 0) AS INTEGER) || '% (' || {count} || ' of ' || t || ' past projects), '"
    return (
        f"CASE WHEN t = 0 THEN 'No prior projects on record; {word} history unavailable.' "
        f"WHEN CAST({count} AS DOUBLE) / t > {concern} THEN {rate} || 'above the {concern * 100:.0f}% concern threshold.' ELSE {rate} || 'within acceptable range.' END"
    )


_LIMITS = sc.DEFAULT_THRESHOLDS
_OVER = "printf('%+.1f', round_even(over * 10, 0) / 10) || '%'"
_REGION = "'Region ' || chr(39) || region || chr(39) || ' has {} risk score of ' || printf('%.2f', round_even(region_risk_score * 100, 0) / 100) || '.'"
_REASONS = f"""reasons AS (
  SELECT proposal_id, 1 AS pos, 'vendor_delay_history' AS factor_name, c1 AS contribution, {_history_sql("delay", "d", _LIMITS["delay_ratio_concern"])} AS reason FROM scored_proposals
  UNION ALL SELECT proposal_id, 2, 'vendor_anomaly_history', c2, {_history_sql("anomaly", "a", _LIMITS["anomaly_ratio_concern"])} FROM scored_proposals
  UNION ALL SELECT proposal_id, 3, 'amount_vs_benchmark', c3, CASE WHEN benchmark IS NULL THEN 'No category benchmark amount; cannot judge the amount.'
    WHEN over > 20 THEN 'Proposed amount is ' || {_OVER} || ' against the benchmark, above the 20% concern threshold.'
    WHEN over > 0 THEN 'Proposed amount is ' || {_OVER} || ' against the benchmark, within acceptable range.' ELSE 'Proposed amount is at or below the benchmark (' || {_OVER} || ').' END FROM scored_proposals
  UNION ALL SELECT proposal_id, 4, 'new_vendor', c4, CASE WHEN t = 0 THEN 'New vendor without prior projects; track record unknown.' ELSE 'Vendor has ' || t || ' prior project(s) on record.' END FROM scored_proposals
  UNION ALL SELECT proposal_id, 5, 'seasonal_risk', c5, 'Month ' || season_month || CASE WHEN season_month IN (6, 7, 8, 9) THEN ' is in the monsoon season (Jun-Sep).' ELSE ' is outside the monsoon season.' END FROM scored_proposals
  UNION ALL SELECT proposal_id, 6, 'region_risk', c6, CASE WHEN region_risk_score IS NULL THEN 'No region risk score supplied; factor not evaluated.' WHEN region_risk_score > 0.6 THEN {_REGION.format("an elevated")} ELSE {_REGION.format("a normal")} END FROM scored_proposals)"""


@query(works_sql("SELECT proposal_id, factor_name, contribution, reason FROM reasons", *cm.proposal_ctes(), _REASONS))
def factor_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("proposal_id", F.explode("factors").alias("f")).select("proposal_id", "f.factor_name", "f.contribution", "f.reason")


@query(works_sql(f"""SELECT proposal_id, CASE WHEN risk_level = 'INSUFFICIENT_DATA' THEN 'INSUFFICIENT_SCORING_DATA' ELSE 'PRE_SANCTION_RISK' END AS signal_type,
  CASE WHEN risk_level = 'INSUFFICIENT_DATA' THEN 0.4 ELSE overall_score END AS severity,
  CASE WHEN risk_level = 'INSUFFICIENT_DATA' THEN missing || ' of 6 factors could not be evaluated for lack of data.'
    ELSE 'Pre-sanction risk score is ' || printf('%.2f', round_even(overall_score * 100, 0) / 100) || ' (' || risk_level || '). Key factors: ' || coalesce(causes, '') END AS reason
FROM scored_proposals LEFT JOIN (SELECT proposal_id, string_agg(reason, '; ' ORDER BY pos) AS causes FROM (
  SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY pos) AS rn FROM reasons WHERE contribution > {sc.KEY_FACTOR_FROM}) WHERE rn <= 3 GROUP BY 1) USING (proposal_id)
WHERE risk_level <> 'LOW'""", *cm.proposal_ctes(), _REASONS))
def score_signals(spark: SparkSession, sf: str) -> DataFrame:
    return sc.score_signals(_scored(spark, sf), "proposal_id")


@query(works_sql("""SELECT risk_level, recommendation, count(*) AS proposals FROM (
  SELECT risk_level, CASE risk_level WHEN 'HIGH' THEN 'Flag for scrutiny: high risk detected across historical factors.'
    WHEN 'MEDIUM' THEN 'Review recommended: moderate risk signals present.' WHEN 'LOW' THEN 'Proceed to sanction: low risk profile.'
    ELSE 'Hold proposal: insufficient data for reliable scoring.' END AS recommendation FROM scored_proposals) GROUP BY 1, 2""", *cm.proposal_ctes()))
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).groupBy("risk_level", "recommendation").agg(F.count(F.lit(1)).alias("proposals"))


@query(works_sql("""SELECT is_anomaly, count(*) AS proposals, CAST(sum(CAST(overall_score AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_score,
  count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium,
  count(*) FILTER (risk_level = 'LOW') AS low, count(*) FILTER (risk_level = 'INSUFFICIENT_DATA') AS insufficient_data
FROM scored_proposals GROUP BY is_anomaly""", *cm.proposal_ctes()))
def score_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return db.score_by_label(_scored(spark, sf), "is_anomaly")


@query(works_sql("""SELECT 'ALT-PROP-' || proposal_id AS alert_id, overall_score AS risk_score, 'HIGH' AS severity,
  TIMESTAMP '1998-06-15 12:00:00' + INTERVAL 72 HOUR AS sla_deadline FROM scored_proposals WHERE overall_score >= 0.3""", *cm.proposal_ctes()))
def proposal_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return al.proposal_alerts(_scored(spark, sf), "proposal_id", cm.as_of(), min_score=0.3).select(
        "alert_id", "risk_score", "severity", "sla_deadline"
    )


@query(works_sql("""SELECT unique_work_number, CAST(sanction_amount AS DOUBLE) AS sanction_amount, median AS benchmark_max
FROM works JOIN benchmarks USING (work_category) WHERE CAST(sanction_amount AS DOUBLE) > median * 1.5""", cm.BENCHMARKS_SQL))
def cost_overruns(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "unique_work_number", "work_category", "sanction_amount")
    bounds = bm.amount_statistic(w, ["work_category"], bm.UPPER_MEDIAN, "benchmark_max")
    return w.join(bounds, "work_category").where(risk.is_overrun()).select(
        "unique_work_number", F.col("sanction_amount").cast("double").alias("sanction_amount"), "benchmark_max"
    )


@query(works_sql("""SELECT unique_work_number, physical_progress_pct, financial_progress_pct FROM works
WHERE financial_progress_pct >= 80 AND physical_progress_pct <= 20"""))
def ghost_works(spark: SparkSession, sf: str) -> DataFrame:
    return dt.works(
        spark, sf, "unique_work_number", "physical_progress_pct", "financial_progress_pct"
    ).where(risk.is_ghost())


_DUPLICATE_KEY = """nodal_district, work_category, trim(regexp_replace(lower(work_name), '[^a-z0-9]+', ' ', 'g')) AS title,
    CAST(floor(CAST(sanction_amount AS DOUBLE) / 100000 + 0.5) AS BIGINT) AS amount_step"""


@query(works_sql(f"""SELECT nodal_district, work_category, title, amount_step, count(*) AS works, count(DISTINCT vendor_id) AS vendors, min(unique_work_number) AS first_work
FROM (SELECT {_DUPLICATE_KEY}, vendor_id, unique_work_number FROM works) GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT vendor_id) >= 2"""))
def duplicate_works(spark: SparkSession, sf: str) -> DataFrame:
    return an.duplicate_works(
        dt.works(spark, sf, "nodal_district", "work_category", "work_name", "sanction_amount", "vendor_id", "unique_work_number")
    )


_NEAR_RUNS = """alike AS (
  SELECT nodal_district, work_category, trim(regexp_replace(lower(work_name), '[^a-z0-9]+', ' ', 'g')) AS title, sanction_amount, vendor_id, unique_work_number FROM works),
chained AS (
  SELECT *, sum(CASE WHEN gap <= 100000 THEN 0 ELSE 1 END) OVER (PARTITION BY nodal_district, work_category, title ORDER BY sanction_amount, unique_work_number) AS run
  FROM (SELECT *, sanction_amount - lag(sanction_amount) OVER (PARTITION BY nodal_district, work_category, title ORDER BY sanction_amount, unique_work_number) AS gap FROM alike)),
near AS (
  SELECT nodal_district, work_category, title, run, count(*) AS works, count(DISTINCT vendor_id) AS vendors, min(unique_work_number) AS first_work,
    CAST(min(sanction_amount) AS DOUBLE) AS lowest_amount, CAST(max(sanction_amount) AS DOUBLE) AS highest_amount
  FROM chained GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT vendor_id) >= 2)"""
_NEAR_COLUMNS = ("nodal_district", "work_category", "work_name", "sanction_amount", "vendor_id", "unique_work_number")


@query(works_sql("SELECT nodal_district, work_category, title, works, vendors, first_work, lowest_amount, highest_amount FROM near", _NEAR_RUNS))
def near_duplicate_works(spark: SparkSession, sf: str) -> DataFrame:
    return an.near_duplicate_works(dt.works(spark, sf, *_NEAR_COLUMNS))


@query(works_sql("""SELECT first_work AS group_id, unique_work_number, vendor_id, CAST(sanction_amount AS DOUBLE) AS amount
FROM chained JOIN near USING (nodal_district, work_category, title, run)""", _NEAR_RUNS))
def near_duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    return an.near_duplicate_members(dt.works(spark, sf, *_NEAR_COLUMNS))


_RUNS = f"""runs AS (
  SELECT *, sum(CASE WHEN gap <= 14 THEN 0 ELSE 1 END) OVER (PARTITION BY vendor_id, nodal_district ORDER BY day, unique_work_number) AS run
  FROM (SELECT unique_work_number, vendor_id, nodal_district, date_of_administrative_approval AS day, sanction_amount,
      date_of_administrative_approval - lag(date_of_administrative_approval) OVER (PARTITION BY vendor_id, nodal_district ORDER BY date_of_administrative_approval, unique_work_number) AS gap
    FROM works WHERE sanction_amount < {int(SPLIT_LIMIT)}))"""


@query(works_sql("""SELECT vendor_id, nodal_district, min(day) AS first_day, max(day) AS last_day, count(*) AS works, CAST(sum(sanction_amount) AS DOUBLE) AS amount
FROM runs GROUP BY vendor_id, nodal_district, run HAVING count(*) >= 2""", _RUNS))
def split_invoicing_runs(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "unique_work_number", "vendor_id", "nodal_district", APPROVED, "sanction_amount")
    return an.split_invoicing_runs(w, SPLIT_LIMIT)


@query(works_sql("""SELECT unique_work_number, vendor_id, nodal_district, run_start, run_works FROM (
  SELECT *, count(*) OVER (PARTITION BY vendor_id, nodal_district, run) AS run_works, min(day) OVER (PARTITION BY vendor_id, nodal_district, run) AS run_start FROM runs)
WHERE run_works >= 2""", _RUNS))
def split_invoicing_works(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "unique_work_number", "vendor_id", "nodal_district", APPROVED, "sanction_amount")
    return an.split_invoicing_works(w, SPLIT_LIMIT)


@query(works_sql(f"""SELECT unique_work_number, vendor_id, nodal_district, others FROM (
  SELECT *, count(*) OVER (PARTITION BY vendor_id, nodal_district) - 1 AS others FROM works WHERE sanction_amount < {int(SPLIT_LIMIT)}) WHERE others > 0"""))
def split_candidates(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "unique_work_number", "vendor_id", "nodal_district", "sanction_amount")
    return an.split_candidates(w, SPLIT_LIMIT)


@query(works_sql("""SELECT unique_work_number, date_of_administrative_approval FROM works
WHERE month(date_of_administrative_approval) = 3 AND day(date_of_administrative_approval) >= 17"""))
def year_end_dumping(spark: SparkSession, sf: str) -> DataFrame:
    return an.year_end_dumping(dt.works(spark, sf, "unique_work_number", APPROVED))


@query(works_sql("""SELECT unique_work_number, financial_progress_pct - physical_progress_pct AS gap FROM works
WHERE financial_progress_pct - physical_progress_pct > 15"""))
def progress_divergence(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "unique_work_number", "physical_progress_pct", "financial_progress_pct")
    return an.progress_divergence(w).select("unique_work_number", "gap")


@query(works_sql("""SELECT w.unique_work_number, w.mp_name, s.unspent FROM works w JOIN (
  SELECT x.mp_name, coalesce(CAST(m.allocated_amount AS DOUBLE), 50000000) - x.spent AS unspent FROM (
    SELECT mp_name, sum(CAST(floor(CAST(sanction_amount AS DOUBLE) * (financial_progress_pct / 100.0) + 0.5) AS BIGINT)) AS spent FROM works GROUP BY 1) x
  LEFT JOIN mp_master m USING (mp_name)) s USING (mp_name)
WHERE w.work_status = 'Stalled' AND s.unspent > 0""", dt.MP_MASTER_SQL))
def stalled_but_fundable(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "unique_work_number", "mp_name", "sanction_amount", "financial_progress_pct", "work_status")
    return an.stalled_but_fundable(w, dt.mp_master(spark, sf).select("mp_name", "allocated_amount"))


@query(works_sql("""SELECT work_category, nodal_district, count(*) AS works,
  CAST(sum(date_of_administrative_approval - date_of_receipt_of_work_proposal_from_mp) AS DOUBLE) / count(*) AS avg_days,
  max(date_of_administrative_approval - date_of_receipt_of_work_proposal_from_mp) AS max_days FROM works GROUP BY 1, 2"""))
def approval_delay(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "work_category", "nodal_district", APPROVED, RECEIVED)
    return an.approval_delay(w, "work_category", "nodal_district").withColumn("max_days", F.col("max_days").cast("bigint"))


_AREA = "CASE constituency WHEN 'BUILDING' THEN 'SC' WHEN 'MACHINERY' THEN 'ST' ELSE '' END"


@query(works_sql(f"""SELECT *, sc_amount >= 150000 AS sc_ok, st_amount >= 75000 AS st_ok FROM (
  SELECT mp_name, CAST(year(date_of_administrative_approval) AS INTEGER) AS "year",
    coalesce(CAST(sum(CASE WHEN {_AREA} = 'SC' THEN sanction_amount END) AS DOUBLE), 0) AS sc_amount,
    coalesce(CAST(sum(CASE WHEN {_AREA} = 'ST' THEN sanction_amount END) AS DOUBLE), 0) AS st_amount FROM works GROUP BY 1, 2)"""))
def allocation_compliance(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "mp_name", "constituency", "sanction_amount", APPROVED)
    area = F.when(F.col("constituency") == "BUILDING", "SC").when(F.col("constituency") == "MACHINERY", "ST").otherwise("")
    return an.allocation_compliance(w.withColumn("area_type", area), entitlement=1e6)


@query(works_sql("""SELECT CAST(t AS DOUBLE) AS threshold, CAST(m AS DOUBLE) AS multiplier, u AS under_threshold, o AS over_benchmark, u + o AS cases,
  round_even((u * CAST(8.5 AS DOUBLE) + o * CAST(14.2 AS DOUBLE)) / 100 * 100, 0) / 100 AS saving_cr FROM (
  SELECT t, m, count(*) FILTER (CAST(sanction_amount AS DOUBLE) <= t AND CAST(sanction_amount AS DOUBLE) >= t * 0.75) AS u,
    count(*) FILTER (CAST(sanction_amount AS DOUBLE) > median * CAST(m AS DOUBLE)) AS o
  FROM works JOIN benchmarks USING (work_category), (VALUES (200000), (250000), (400000)) a(t), (VALUES (1.2), (1.4), (1.6)) b(m) GROUP BY t, m)""", cm.BENCHMARKS_SQL))
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "work_category", "sanction_amount")
    bounds = bm.amount_statistic(w, ["work_category"], bm.UPPER_MEDIAN, "category_benchmark_max")
    return an.threshold_sweep(w.join(bounds, "work_category"), [200_000, 250_000, 400_000], [1.2, 1.4, 1.6])


def _quality_sql(predicted: str) -> str:
    return f"""SELECT tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS "precision",
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1
FROM (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn
  FROM ({predicted}))"""


@query(works_sql(_quality_sql("SELECT CAST(sanction_amount AS DOUBLE) > median * 1.5 AS p, anomaly_type = 'cost_overrun' AS a FROM works JOIN benchmarks USING (work_category)"), cm.BENCHMARKS_SQL))
def overrun_detector_quality(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "work_category", "sanction_amount", "anomaly_type")
    bounds = bm.amount_statistic(w, ["work_category"], bm.UPPER_MEDIAN, "benchmark_max")
    return risk.detector_quality(
        w.join(bounds, "work_category"), risk.is_overrun(), F.col("anomaly_type") == "cost_overrun"
    )


@query(works_sql(_quality_sql("SELECT financial_progress_pct >= 80 AND physical_progress_pct <= 20 AS p, anomaly_type = 'ghost_project_progress_mismatch' AS a FROM works")))
def ghost_detector_quality(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "physical_progress_pct", "financial_progress_pct", "anomaly_type")
    return risk.detector_quality(w, risk.is_ghost(), F.col("anomaly_type") == "ghost_project_progress_mismatch")


@query(works_sql("""SELECT hubs, picked, hits, CASE WHEN picked > 0 THEN CAST(hits AS DOUBLE) / picked ELSE 0 END AS "precision",
  CASE WHEN hubs > 0 THEN CAST(hits AS DOUBLE) / hubs ELSE 0 END AS recall FROM (
  SELECT (SELECT count(*) FROM vendors WHERE is_hub) AS hubs, count(*) AS picked, count(*) FILTER (is_hub) AS hits FROM (
    SELECT vendor_id, is_hub, row_number() OVER (ORDER BY n DESC, vendor_id) AS rn FROM (SELECT vendor_id, count(*) AS n FROM works GROUP BY 1) LEFT JOIN vendors USING (vendor_id))
  WHERE rn <= (SELECT count(*) FROM vendors WHERE is_hub))""", dt.VENDORS_SQL))
def topn_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return db.topn_overlap(dt.works(spark, sf, "vendor_id"), dt.vendors(spark, sf))


@query(works_sql("""SELECT vendor_id FROM vendors WHERE is_hub INTERSECT
SELECT vendor_id FROM (SELECT vendor_id, row_number() OVER (ORDER BY count(*) DESC, vendor_id) AS rn FROM works GROUP BY 1) WHERE rn <= (SELECT count(*) FROM vendors WHERE is_hub)""", dt.VENDORS_SQL))
def hub_overlap(spark: SparkSession, sf: str) -> DataFrame:
    counts = dt.works(spark, sf, "vendor_id").groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"))
    hubs = dt.vendors(spark, sf).where("is_hub").select("vendor_id")
    # As many of the busiest vendors as there are hubs.
    top = counts.orderBy(F.desc("n"), "vendor_id").limit(hubs.count()).select("vendor_id")
    return hubs.intersect(top)


@query(cm.with_ctes(dt.VENDORS_SQL, body="""SELECT vendor_id, CASE WHEN is_hub THEN 0.88 ELSE 0.25 END AS risk_score,
  CASE WHEN is_hub THEN 'High-concentration hub vendor.' ELSE 'Normal contractor network metrics.' END AS reason FROM vendors"""))
def vendor_network_flags(spark: SparkSession, sf: str) -> DataFrame:
    return risk.vendor_network_flags(dt.vendors(spark, sf))


@query(works_sql("""SELECT unique_work_number, coalesce(is_hub, FALSE) AS is_hub_vendor FROM works LEFT JOIN vendors USING (vendor_id)""", dt.VENDORS_SQL))
def flag_hub_vendor(spark: SparkSession, sf: str) -> DataFrame:
    return risk.flag_hub_vendor(dt.works(spark, sf, "unique_work_number", "vendor_id"), dt.vendors(spark, sf)).select(
        "unique_work_number", "is_hub_vendor"
    )


@query(works_sql("""SELECT module, signal_type, count(*) AS signals, max(round_even(severity * 1000000, 0) / 1000000) AS max_severity FROM (
  SELECT 'profile' AS module, 'COST_OVERRUN_ANOMALY' AS signal_type, overrun_severity AS severity FROM scored WHERE s_overrun
  UNION ALL SELECT 'profile', 'GHOST_PROJECT_SUSPECT', 0.95 FROM scored WHERE s_ghost
  UNION ALL SELECT 'profile', 'WORK_STALLED', 0.7 FROM scored WHERE s_stalled
  UNION ALL SELECT 'profile', 'HUB_VENDOR_CONCENTRATION', 0.65 FROM scored WHERE hub
  UNION ALL SELECT 'scoring', CASE WHEN risk_level = 'INSUFFICIENT_DATA' THEN 'INSUFFICIENT_SCORING_DATA' ELSE 'PRE_SANCTION_RISK' END,
    CASE WHEN risk_level = 'INSUFFICIENT_DATA' THEN 0.4 ELSE overall_score END FROM scored_proposals WHERE risk_level <> 'LOW'
) GROUP BY 1, 2""", *cm.profile_ctes(), cm.PROPOSALS_SQL))
def union_signals(spark: SparkSession, sf: str) -> DataFrame:
    all_signals = risk.union_signals(
        profile=risk.profile_signals(cm.profiles(spark, sf)),
        scoring=sc.score_signals(_scored(spark, sf), "proposal_id"),
    )
    return all_signals.groupBy("module", "signal_type").agg(
        F.count(F.lit(1)).alias("signals"), F.max(round_even(F.col("severity"), 6)).alias("max_severity")
    )
