"""Derived inputs shared by several queries, in Spark and in the SQL of the checks.

Texts the domain expects (complaints, invoices, feedback, proposals) are rendered from the tables,
one per work, so that they grow with them and their true values are known to the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.operators import alerts as al
from fundlens.operators import benchmarks as bm
from fundlens.operators import risk
from fundlens.sources import driver_tables as dt

AS_OF = "1998-06-15 12:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def works_sql(body: str, *more: str) -> str:
    return with_ctes(dt.WORKS_SQL, *more, body=body)


# Cost band per category: minimum, maximum and upper median of the amounts.
BENCHMARKS_SQL = """benchmarks AS (
  SELECT work_category, CAST(min(sanction_amount) AS DOUBLE) AS "min", CAST(max(sanction_amount) AS DOUBLE) AS "max",
    CAST(max(CASE WHEN rn = n // 2 + 1 THEN sanction_amount END) AS DOUBLE) AS median,
    CAST(max(CASE WHEN rn = n // 10 + 1 THEN sanction_amount END) AS DOUBLE) AS low10
  FROM (SELECT work_category, sanction_amount, count(*) OVER (PARTITION BY work_category) AS n,
          row_number() OVER (PARTITION BY work_category ORDER BY sanction_amount) AS rn FROM works)
  GROUP BY work_category
)"""

PROFILES_SQL = """profiles AS (
  SELECT w.*, b.median AS bound, coalesce(v.is_hub, FALSE) AS hub,
    CAST(sanction_amount AS DOUBLE) > b.median * 1.5 AS s_overrun,
    least(1.0, CAST(sanction_amount AS DOUBLE) / (b.median * 2.5)) AS overrun_severity,
    financial_progress_pct >= 80 AND physical_progress_pct <= 20 AS s_ghost,
    work_status = 'Stalled' AS s_stalled
  FROM works w LEFT JOIN benchmarks b USING (work_category) LEFT JOIN vendors v ON w.vendor_id = v.vendor_id
),
scored AS (
  SELECT *, CAST(s_overrun AS INTEGER) + CAST(s_ghost AS INTEGER) + CAST(s_stalled AS INTEGER) + CAST(hub AS INTEGER) AS total_risk_signals,
    coalesce(greatest(CASE WHEN s_overrun THEN overrun_severity END, CASE WHEN s_ghost THEN CAST(0.95 AS DOUBLE) END,
      CASE WHEN s_stalled THEN CAST(0.7 AS DOUBLE) END, CASE WHEN hub THEN CAST(0.65 AS DOUBLE) END), CAST(0.1 AS DOUBLE)) AS composite_risk_score
  FROM profiles
)"""


def profile_ctes() -> tuple[str, ...]:
    return (BENCHMARKS_SQL, dt.VENDORS_SQL, PROFILES_SQL)


def reference_bounds(works: DataFrame) -> DataFrame:
    """Category bounds as risk rules use them; the upper bound is the upper median, since the
    amounts of the tables have no outliers beyond their maximum."""
    found = bm.amount_statistic(works, ["work_category"], bm.UPPER_MEDIAN, "max")
    return found


def profiles(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    columns = dict.fromkeys(
        ("unique_work_number", "work_category", "sanction_amount", "physical_progress_pct",
         "financial_progress_pct", "work_status", "vendor_id", "is_anomaly", *extra)
    )
    works = dt.works(spark, sf, *columns)
    bounds = reference_bounds(dt.works(spark, sf, "work_category", "sanction_amount"))
    return risk.risk_profiles(works, bounds, dt.vendors(spark, sf))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """One alert per anomalous work, raised on the day of approval."""
    p = profiles(
        spark, sf, "work_name", "nodal_district", "state", "mp_name", "constituency", "vendor_name",
        "anomaly_type", "date_of_administrative_approval",
    )
    return al.alerts_from_works(p, F.col("date_of_administrative_approval").cast("timestamp_ntz"))


ALERTS_SQL = """alerts AS (
  SELECT 'ALT-' || unique_work_number AS alert_id, unique_work_number AS work_id, work_name AS work_title,
    nodal_district AS district, state, mp_name, constituency, vendor_id, vendor_name, sanction_amount,
    CAST(floor(CAST(sanction_amount AS DOUBLE) * (financial_progress_pct / 100.0) + 0.5) AS BIGINT) AS spent_amount,
    round_even(composite_risk_score * 100, 0) / 100 AS risk_score,
    CASE WHEN round_even(composite_risk_score * 100, 0) / 100 >= 0.8 THEN 'HIGH'
         WHEN round_even(composite_risk_score * 100, 0) / 100 >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    CASE WHEN anomaly_type = 'split_invoicing' THEN 'Sequential sanctions under the tender threshold within days.'
         WHEN anomaly_type LIKE '%ghost_project%' THEN 'Severe gap between physical and financial progress.'
         WHEN anomaly_type = 'cost_overrun' THEN 'Sanctioned amount ' || printf('%.1f', CAST(sanction_amount AS DOUBLE) / 100000.0) || ' Lakh exceeds the category benchmark.'
         WHEN anomaly_type LIKE '%fund_dumping%' THEN 'Year-end fund dumping.'
         ELSE 'Duplicate registration of a work site.' END AS reason,
    'AI_FLAGGED' AS source, 'OPEN' AS status,
    CAST(date_of_administrative_approval AS TIMESTAMP) AS created_at,
    CAST(date_of_administrative_approval AS TIMESTAMP) + INTERVAL 72 HOUR AS sla_deadline
  FROM scored WHERE is_anomaly
)"""


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Action log: events on the works whose order number is a third of the event's."""
    e = dt.table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("log_id"),
        F.concat(F.lit("ALT-"), dt.work_number(F.floor(F.col("event_id") / 3).cast("bigint"))).alias("alert_id"),
        F.when(kind.isin("view", "click"), "ACTION")
        .when(kind == "purchase", "ESCALATE")
        .when(kind == "signup", "DISMISS")
        .otherwise("REOPEN")
        .alias("action"),
        F.when((kind == "signup") & (F.col("value") > 10), "Site inspected").alias("dismiss_reason"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"),
        F.col("ts").alias("acted_at"),
    )


ACTIONS_SQL = """actions AS (
  SELECT event_id AS log_id, 'ALT-W' || lpad(CAST(event_id // 3 AS VARCHAR), 8, '0') AS alert_id,
    CASE WHEN event_type IN ('view', 'click') THEN 'ACTION' WHEN event_type = 'purchase' THEN 'ESCALATE'
         WHEN event_type = 'signup' THEN 'DISMISS' ELSE 'REOPEN' END AS action,
    CASE WHEN event_type = 'signup' AND value > 10 THEN 'Site inspected' END AS dismiss_reason,
    'user-' || CAST(user_id AS VARCHAR) AS actor, ts AS acted_at
  FROM events
),
valid_actions AS (
  SELECT * FROM actions WHERE action IN ('ACTION', 'ESCALATE') OR (action = 'DISMISS' AND dismiss_reason IS NOT NULL)
)"""

FOLDED_SQL = """folded AS (
  SELECT a.* EXCLUDE (status), coalesce(CASE l.action WHEN 'ACTION' THEN 'ACTIONED' WHEN 'ESCALATE' THEN 'ESCALATED'
      WHEN 'DISMISS' THEN 'DISMISSED' END, a.status) AS status,
    CASE WHEN l.action = 'DISMISS' THEN l.dismiss_reason END AS dismiss_reason, l.actioned_at, coalesce(l.actions, 0) AS actions
  FROM alerts a LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY acted_at DESC, log_id DESC) AS rn,
      min(acted_at) OVER (PARTITION BY alert_id) AS actioned_at, count(*) OVER (PARTITION BY alert_id) AS actions
    FROM valid_actions) WHERE rn = 1) l USING (alert_id)
)"""


def folded_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return al.fold_alert_actions(alerts(spark, sf), actions(spark, sf))


def alert_ctes(*more: str) -> tuple[str, ...]:
    return (*profile_ctes(), ALERTS_SQL, *more)


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Every work as if proposed anew; two thirds come without own history or benchmark."""
    w = dt.works(
        spark, sf, "order_key", "unique_work_number", "sanction_amount", "work_category", "state",
        "date_of_receipt_of_work_proposal_from_mp", "vendor_id", "is_anomaly",
    )
    known = F.col("order_key") % 3 == 0
    return w.select(
        F.col("unique_work_number").alias("proposal_id"),
        "sanction_amount",
        F.col("work_category").alias("category"),
        F.col("state").alias("region"),
        F.month("date_of_receipt_of_work_proposal_from_mp").alias("season_month"),
        F.when(F.col("order_key") % 10 == 1, F.concat(F.lit("NEW"), "vendor_id")).otherwise(F.col("vendor_id")).alias("vendor_id"),
        F.when(known, F.col("order_key") % 4).otherwise(0).cast("bigint").alias("vendor_past_delays"),
        F.when(known, F.col("order_key") % 5).otherwise(0).cast("bigint").alias("vendor_past_anomalies"),
        F.when(known, F.lit(8)).otherwise(0).cast("bigint").alias("vendor_total_projects"),
        F.lit(None).cast("double").alias("category_benchmark_amount"),
        "is_anomaly",
    )


PROPOSALS_SQL = """proposals AS (
  SELECT unique_work_number AS proposal_id, sanction_amount, work_category AS category, state AS region,
    month(date_of_receipt_of_work_proposal_from_mp) AS season_month,
    CASE WHEN order_key % 10 = 1 THEN 'NEW' || vendor_id ELSE vendor_id END AS vendor_id,
    CASE WHEN order_key % 3 = 0 THEN order_key % 4 ELSE 0 END AS vendor_past_delays,
    CASE WHEN order_key % 3 = 0 THEN order_key % 5 ELSE 0 END AS vendor_past_anomalies,
    CASE WHEN order_key % 3 = 0 THEN 8 ELSE 0 END AS vendor_total_projects, is_anomaly
  FROM works
),
vstats AS (
  SELECT vendor_id, count(*) AS total, count(*) FILTER (work_status = 'Stalled') AS delays, count(*) FILTER (is_anomaly) AS anomalies
  FROM works GROUP BY vendor_id
),
region_scores AS (SELECT state AS region, CAST(count(*) FILTER (is_anomaly) AS DOUBLE) / count(*) AS region_risk_score FROM works GROUP BY state),
filled AS (
  SELECT p.* EXCLUDE (vendor_past_delays, vendor_past_anomalies, vendor_total_projects),
    CASE WHEN vendor_total_projects = 0 AND v.total IS NOT NULL THEN v.delays ELSE vendor_past_delays END AS d,
    CASE WHEN vendor_total_projects = 0 AND v.total IS NOT NULL THEN v.anomalies ELSE vendor_past_anomalies END AS a,
    CASE WHEN vendor_total_projects = 0 AND v.total IS NOT NULL THEN v.total ELSE vendor_total_projects END AS t,
    b.median AS benchmark, r.region_risk_score
  FROM proposals p LEFT JOIN vstats v USING (vendor_id) LEFT JOIN benchmarks b ON p.category = b.work_category
  LEFT JOIN region_scores r USING (region)
),
factors AS (
  SELECT *, CASE WHEN t = 0 THEN 0 ELSE round_even(least(1.0, CAST(d AS DOUBLE) / t) * CAST(0.25 AS DOUBLE) * 10000, 0) / 10000 END AS c1,
    CASE WHEN t = 0 THEN 0 ELSE round_even(least(1.0, CAST(a AS DOUBLE) / t) * CAST(0.2 AS DOUBLE) * 10000, 0) / 10000 END AS c2,
    round_even(CASE WHEN over > 20 THEN least(1.0, over / 100.0) * CAST(0.2 AS DOUBLE) WHEN over > 0 THEN (over / CAST(20 AS DOUBLE)) * CAST(0.3 AS DOUBLE) * CAST(0.2 AS DOUBLE) ELSE 0 END * 10000, 0) / 10000 AS c3,
    CASE WHEN t = 0 THEN CAST(0.105 AS DOUBLE) ELSE 0 END AS c4,
    CASE WHEN season_month IN (6, 7, 8, 9) THEN CAST(0.08 AS DOUBLE) ELSE 0 END AS c5,
    round_even(region_risk_score * CAST(0.1 AS DOUBLE) * 10000, 0) / 10000 AS c6
  FROM (SELECT *, (CAST(sanction_amount AS DOUBLE) - benchmark) / benchmark * 100 AS over FROM filled)
),
scored_proposals AS (
  SELECT *, CASE WHEN missing >= 3 THEN 'INSUFFICIENT_DATA' WHEN overall_score >= 0.6 THEN 'HIGH' WHEN overall_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM (SELECT *, round_even(least(1.0, greatest(0.0, 0.0 + c1 + c2 + c3 + c4 + c5 + c6)) * 10000, 0) / 10000 AS overall_score,
    CASE WHEN t = 0 THEN 2 ELSE 0 END + CASE WHEN benchmark IS NULL OR benchmark = 0 THEN 1 ELSE 0 END + CASE WHEN region_risk_score IS NULL THEN 1 ELSE 0 END AS missing
  FROM factors)
)"""


def proposal_ctes() -> tuple[str, ...]:
    return (BENCHMARKS_SQL, PROPOSALS_SQL)
