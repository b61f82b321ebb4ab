"""Role dashboards, rankings and windowed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.operators import alerts as al
from fundlens.operators import dashboards as db
from fundlens.operators import retrieval as rt
from fundlens.plans import common as cm
from fundlens.plans.common import works_sql
from fundlens.plans.registry import query
from fundlens.sources import driver_tables as dt

APPROVED = "date_of_administrative_approval"
RECEIVED = "date_of_receipt_of_work_proposal_from_mp"

_CR = "round_even(CAST({} AS DOUBLE) / 10000000.0 * 100, 0) / 100"
_SPENT = "CAST(floor(CAST(sanction_amount AS DOUBLE) * (financial_progress_pct / 100.0) + 0.5) AS BIGINT)"


def _cr(x: str) -> str:
    return _CR.format(x)


def _pct(part: str, whole: str, digits: int) -> str:
    return f"round_even(CAST({part} AS DOUBLE) / {whole} * 100.0 * {10**digits}, 0) / {10**digits}"


def _whole(part: str, whole: str) -> str:
    return f"CAST(floor(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0 + 0.5) AS BIGINT)"


_KPI = "count(*) AS total_works, sum(sanction_amount) AS amount, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (work_status = 'Stalled') AS stalled_works"


@query(works_sql(f"""SELECT total_works, {_cr('amount')} AS total_sanctioned_cr, (SELECT count(*) FROM mp_master) AS total_mps, anomalies AS total_anomalies,
  {_pct('anomalies', 'total_works', 2)} AS anomaly_rate_pct, stalled_works, (SELECT count(*) FROM vendors WHERE is_hub) AS hub_contractors
FROM (SELECT {_KPI} FROM works)""", dt.VENDORS_SQL, dt.MP_MASTER_SQL))
def national_overview(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "sanction_amount", "is_anomaly", "work_status")
    return db.national_overview(w, dt.mp_master(spark, sf), dt.vendors(spark, sf))


@query(works_sql("""SELECT 'works' AS table_name, count(*) AS records FROM works UNION ALL SELECT 'vendors', count(*) FROM supplier
UNION ALL SELECT 'payments', count(*) FROM lineitem UNION ALL SELECT 'mp_master', count(*) FROM customer"""))
def record_counts(spark: SparkSession, sf: str) -> DataFrame:
    return db.record_counts(
        works=dt.works(spark, sf, "order_key"), vendors=dt.vendors(spark, sf),
        payments=dt.payments(spark, sf), mp_master=dt.mp_master(spark, sf),
    )


_MP = f"""mpk AS (SELECT *, {_whole('spent', 'allocated')} AS utilization_pct FROM (
  SELECT k.*, coalesce(CAST(m.allocated_amount AS DOUBLE), 50000000) AS allocated FROM (
    SELECT mp_name, min(state) AS state, min(constituency) AS constituency, {_KPI}, CAST(sum({_SPENT}) AS BIGINT) AS spent,
      count(*) FILTER (work_status = 'Completed') AS completed_works, count(*) FILTER (work_status = 'Work in Progress') AS in_progress_works
    FROM works GROUP BY mp_name) k LEFT JOIN mp_master m USING (mp_name)))"""
_MP_COLUMNS = ("mp_name", "state", "constituency", "sanction_amount", "financial_progress_pct", "is_anomaly", "work_status")


def _mp(spark: SparkSession, sf: str) -> DataFrame:
    return db.mp_dashboard(dt.works(spark, sf, *_MP_COLUMNS), dt.mp_master(spark, sf))


@query(works_sql(f"""SELECT mp_name, constituency, state, round_even(allocated / 10000000.0 * 100, 0) / 100 AS allocated_limit_cr, total_works,
  {_cr('amount')} AS total_sanctioned_cr, {_cr('spent')} AS total_spent_cr, utilization_pct, completed_works, in_progress_works, stalled_works, anomalies AS anomaly_works_count
FROM mpk""", dt.MP_MASTER_SQL, _MP))
def mp_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return _mp(spark, sf)


@query(works_sql("""SELECT mp_name, work_category, count(*) AS works FROM works GROUP BY 1, 2"""))
def mp_category_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return db.mp_category_distribution(dt.works(spark, sf, "mp_name", "work_category"))


@query(works_sql("""SELECT mp_name, unique_work_number, anomaly_type, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY mp_name ORDER BY unique_work_number) AS rank FROM works WHERE is_anomaly) WHERE rank <= 5"""))
def mp_top_anomalous_works(spark: SparkSession, sf: str) -> DataFrame:
    return db.top_anomalous_works(dt.works(spark, sf, "mp_name", "unique_work_number", "anomaly_type", "is_anomaly"), "mp_name", 5)


@query(works_sql("""SELECT nodal_district, unique_work_number, anomaly_type, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY nodal_district ORDER BY unique_work_number) AS rank FROM works WHERE is_anomaly) WHERE rank <= 10"""))
def district_flagged_works(spark: SparkSession, sf: str) -> DataFrame:
    return db.top_anomalous_works(
        dt.works(spark, sf, "nodal_district", "unique_work_number", "anomaly_type", "is_anomaly"), "nodal_district", 10
    )


_DISTRICT = """dw AS (SELECT nodal_district AS district, * FROM works
  UNION ALL SELECT implementing_district, * FROM works WHERE implementing_district <> nodal_district)"""


@query(works_sql(f"""SELECT district, total_works, {_cr('amount')} AS total_sanctioned_cr, {_cr('spent')} AS total_spent_cr, {_whole('spent', 'amount')} AS utilization_pct,
  anomalies AS anomalous_works, contractors_active, completed, in_progress, stalled_works AS stalled FROM (
  SELECT district, {_KPI}, sum({_SPENT}) AS spent, count(DISTINCT vendor_id) AS contractors_active, count(*) FILTER (work_status = 'Completed') AS completed,
    count(*) FILTER (work_status = 'Work in Progress') AS in_progress FROM dw GROUP BY district)""", _DISTRICT))
def district_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return db.district_dashboard(
        dt.works(
            spark, sf, "nodal_district", "implementing_district", "state", "sanction_amount",
            "financial_progress_pct", "is_anomaly", "work_status", "vendor_id",
        )
    )


@query(works_sql("""SELECT district, vendor_id, vendor_name, project_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY project_count DESC, vendor_id) AS rank FROM (
  SELECT district, vendor_id, min(vendor_name) AS vendor_name, count(*) AS project_count FROM dw GROUP BY 1, 2)) WHERE rank <= 5""", _DISTRICT))
def district_top_vendors(spark: SparkSession, sf: str) -> DataFrame:
    return db.district_top_vendors(
        dt.works(spark, sf, "nodal_district", "implementing_district", "vendor_id", "vendor_name")
    )


@query(works_sql("""SELECT district, count(*) FILTER (status = 'OPEN') AS open_alerts, count(*) FILTER (status = 'OPEN' AND severity = 'HIGH') AS high_risk_alerts,
  count(*) FILTER (status = 'OPEN' AND sla_deadline > TIMESTAMP '1998-06-15 12:00:00' AND sla_deadline < TIMESTAMP '1998-06-16 12:00:00') AS pending_sla_alerts
FROM folded GROUP BY district""", *cm.alert_ctes(cm.ACTIONS_SQL, cm.FOLDED_SQL)))
def district_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return db.district_alerts(cm.folded_alerts(spark, sf), cm.as_of())


@query(works_sql(f"""SELECT state, total_districts, total_works, {_cr('amount')} AS total_sanctioned_cr, anomalies AS total_anomalies,
  {_pct('anomalies', 'total_works', 2)} AS anomaly_rate_pct, stalled_works FROM (SELECT state, count(DISTINCT nodal_district) AS total_districts, {_KPI} FROM works GROUP BY state)"""))
def state_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return db.state_dashboard(dt.works(spark, sf, "state", "nodal_district", "sanction_amount", "is_anomaly", "work_status"))


@query(works_sql(f"""SELECT state, nodal_district, total_works, anomalies, rank, {_pct('anomalies', 'total_works', 1)} AS rate_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY anomalies DESC, nodal_district) AS rank FROM (
    SELECT state, nodal_district, count(*) AS total_works, count(*) FILTER (is_anomaly) AS anomalies FROM works GROUP BY 1, 2)) WHERE rank <= 6"""))
def state_district_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return db.state_district_ranking(dt.works(spark, sf, "state", "nodal_district", "is_anomaly"))


_STATE_COLUMNS = ("state", "sanction_amount", "financial_progress_pct", "is_anomaly", "work_status")
_STATES = f"""states AS (SELECT state, total_works, anomalies, {_pct('anomalies', 'total_works', 1)} AS rate_pct, {_cr('amount')} AS sanctioned_cr,
  {_whole('spent', 'amount')} AS utilization_pct FROM (SELECT state, {_KPI}, sum({_SPENT}) AS spent FROM works GROUP BY state))"""


@query(works_sql("SELECT * FROM states ORDER BY anomalies DESC, state LIMIT 8", _STATES))
def ministry_state_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return db.ministry_state_ranking(dt.works(spark, sf, *_STATE_COLUMNS))


@query(works_sql("SELECT anomaly_type, count(*) AS works FROM works WHERE is_anomaly AND anomaly_type <> '' GROUP BY 1"))
def ministry_anomaly_types(spark: SparkSession, sf: str) -> DataFrame:
    return db.ministry_anomaly_types(dt.works(spark, sf, "is_anomaly", "anomaly_type"))


@query(works_sql(f"""SELECT total_works AS active_works, {_cr('amount')} AS funds_released_cr, {_whole('spent', 'amount')} AS utilization_pct,
  floor(CAST(anomalies AS DOUBLE) / total_works * 100 * 10 + 0.5) / 10 AS national_flag_rate_pct, (SELECT count(*) FROM mp_master) AS total_mps
FROM (SELECT {_KPI}, sum({_SPENT}) AS spent FROM works)""", dt.MP_MASTER_SQL))
def ministry_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return db.ministry_kpis(dt.works(spark, sf, *_STATE_COLUMNS), dt.mp_master(spark, sf))


@query(works_sql(f"""SELECT CAST(2 - grouping(state) - grouping(nodal_district) AS INTEGER) AS "level", state, nodal_district, count(*) AS total_works,
  {_cr('sum(sanction_amount)')} AS sanctioned_cr, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (work_status = 'Stalled') AS stalled_works
FROM works GROUP BY ROLLUP (state, nodal_district)"""))
def region_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return db.region_rollup(dt.works(spark, sf, "state", "nodal_district", "sanction_amount", "is_anomaly", "work_status"))


@query(works_sql(f"""SELECT alert_id, work_id, state, district, {_cr('sanction_amount')} AS sanction_cr, risk_score FROM alerts
WHERE severity = 'HIGH' AND status = 'OPEN' ORDER BY risk_score DESC, alert_id LIMIT 8""", *cm.alert_ctes()))
def top_risk_queue(spark: SparkSession, sf: str) -> DataFrame:
    return db.top_risk_queue(cm.alerts(spark, sf))


@query(works_sql(f"""SELECT *, CASE WHEN on_time_pct > 80 AND flagged_projects = 0 THEN 'A' WHEN flagged_projects > 2 THEN 'C-' ELSE 'B' END AS rating,
  CASE WHEN flagged_projects > 1 THEN 'C' WHEN delayed_projects > 1 THEN 'B' ELSE 'A' END AS district_rating, total_projects >= 4 AS is_busy FROM (
  SELECT *, {_whole('total_projects - delayed_projects', 'total_projects')} AS on_time_pct FROM (
    SELECT vendor_id, min(vendor_name) AS vendor_name, count(*) AS total_projects, count(*) FILTER (work_status = 'Stalled') AS delayed_projects,
      count(*) FILTER (is_anomaly) AS flagged_projects, CAST(sum(sanction_amount) AS DOUBLE) AS total_sanctioned FROM works GROUP BY vendor_id))"""))
def vendor_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return db.vendor_scorecard(dt.works(spark, sf, "vendor_id", "vendor_name", "work_status", "is_anomaly", "sanction_amount"))


@query(works_sql(f"""SELECT vendor_id, active_states, states, total_works, {_cr('amount')} AS total_cr, {_whole('stalled_works', 'total_works')} AS delay_rate_pct, anomalies AS incidents FROM (
  SELECT vendor_id, count(DISTINCT state) AS active_states, string_agg(DISTINCT state, ', ' ORDER BY state) AS states, {_KPI} FROM works GROUP BY vendor_id) WHERE active_states >= 2"""))
def multi_state_vendors(spark: SparkSession, sf: str) -> DataFrame:
    return db.multi_state_vendors(dt.works(spark, sf, "vendor_id", "state", "sanction_amount", "is_anomaly", "work_status"))


@query(works_sql(f"""SELECT nodal_district, total_works, {_cr('amount')} AS sanctioned_cr, {_whole('spent', 'amount')} AS utilization_pct, coalesce(flags, 0) AS flags,
  CASE WHEN actioned > 0 THEN round_even(CAST(seconds AS DOUBLE) / actioned / 86400.0 * 10, 0) / 10 END AS avg_action_days,
  CASE WHEN CAST(coalesce(flags, 0) AS DOUBLE) / total_works >= 0.35 THEN 'HIGH' WHEN CAST(coalesce(flags, 0) AS DOUBLE) / total_works >= 0.32 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT nodal_district, {_KPI}, sum({_SPENT}) AS spent FROM works GROUP BY 1)
LEFT JOIN (SELECT district, count(*) AS flags, count(actioned_at) AS actioned,
    sum((epoch_us(actioned_at) - epoch_us(created_at)) // 1000000) AS seconds FROM folded GROUP BY 1) ON nodal_district = district""", *cm.alert_ctes(cm.ACTIONS_SQL, cm.FOLDED_SQL)))
def district_comparison(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "nodal_district", "sanction_amount", "financial_progress_pct", "is_anomaly", "work_status")
    return db.district_comparison(w, cm.folded_alerts(spark, sf))


@query(works_sql("""SELECT work_category, CAST(min(lo) AS DOUBLE) / 100000.0 AS min_lakh, CAST(max(hi) AS DOUBLE) / 100000.0 AS max_lakh, CAST(sum(d) AS DOUBLE) / sum(n) AS avg_days,
  arg_min(nodal_district, struct_pack(a := CAST(d AS DOUBLE) / n, b := nodal_district)) AS fastest_district, min(CAST(d AS DOUBLE) / n) AS fastest_days FROM (
  SELECT work_category, nodal_district, min(sanction_amount) AS lo, max(sanction_amount) AS hi,
    sum(date_of_administrative_approval - date_of_receipt_of_work_proposal_from_mp) AS d, count(*) AS n FROM works GROUP BY 1, 2) GROUP BY work_category"""))
def category_speed_cost(spark: SparkSession, sf: str) -> DataFrame:
    return db.category_speed_cost(dt.works(spark, sf, "work_category", "nodal_district", "sanction_amount", APPROVED, RECEIVED))


@query(cm.with_ctes(dt.VENDORS_SQL, dt.PAYMENTS_SQL, body="""SELECT vendor_id, state, payments, CAST(amount AS DOUBLE) AS amount,
  CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY state) AS DOUBLE) AS share
FROM (SELECT vendor_id, count(*) AS payments, sum(payment_amount) AS amount FROM payments GROUP BY 1) JOIN vendors USING (vendor_id)"""))
def vendor_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return db.vendor_concentration(dt.payments(spark, sf), dt.vendors(spark, sf))


@query(works_sql("""SELECT vendor_id, state, works, CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY state) AS DOUBLE) AS share FROM (
  SELECT vendor_id, state, count(*) AS works, sum(sanction_amount) AS amount FROM works GROUP BY 1, 2)"""))
def vendor_share_within_state(spark: SparkSession, sf: str) -> DataFrame:
    per = dt.works(spark, sf, "vendor_id", "state", "sanction_amount").groupBy("vendor_id", "state").agg(
        F.count(F.lit(1)).alias("works"), F.sum("sanction_amount").alias("amount")
    )
    return db.share_within(per, ["state"], "amount").drop("amount")


@query(works_sql("""SELECT *, works / state_mean AS ratio FROM (SELECT *, CAST(sum(works) OVER (PARTITION BY state) AS DOUBLE) / count(*) OVER (PARTITION BY state) AS state_mean FROM (
  SELECT state, nodal_district, count(*) FILTER (work_status = 'Work in Progress') AS ongoing, count(*) AS works FROM works GROUP BY 1, 2))"""))
def district_workload(spark: SparkSession, sf: str) -> DataFrame:
    return db.workload(dt.works(spark, sf, "state", "nodal_district", "work_status"), "nodal_district")


@query(works_sql("""SELECT *, works / state_mean AS ratio FROM (SELECT *, CAST(sum(works) OVER (PARTITION BY state) AS DOUBLE) / count(*) OVER (PARTITION BY state) AS state_mean FROM (
  SELECT state, vendor_id, count(*) FILTER (work_status = 'Work in Progress') AS ongoing, count(*) AS works FROM works GROUP BY 1, 2))"""))
def vendor_workload(spark: SparkSession, sf: str) -> DataFrame:
    return db.workload(dt.works(spark, sf, "state", "vendor_id", "work_status"), "vendor_id")


@query(works_sql(f"""SELECT mp_name, "month", month_no, actual, allocated * least(month_no, 60) / 60.0 AS target FROM (
  SELECT p.*, coalesce(CAST(m.allocated_amount AS DOUBLE), 50000000) AS allocated FROM (
    SELECT mp_name, "month", CAST(sum(spent) OVER w AS BIGINT) AS actual, CAST(date_diff('month', min("month") OVER w, "month") + 1 AS INTEGER) AS month_no FROM (
      SELECT mp_name, CAST(date_trunc('month', date_of_administrative_approval) AS DATE) AS "month", sum({_SPENT}) AS spent FROM works GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY mp_name ORDER BY "month")) p LEFT JOIN mp_master m USING (mp_name))""", dt.MP_MASTER_SQL))
def spend_pace(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "mp_name", APPROVED, "sanction_amount", "financial_progress_pct")
    return db.spend_pace(w, dt.mp_master(spark, sf))


@query(works_sql("""SELECT mp_name, state, utilization_pct, rank() OVER (PARTITION BY state ORDER BY utilization_pct DESC) AS rank_in_state,
  count(*) OVER (PARTITION BY state) AS state_mps, percent_rank() OVER (ORDER BY utilization_pct) AS national_percentile FROM mpk""", dt.MP_MASTER_SQL, _MP))
def peer_rank(spark: SparkSession, sf: str) -> DataFrame:
    return db.peer_rank(_mp(spark, sf))


@query(works_sql(f"""SELECT unique_work_number, instalment_no, instalment, CAST(floor(CAST(sanction_amount AS DOUBLE) * CAST(share AS DOUBLE) + 0.5) AS BIGINT) AS amount,
  CASE WHEN instalment_no = 4 THEN CASE WHEN work_status = 'Completed' THEN 'Disbursed' ELSE 'Held' END
       WHEN {_SPENT} >= CAST(sanction_amount AS DOUBLE) * CAST(released AS DOUBLE) THEN 'Disbursed' ELSE 'Pending' END AS status
FROM works, (VALUES (1, 'Advance Mobilization (20%)', 0.2, 0.0), (2, 'Stage 1 Plinth & Foundation (30%)', 0.3, 0.5),
  (3, 'Stage 2 Superstructure (35%)', 0.35, 0.85), (4, 'Final Settlement / Retention (15%)', 0.15, 9)) i(instalment_no, instalment, share, released)"""))
def drawdown_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return db.drawdown_schedule(dt.works(spark, sf, "unique_work_number", "sanction_amount", "financial_progress_pct", "work_status"))


@query(works_sql("""SELECT unique_work_number, stage_no, stage, CASE stage_no WHEN 1 THEN date_of_receipt_of_work_proposal_from_mp WHEN 2 THEN date_of_administrative_approval END AS stage_date,
  CASE WHEN stage_no <= 3 THEN TRUE WHEN stage_no = 4 THEN physical_progress_pct > 20 ELSE work_status = 'Completed' END AS completed,
  CASE stage_no WHEN 1 THEN mp_name WHEN 2 THEN nodal_district WHEN 3 THEN implementing_agency_name END AS officer
FROM works, (VALUES (1, 'Proposed'), (2, 'Approved'), (3, 'Contracted'),
  (4, 'Under construction'), (5, 'Finished')) s(stage_no, stage)"""))
def milestone_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return db.milestone_timeline(
        dt.works(
            spark, sf, "unique_work_number", RECEIVED, APPROVED, "mp_name", "nodal_district",
            "implementing_agency_name", "physical_progress_pct", "work_status",
        )
    )


@query(works_sql(f"SELECT unique_work_number, {_SPENT} AS spent_amount FROM works"))
def spent_amounts(spark: SparkSession, sf: str) -> DataFrame:
    from fundlens.functions.numbers import spent_amount

    w = dt.works(spark, sf, "unique_work_number", "sanction_amount", "financial_progress_pct")
    return w.select(
        "unique_work_number",
        spent_amount(F.col("sanction_amount"), F.col("financial_progress_pct")).alias("spent_amount"),
    )


@query(works_sql("SELECT work_status, count(*) AS works FROM works GROUP BY 1"))
def status_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rt.status_distribution(dt.works(spark, sf, "work_status"))


@query(works_sql("SELECT nodal_district, count(*) AS n FROM works GROUP BY 1 ORDER BY n DESC, nodal_district LIMIT 10"))
def most_common_districts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        dt.works(spark, sf, "nodal_district").groupBy("nodal_district").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "nodal_district").limit(10)
    )


@query(works_sql("""SELECT state, state || ': ' || total_works || ' works, ' || anomalies || ' flagged (' || printf('%.1f', rate_pct) || '%), ' || utilization_pct || '% of funds utilised.' AS brief FROM states""", _STATES))
def state_briefs(spark: SparkSession, sf: str) -> DataFrame:
    return db.brief_rows(db.state_kpis(dt.works(spark, sf, *_STATE_COLUMNS)))


@query(works_sql(f"""SELECT mp_name, mp_name || ' (' || constituency || '): ' || printf('%.2f', {_cr('spent')}) || ' Cr spent (' || utilization_pct || '% of ' ||
  printf('%.2f', round_even(allocated / 10000000.0 * 100, 0) / 100) || ' Cr), ' || total_works || ' works, ' || completed_works || ' completed, ' || in_progress_works || ' under way.' AS digest
FROM mpk""", dt.MP_MASTER_SQL, _MP))
def mp_digests(spark: SparkSession, sf: str) -> DataFrame:
    return db.digest_rows(_mp(spark, sf))


_USERS = [
    ("MINISTRY", None), ("STATE", "asia"), ("DISTRICT", "NATION_7"), ("MP", "Building"),
    ("MP", "customer#00000001"), ("CITIZEN", None), ("CITIZEN", "nation_3"), ("GUEST", None),
]


@query(works_sql("""SELECT role, scope, count(*) FILTER (seen) AS works, count(*) FILTER (seen AND is_anomaly) AS anomalies FROM (
  SELECT role, scope, is_anomaly, CASE WHEN role = 'MINISTRY' THEN TRUE WHEN role = 'STATE' THEN lower(state) = lower(scope)
    WHEN role = 'CITIZEN' AND scope = '' THEN TRUE
    WHEN role IN ('DISTRICT', 'CITIZEN') THEN lower(nodal_district) = lower(scope) OR lower(implementing_district) = lower(scope)
    WHEN role = 'MP' THEN lower(constituency) = lower(scope) OR contains(lower(mp_name), lower(scope)) ELSE FALSE END AS seen
  FROM works, (VALUES ('MINISTRY', ''), ('STATE', 'asia'), ('DISTRICT', 'NATION_7'), ('MP', 'Building'), ('MP', 'customer#00000001'), ('CITIZEN', ''), ('CITIZEN', 'nation_3'), ('GUEST', '')) u(role, scope))
GROUP BY 1, 2"""))
def scope_counts(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "state", "nodal_district", "implementing_district", "constituency", "mp_name", "is_anomaly")
    return al.scope_counts(w, _USERS)


@query(works_sql("""SELECT unique_work_number, state FROM works WHERE lower(nodal_district) = 'nation_7' OR lower(implementing_district) = 'nation_7'"""))
def scoped_works(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "unique_work_number", "state", "nodal_district", "implementing_district")
    return al.scoped_works(w, "DISTRICT", "Nation_7").select("unique_work_number", "state")


@query(works_sql("""SELECT unique_work_number, work_status FROM works WHERE lower(work_category) = 'promo' AND is_anomaly
  AND (contains(lower(work_name), 'nation_1') OR contains(lower(unique_work_number), 'nation_1') OR contains(lower(vendor_name), 'nation_1') OR contains(lower(constituency), 'nation_1') OR contains(lower(nodal_district), 'nation_1'))
ORDER BY unique_work_number LIMIT 50 OFFSET 20"""))
def search_works(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(
        spark, sf, "unique_work_number", "work_status", "work_category", "is_anomaly", "work_name",
        "vendor_name", "constituency", "nodal_district",
    )
    found = al.search_works(w, category="Promo", is_anomaly=True, search="NATION_1")
    return al.page(found, [F.col("unique_work_number")], 50, 20).select("unique_work_number", "work_status")


@query(works_sql("""SELECT coalesce(max(CASE WHEN mp_name = '000042' THEN mp_name END), min(CASE WHEN contains(lower(mp_name), '000042') THEN mp_name END)) AS mp_name FROM works"""))
def lookup_name(spark: SparkSession, sf: str) -> DataFrame:
    return al.lookup_name(dt.works(spark, sf, "mp_name"), "mp_name", "000042")
