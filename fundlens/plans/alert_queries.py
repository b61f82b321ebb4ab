"""Alerts: derivation, action log, deadlines, scope, evidence, notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.operators import alerts as al
from fundlens.plans import common as cm
from fundlens.plans.common import alert_ctes, works_sql
from fundlens.plans.registry import query
from fundlens.sources import driver_tables as dt
from fundlens.sources.tables import case_bundle_lines

_FOLD = alert_ctes(cm.ACTIONS_SQL, cm.FOLDED_SQL)
_NOW = "TIMESTAMP '1998-06-15 12:00:00'"


@query(works_sql("""SELECT alert_id, work_id, district, state, CAST(sanction_amount AS DOUBLE) AS sanction_amount, spent_amount, risk_score, severity, reason, source, status, created_at, sla_deadline FROM alerts""", *alert_ctes()))
def alerts_from_works(spark: SparkSession, sf: str) -> DataFrame:
    return cm.alerts(spark, sf).select(
        "alert_id", "work_id", "district", "state", F.col("sanction_amount").cast("double").alias("sanction_amount"),
        "spent_amount", "risk_score", "severity", "reason", "source", "status", "created_at", "sla_deadline",
    )


@query(works_sql("SELECT alert_id, status, dismiss_reason, actioned_at, actions FROM folded", *_FOLD))
def latest_alert_state(spark: SparkSession, sf: str) -> DataFrame:
    return cm.folded_alerts(spark, sf).select("alert_id", "status", "dismiss_reason", "actioned_at", "actions")


@query(cm.with_ctes(cm.ACTIONS_SQL, body="""SELECT log_id, CASE WHEN action IN ('ACTION', 'ESCALATE', 'DISMISS') THEN 'a dismissal needs a reason' ELSE 'unknown action' END AS reject_reason
FROM actions WHERE log_id NOT IN (SELECT log_id FROM valid_actions)"""))
def rejected_actions(spark: SparkSession, sf: str) -> DataFrame:
    return al.split_actions(cm.actions(spark, sf))[1].select("log_id", "reject_reason")


@query(works_sql("""SELECT log_id, alert_id, v.action, actor, coalesce(v.dismiss_reason, 'Case status updated to ' || CASE v.action WHEN 'ACTION' THEN 'ACTIONED' WHEN 'ESCALATE' THEN 'ESCALATED' ELSE 'DISMISSED' END) AS note
FROM valid_actions v JOIN alerts USING (alert_id)""", *_FOLD))
def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return al.audit_rows(cm.alerts(spark, sf), cm.actions(spark, sf)).select("log_id", "alert_id", "action", "actor", "note")


@query(works_sql("""SELECT log_id, actor AS user_id, CASE WHEN v.action = 'ESCALATE' THEN 'ESCALATED' ELSE 'NEW_ALERT' END AS type, work_id,
  'Alert ' || alert_id || ' (' || substr(work_title, 1, 30) || '...) was marked ' || CASE v.action WHEN 'ACTION' THEN 'ACTIONED' WHEN 'ESCALATE' THEN 'ESCALATED' ELSE 'DISMISSED' END || ' by ' || actor || '.' AS message
FROM valid_actions v JOIN alerts USING (alert_id)""", *_FOLD))
def action_notifications(spark: SparkSession, sf: str) -> DataFrame:
    return al.action_notifications(cm.alerts(spark, sf), cm.actions(spark, sf)).drop("created_at")


_TIER = f"""CASE WHEN status IN ('ACTIONED', 'DISMISSED') THEN 'RESOLVED' WHEN sla_deadline <= {_NOW} THEN 'OVERDUE'
  WHEN sla_deadline < {_NOW} + INTERVAL 12 HOUR THEN 'UNDER_12H' WHEN sla_deadline < {_NOW} + INTERVAL 24 HOUR THEN 'UNDER_24H' ELSE 'NORMAL' END"""


@query(works_sql(f"SELECT alert_id, status, {_TIER} AS tier FROM folded", *_FOLD))
def sla_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return cm.folded_alerts(spark, sf).select("alert_id", "status", al.sla_tier(cm.as_of()).alias("tier"))


@query(works_sql(f"SELECT alert_id, status FROM folded WHERE status = 'ESCALATED' OR (status = 'OPEN' AND sla_deadline < {_NOW})", *_FOLD))
def escalation_queue(spark: SparkSession, sf: str) -> DataFrame:
    return al.escalation_queue(cm.folded_alerts(spark, sf), cm.as_of()).select("alert_id", "status")


@query(works_sql(f"""SELECT work_id, min(alert_id) AS alert_id, min(district) AS scope_id, 'SLA_WARNING' AS type,
  CAST(floor(min(epoch_us(sla_deadline) - epoch_us({_NOW})) / 1000000 / 3600.0 + 0.5) AS INTEGER) AS hours_left
FROM folded WHERE status = 'OPEN' AND sla_deadline > {_NOW} AND sla_deadline < {_NOW} + INTERVAL 24 HOUR GROUP BY work_id""", *_FOLD))
def sla_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return al.sla_warnings(cm.folded_alerts(spark, sf), cm.as_of())


@query(works_sql("""SELECT severity, count(*) AS open_alerts FROM folded WHERE status = 'OPEN' GROUP BY 1""", *_FOLD))
def live_counters(spark: SparkSession, sf: str) -> DataFrame:
    return al.live_counters(cm.folded_alerts(spark, sf))


@query(works_sql("""SELECT alert_id FROM alerts WHERE work_id IN (SELECT unique_work_number FROM works WHERE lower(constituency) = 'building' OR contains(lower(mp_name), 'building'))""", *alert_ctes()))
def scoped_alerts(spark: SparkSession, sf: str) -> DataFrame:
    works = dt.works(spark, sf, "unique_work_number", "constituency", "mp_name")
    return al.scoped_alerts(cm.alerts(spark, sf), works, "MP", "BUILDING").select("alert_id")


@query(works_sql("""SELECT alert_id, risk_score FROM alerts WHERE lower(severity) = 'high' AND lower(status) = 'open' AND lower(source) = 'ai_flagged'
  AND (contains(lower(work_title), 'ward 7') OR contains(lower(work_id), 'ward 7') OR contains(lower(vendor_name), 'ward 7') OR contains(lower(alert_id), 'ward 7'))
""", *alert_ctes()))
def search_alerts(spark: SparkSession, sf: str) -> DataFrame:
    found = al.search_alerts(cm.alerts(spark, sf), "high", "open", "ai_flagged", "Ward 7")
    return found.orderBy(F.desc("risk_score"), "alert_id").select("alert_id", "risk_score")


@query(works_sql("""SELECT f.alert_id, f.work_id, f.status, severity, risk_score, work_category, w.work_status, coalesce(l.n, 0) AS audit_entries, l.last_action_at,
  coalesce(s.n, 0) - CASE WHEN w.sanction_amount < 400000 THEN 1 ELSE 0 END AS split_candidates, v.n AS vendor_projects, v.delayed AS vendor_delayed, v.flagged AS vendor_flagged
FROM folded f JOIN works w ON f.work_id = w.unique_work_number
LEFT JOIN (SELECT alert_id, count(*) AS n, max(acted_at) AS last_action_at FROM valid_actions JOIN alerts USING (alert_id) GROUP BY 1) l ON f.alert_id = l.alert_id
LEFT JOIN (SELECT vendor_id, nodal_district, count(*) AS n FROM works WHERE sanction_amount < 400000 GROUP BY 1, 2) s ON w.vendor_id = s.vendor_id AND w.nodal_district = s.nodal_district
LEFT JOIN (SELECT vendor_id, count(*) AS n, count(*) FILTER (work_status = 'Stalled') AS delayed, count(*) FILTER (is_anomaly) AS flagged FROM works GROUP BY 1) v ON w.vendor_id = v.vendor_id""", *_FOLD))
def alert_details(spark: SparkSession, sf: str) -> DataFrame:
    works = dt.works(spark, sf, "unique_work_number", "work_category", "work_status", "nodal_district", "vendor_id", "sanction_amount", "is_anomaly")
    alerts = cm.alerts(spark, sf)
    folded = al.fold_alert_actions(alerts, cm.actions(spark, sf))
    return al.alert_details(folded, works, al.audit_rows(alerts, cm.actions(spark, sf)), 400_000)


@query(works_sql("""SELECT bundle_id, part, count(*) AS lines, count(DISTINCT seq) AS seqs FROM (
  SELECT 'CASE-BUNDLE-' || alert_id AS bundle_id, '1-alert' AS part, '' AS seq FROM folded WHERE status = 'ESCALATED'
  UNION ALL SELECT 'CASE-BUNDLE-' || alert_id, '2-work', '' FROM folded WHERE status = 'ESCALATED'
  UNION ALL SELECT 'CASE-BUNDLE-' || alert_id, '3-audit', CAST(log_id AS VARCHAR) FROM folded JOIN valid_actions USING (alert_id) WHERE status = 'ESCALATED') GROUP BY 1, 2""", *_FOLD))
def case_bundles(spark: SparkSession, sf: str) -> DataFrame:
    works = dt.works(spark, sf, "unique_work_number", "state", "nodal_district", "sanction_amount", "work_status")
    alerts = cm.alerts(spark, sf)
    folded = al.fold_alert_actions(alerts, cm.actions(spark, sf))
    audit = al.audit_rows(alerts, cm.actions(spark, sf)).drop("work_id")
    lines = case_bundle_lines(folded, works, audit).where(F.length("body") > 2)
    return lines.groupBy("bundle_id", "part").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("seq").alias("seqs")
    )


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = dt.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("evidence_id"),
        F.concat(F.lit("ALT-"), dt.work_number(F.floor(F.col("event_id") / 4).cast("bigint"))).alias("alert_id"),
        F.when(F.col("event_type").isin("view", "click"), F.col("props")).alias("note"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("photo-"), F.col("event_id").cast("string"))).alias("photo_url"),
    )


@query(works_sql("""SELECT alert_id, count(*) FILTER (event_type IN ('view', 'click')) AS notes, count(*) FILTER (event_type = 'purchase') AS photos, max(event_id) AS last_evidence_id
FROM (SELECT *, 'ALT-W' || lpad(CAST(event_id // 4 AS VARCHAR), 8, '0') AS alert_id FROM events WHERE event_type IN ('view', 'click', 'purchase')) JOIN alerts USING (alert_id) GROUP BY alert_id""", *alert_ctes()))
def evidence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return al.evidence_counts(al.collect_evidence(cm.alerts(spark, sf), _evidence(spark, sf)))


def _status_events(spark: SparkSession, sf: str) -> DataFrame:
    e = dt.table(spark, sf, "events")
    return e.select(
        "event_id",
        dt.work_number(F.floor(F.col("event_id") / 2).cast("bigint")).alias("work_id"),
        F.when(F.col("event_type") == "purchase", "Approved")
        .when(F.col("event_type") == "view", "Completed")
        .when(F.col("event_type") == "error", "Stalled")
        .alias("status"),
        F.when(F.col("event_type") == "view", F.col("props")).alias("note"),
        F.to_date("ts").alias("happened_on"),
    )


_STATUS_EVENTS = """status_events AS (
  SELECT event_id, 'W' || lpad(CAST(event_id // 2 AS VARCHAR), 8, '0') AS work_id,
    CASE event_type WHEN 'purchase' THEN 'Approved' WHEN 'view' THEN 'Completed' WHEN 'error' THEN 'Stalled' END AS status,
    CASE WHEN event_type = 'view' THEN props END AS note, CAST(ts AS DATE) AS happened_on FROM events)"""


@query(works_sql("""SELECT unique_work_number, coalesce(s.status, work_status) AS work_status,
  coalesce(CASE WHEN order_key % 2 = 0 THEN date_of_administrative_approval END, a.approved_on) AS date_of_administrative_approval, n.note AS last_note
FROM works
LEFT JOIN (SELECT work_id, arg_max(status, struct_pack(a := happened_on, b := event_id)) AS status FROM status_events WHERE status IS NOT NULL GROUP BY 1) s ON s.work_id = unique_work_number
LEFT JOIN (SELECT work_id, min(happened_on) AS approved_on FROM status_events WHERE status = 'Approved' GROUP BY 1) a ON a.work_id = unique_work_number
LEFT JOIN (SELECT work_id, arg_max(note, struct_pack(a := happened_on, b := event_id)) AS note FROM status_events WHERE note <> '' AND status IS NOT NULL GROUP BY 1) n ON n.work_id = unique_work_number""", _STATUS_EVENTS))
def apply_status_events(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "order_key", "unique_work_number", "work_status", "date_of_administrative_approval")
    half = w.withColumn(
        "date_of_administrative_approval",
        F.when(F.col("order_key") % 2 == 0, F.col("date_of_administrative_approval")),
    ).drop("order_key")
    return al.apply_status_events(half, _status_events(spark, sf))


def _notifications(spark: SparkSession, sf: str) -> DataFrame:
    e = dt.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("notification_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_type") == "error", "DISTRICT").otherwise("STATE").alias("role"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("NATION_"), (F.col("event_id") % 25).cast("string"))).alias("scope_id"),
        (F.col("event_type") == "click").alias("read"),
        F.col("ts").alias("created_at"),
    )


_VISIBLE = """visible AS (SELECT event_id AS notification_id, ts AS created_at, event_type = 'click' AS "read" FROM events
  WHERE user_id = 5 OR (event_type = 'error' AND (event_id % 3 = 0 OR event_id % 25 = 7)))"""


@query(cm.with_ctes(_VISIBLE, body='SELECT count(*) FILTER (NOT "read") AS unread, count(*) AS visible FROM visible'))
def unread_count(spark: SparkSession, sf: str) -> DataFrame:
    return al.unread_count(al.scoped_notifications(_notifications(spark, sf), "user-5", "DISTRICT", "Nation_7"))


@query(cm.with_ctes(_VISIBLE, body='SELECT notification_id, created_at, "read" FROM visible ORDER BY created_at DESC, notification_id LIMIT 30'))
def scoped_notifications(spark: SparkSession, sf: str) -> DataFrame:
    seen = al.scoped_notifications(_notifications(spark, sf), "user-5", "DISTRICT", "Nation_7")
    return al.notification_page(seen).select("notification_id", "created_at", "read")


@query(works_sql("""SELECT event_id AS complaint_id, nodal_district AS queue, ts + INTERVAL 48 HOUR AS respond_by, ts + INTERVAL 7 DAY AS resolve_by
FROM events JOIN works ON unique_work_number = 'W' || lpad(CAST(event_id AS VARCHAR), 8, '0')"""))
def route_complaints(spark: SparkSession, sf: str) -> DataFrame:
    e = dt.table(spark, sf, "events")
    complaints = e.select(
        F.col("event_id").alias("complaint_id"), dt.work_number(F.col("event_id")).alias("work_id"), F.col("ts").alias("received_at")
    )
    return al.route_complaints(complaints, dt.works(spark, sf, "unique_work_number", "nodal_district")).select(
        "complaint_id", "queue", "respond_by", "resolve_by"
    )
