"""Alerts from works and proposals, their action log, SLA tiers, scope and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.functions.numbers import LAKH, count_when, round_even, spent_amount

SLA_HOURS = 72
PROPOSAL_ALERT_FROM = 0.7
COMPLAINT_SLA_HOURS = 48
DISTRICT_WINDOW_DAYS = 7
# What an action does to an alert.
ACTION_STATUS = {"ACTION": "ACTIONED", "ESCALATE": "ESCALATED", "DISMISS": "DISMISSED"}
SEARCHED_WORK_COLUMNS = ("work_name", "unique_work_number", "vendor_name", "constituency", "nodal_district")
SEARCHED_ALERT_COLUMNS = ("work_title", "work_id", "vendor_name", "alert_id")


def alert_severity(score: Column) -> Column:
    return F.when(score >= 0.8, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")


def _hours_after(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours))


def alerts_from_works(profiles: DataFrame, created_at: Column, sla_hours: int = SLA_HOURS) -> DataFrame:
    """One open alert per anomalous work; risk is the composite score of its profile."""
    kind = F.col("anomaly_type")
    reason = (
        F.when(kind.contains("split_invoicing"), "Sequential sanctions under the tender threshold within days.")
        .when(kind.contains("ghost_project"), "Severe gap between physical and financial progress.")
        .when(
            kind.contains("cost_overrun"),
            F.format_string(
                "Sanctioned amount %.1f Lakh exceeds the category benchmark.",
                F.col("sanction_amount").cast("double") / LAKH,
            ),
        )
        .when(kind.contains("fund_dumping"), "Year-end fund dumping.")
        .otherwise("Duplicate registration of a work site.")
    )
    score = round_even(F.col("composite_risk_score"), 2)
    return profiles.where("is_anomaly").select(
        F.concat(F.lit("ALT-"), "unique_work_number").alias("alert_id"),
        F.col("unique_work_number").alias("work_id"),
        F.col("work_name").alias("work_title"),
        F.col("nodal_district").alias("district"),
        "state", "mp_name", "constituency", "vendor_id", "vendor_name", "sanction_amount",
        spent_amount(F.col("sanction_amount"), F.col("financial_progress_pct")).alias("spent_amount"),
        score.alias("risk_score"),
        alert_severity(score).alias("severity"),
        reason.alias("reason"),
        F.lit("AI_FLAGGED").alias("source"),
        F.lit("OPEN").alias("status"),
        created_at.alias("created_at"),
        _hours_after(created_at, sla_hours).alias("sla_deadline"),
    )


def proposal_alerts(
    scored: DataFrame, key: str, created_at: Column, min_score: float = PROPOSAL_ALERT_FROM, sla_hours: int = SLA_HOURS
) -> DataFrame:
    """High alerts for proposals scoring at least ``min_score``."""
    return scored.where(F.col("overall_score") >= min_score).select(
        F.concat(F.lit("ALT-PROP-"), key).alias("alert_id"),
        F.col(key).alias("work_id"),
        F.col("overall_score").alias("risk_score"),
        F.lit("HIGH").alias("severity"),
        F.lit("AI_FLAGGED").alias("source"),
        F.lit("OPEN").alias("status"),
        created_at.alias("created_at"),
        _hours_after(created_at, sla_hours).alias("sla_deadline"),
    )


def feedback_alerts(assessed: DataFrame, created_at: Column, sla_hours: int = SLA_HOURS) -> DataFrame:
    """Alerts for high-risk citizen feedback."""
    return assessed.where("is_high_risk").select(
        F.concat(F.lit("ALT-CITIZEN-"), F.col("feedback_id").cast("string")).alias("alert_id"),
        "work_id",
        F.lit(0.88).alias("risk_score"),
        F.lit("HIGH").alias("severity"),
        F.concat(F.lit("[Citizen Ground Report] "), "reason").alias("reason"),
        F.lit("CITIZEN_REPORTED").alias("source"),
        F.lit("OPEN").alias("status"),
        created_at.alias("created_at"),
        _hours_after(created_at, sla_hours).alias("sla_deadline"),
    )


def feedback_notifications(alerts: DataFrame, works: DataFrame) -> DataFrame:
    """Two notifications per feedback alert: to the district and to the member of its work, where known.

    ``works`` needs ``unique_work_number``, ``nodal_district`` and ``mp_name``. The id follows from
    the alert, so that a repeated alert doesn't notify twice.
    """
    places = works.select(F.col("unique_work_number").alias("work_id"), "nodal_district", "mp_name")
    to = F.explode(
        F.array(
            F.struct(F.lit("DISTRICT").alias("role"), F.col("nodal_district").alias("scope_id")),
            F.struct(F.lit("MP").alias("role"), F.col("mp_name").alias("scope_id")),
        )
    )
    return (
        alerts.join(places, "work_id")
        .select("alert_id", "work_id", "reason", "created_at", to.alias("to"))
        .where("to.scope_id IS NOT NULL")
        .select(
            F.concat_ws("-", F.lit("NTF"), "alert_id", "to.role").alias("notification_id"),
            "to.role", "to.scope_id", F.lit("NEW_ALERT").alias("type"), "work_id",
            F.col("reason").alias("message"), "created_at",
        )
    )


def action_error() -> Column:
    """Why an action may not be applied, NULL when it may."""
    return F.when(
        ~F.coalesce(F.col("action").isin(*ACTION_STATUS), F.lit(False)), "unknown action"
    ).when(
        (F.col("action") == "DISMISS") & (F.coalesce(F.trim("dismiss_reason"), F.lit("")) == ""),
        "a dismissal needs a reason",
    )


def split_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) actions; rejected ones carry ``reject_reason``."""
    checked = actions.withColumn("reject_reason", action_error())
    return (
        checked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.where(F.col("reject_reason").isNotNull()),
    )


def _new_status(action: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, status in ACTION_STATUS.items():
        out = F.when(action == name, status).otherwise(out)
    return out


def fold_alert_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts in the state after their last valid action, with ``actioned_at`` of the first one.

    ``actions`` is (log_id, alert_id, action, dismiss_reason, actor, acted_at); the latest wins,
    ties by log id.
    """
    valid, _ = split_actions(actions)
    last = valid.groupBy("alert_id").agg(
        F.max(F.struct("acted_at", "log_id", "action", "dismiss_reason")).alias("last"),
        F.min("acted_at").alias("actioned_at"),
        F.count(F.lit(1)).alias("actions"),
    )
    dismissed = F.col("last.action") == "DISMISS"
    return alerts.join(last, "alert_id", "left").select(
        *[alerts[c] for c in alerts.columns if c != "status"],
        F.coalesce(_new_status(F.col("last.action")), alerts["status"]).alias("status"),
        F.when(dismissed, F.col("last.dismiss_reason")).alias("dismiss_reason"),
        "actioned_at",
        F.coalesce("actions", F.lit(0)).alias("actions"),
    )


def audit_rows(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """One audit row per valid action on a known alert."""
    valid, _ = split_actions(actions)
    return valid.join(alerts.select("alert_id", "work_id"), "alert_id").select(
        "log_id", "alert_id", "work_id", "actor", "action", "acted_at",
        F.coalesce(
            F.col("dismiss_reason"), F.concat(F.lit("Case status updated to "), _new_status(F.col("action")))
        ).alias("note"),
    )


def action_notifications(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    valid, _ = split_actions(actions)
    return valid.join(alerts.select("alert_id", "work_id", "work_title"), "alert_id").select(
        "log_id",
        F.col("actor").alias("user_id"),
        F.when(F.col("action") == "ESCALATE", "ESCALATED").otherwise("NEW_ALERT").alias("type"),
        "work_id",
        F.concat(
            F.lit("Alert "), "alert_id", F.lit(" ("), F.substring("work_title", 1, 30),
            F.lit("...) was marked "), _new_status(F.col("action")), F.lit(" by "), "actor", F.lit("."),
        ).alias("message"),
        F.col("acted_at").alias("created_at"),
    )


def seconds_left(as_of: Column) -> Column:
    return F.timestamp_diff("SECOND", as_of, F.col("sla_deadline"))


def sla_tier(as_of: Column) -> Column:
    """Resolved, overdue, under 12 hours, under 24 hours or normal."""
    left = seconds_left(as_of)
    return (
        F.when(F.col("status").isin("ACTIONED", "DISMISSED"), "RESOLVED")
        .when(left <= 0, "OVERDUE")
        .when(left < 12 * 3600, "UNDER_12H")
        .when(left < 24 * 3600, "UNDER_24H")
        .otherwise("NORMAL")
    )


def escalation_queue(alerts: DataFrame, as_of: Column) -> DataFrame:
    late = (F.col("status") == "OPEN") & (seconds_left(as_of) < 0)
    return alerts.where((F.col("status") == "ESCALATED") | late)


def sla_warnings(alerts: DataFrame, as_of: Column, sent: DataFrame | None = None) -> DataFrame:
    """One warning per work with an open alert due within a day; ``sent`` works are skipped."""
    left = seconds_left(as_of)
    due = alerts.where((F.col("status") == "OPEN") & (left > 0) & (left < 86400))
    if sent is not None:
        known = sent.where(F.col("type") == "SLA_WARNING").select("work_id").distinct()
        due = due.join(known, "work_id", "left_anti")
    first = due.groupBy("work_id").agg(
        F.min(F.struct("alert_id", "district", left.alias("left"))).alias("a")
    )
    return first.select(
        "work_id",
        F.col("a.alert_id").alias("alert_id"),
        F.col("a.district").alias("scope_id"),
        F.lit("SLA_WARNING").alias("type"),
        F.floor(F.col("a.left") / 3600.0 + 0.5).cast("int").alias("hours_left"),
    )


def collect_evidence(alerts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of known alerts, one row each, numbered notes and photos counted per alert.

    ``evidence`` is (evidence_id, alert_id, note, photo_url); rows without note and photo are
    dropped.
    """
    usable = (F.coalesce("note", F.lit("")) != "") | (F.coalesce("photo_url", F.lit("")) != "")
    return evidence.where(usable).join(alerts.select("alert_id"), "alert_id", "left_semi")


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("alert_id").agg(
        count_when(F.coalesce("note", F.lit("")) != "").alias("notes"),
        count_when(F.coalesce("photo_url", F.lit("")) != "").alias("photos"),
        F.max("evidence_id").alias("last_evidence_id"),
    )


def apply_status_events(works: DataFrame, events: DataFrame) -> DataFrame:
    """Works after their status events: last status, approval stamp if blank, latest note.

    ``events`` is (event_id, work_id, status, note, happened_on); events without a status are
    ignored. The approval date of a work without one is the day of its first approval event.
    """
    valid = events.where(F.coalesce("status", F.lit("")) != "")
    fold = valid.groupBy("work_id").agg(
        F.max(F.struct("happened_on", "event_id", "status")).alias("last"),
        F.min(F.when(F.col("status") == "Approved", F.col("happened_on"))).alias("approved_on"),
        F.max(F.when(F.col("note") != "", F.struct("happened_on", "event_id", "note"))).alias("noted"),
    )
    joined = works.join(fold, works.unique_work_number == fold.work_id, "left")
    changed = {
        "work_status": F.coalesce(F.col("last.status"), works["work_status"]),
        "date_of_administrative_approval": F.coalesce(
            works["date_of_administrative_approval"], F.col("approved_on")
        ),
    }
    out = [changed[c].alias(c) if c in changed else works[c] for c in works.columns]
    return joined.select(*out, F.col("noted.note").alias("last_note"))


def route_complaints(complaints: DataFrame, works: DataFrame) -> DataFrame:
    """Complaints about a known work, with the district that has to act and both deadlines."""
    where = works.select(F.col("unique_work_number").alias("work_id"), F.col("nodal_district").alias("queue"))
    received = F.col("received_at")
    return complaints.join(where, "work_id").withColumns(
        {
            "respond_by": _hours_after(received, COMPLAINT_SLA_HOURS),
            "resolve_by": received + F.make_dt_interval(F.lit(DISTRICT_WINDOW_DAYS)),
        }
    )


# Row scope. A user sees what the role and the scope name allow.


def works_in_scope(role: str, scope: str | None) -> Column:
    name = (scope or "").lower()

    def is_name(c: str) -> Column:
        return F.lower(c) == name

    if role == "MINISTRY":
        return F.lit(True)
    if role == "STATE":
        return is_name("state")
    if role == "DISTRICT":
        return is_name("nodal_district") | is_name("implementing_district")
    if role == "MP":
        return is_name("constituency") | F.lower("mp_name").contains(name)
    if role == "CITIZEN":
        return F.lit(True) if not name else is_name("nodal_district") | is_name("implementing_district")
    return F.lit(False)


def scoped_works(works: DataFrame, role: str, scope: str | None = None) -> DataFrame:
    return works.where(works_in_scope(role, scope))


def scoped_alerts(alerts: DataFrame, works: DataFrame, role: str, scope: str | None = None) -> DataFrame:
    name = (scope or "").lower()
    if role == "MINISTRY":
        return alerts
    if role == "STATE":
        return alerts.where(F.lower("state") == name)
    if role == "DISTRICT" or (role == "CITIZEN" and name):
        return alerts.where(F.lower("district") == name)
    if role == "CITIZEN":
        return alerts
    if role == "MP":
        seen = scoped_works(works, role, scope).select(F.col("unique_work_number").alias("work_id"))
        return alerts.join(seen, "work_id", "left_semi")
    return alerts.where(F.lit(False))


def scope_counts(works: DataFrame, users: list[tuple[str, str | None]]) -> DataFrame:
    """Visible works and their anomalies for several users, counted in one pass."""
    aggs, rows = [], []
    for i, (role, scope) in enumerate(users):
        cond = works_in_scope(role, scope)
        aggs += [count_when(cond).alias(f"w{i}"), count_when(cond & F.col("is_anomaly")).alias(f"a{i}")]
        rows.append(
            F.struct(
                F.lit(role).alias("role"), F.lit(scope or "").alias("scope"),
                F.col(f"w{i}").alias("works"), F.col(f"a{i}").alias("anomalies"),
            )
        )
    return works.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scoped_notifications(notifications: DataFrame, user_id: str, role: str, scope: str | None) -> DataFrame:
    if role == "MINISTRY":
        return notifications
    same_scope = (F.coalesce("scope_id", F.lit("")) == "") | (F.lower("scope_id") == (scope or "").lower())
    mine = (F.col("user_id") == user_id) | ((F.col("role") == role) & same_scope)
    return notifications.where(mine)


def notification_page(visible: DataFrame, k: int = 30) -> DataFrame:
    """The newest ``k`` notifications."""
    return visible.orderBy(F.desc("created_at"), "notification_id").limit(k)


def unread_count(visible: DataFrame) -> DataFrame:
    return visible.agg(count_when(~F.col("read")).alias("unread"), F.count(F.lit(1)).alias("visible"))


def _search(columns: tuple[str, ...], text: str) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c).contains(text.lower()) for c in columns])


def _same(column: str, value: str | None) -> Column:
    return F.lit(True) if value is None else F.lower(column) == value.lower()


def search_works(
    works: DataFrame,
    category: str | None = None,
    status: str | None = None,
    is_anomaly: bool | None = None,
    search: str | None = None,
) -> DataFrame:
    cond = _same("work_category", category) & _same("work_status", status)
    if is_anomaly is not None:
        cond = cond & (F.col("is_anomaly") == is_anomaly)
    if search:
        cond = cond & _search(SEARCHED_WORK_COLUMNS, search)
    return works.where(cond)


def search_alerts(
    alerts: DataFrame,
    severity: str | None = None,
    status: str | None = None,
    source: str | None = None,
    search: str | None = None,
) -> DataFrame:
    cond = _same("severity", severity) & _same("status", status) & _same("source", source)
    if search:
        cond = cond & _search(SEARCHED_ALERT_COLUMNS, search)
    return alerts.where(cond)


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def lookup_name(df: DataFrame, column: str, text: str) -> DataFrame:
    """One row: the exact name if present, else the smallest name that contains ``text``."""
    exact = F.max(F.when(F.col(column) == text, F.col(column)))
    like = F.min(F.when(F.lower(column).contains(text.lower()), F.col(column)))
    return df.agg(F.coalesce(exact, like).alias(column))


def alert_details(alerts: DataFrame, works: DataFrame, audit_log: DataFrame, limit: float = 25e5) -> DataFrame:
    """Each alert with its work, audit entries, other small works of its vendor and vendor record."""
    w = works.select(
        F.col("unique_work_number").alias("work_id"), "work_category", "work_status",
        "nodal_district", "vendor_id", F.col("sanction_amount").alias("_amount"),
    )
    logs = audit_log.groupBy("alert_id").agg(
        F.count(F.lit(1)).alias("audit_entries"), F.max("acted_at").alias("last_action_at")
    )
    small = works.where(F.col("sanction_amount") < limit).groupBy("vendor_id", "nodal_district").agg(
        F.count(F.lit(1)).alias("_small")
    )
    vendor = works.groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("vendor_projects"),
        count_when(F.col("work_status") == "Stalled").alias("vendor_delayed"),
        count_when(F.col("is_anomaly")).alias("vendor_flagged"),
    )
    own = F.when(F.col("_amount") < limit, 1).otherwise(0)
    return (
        alerts.select("alert_id", "work_id", "status", "severity", "risk_score")
        .join(w, "work_id")
        .join(logs, "alert_id", "left")
        .join(small, ["vendor_id", "nodal_district"], "left")
        .join(vendor, "vendor_id", "left")
        .select(
            "alert_id", "work_id", "status", "severity", "risk_score", "work_category", "work_status",
            F.coalesce("audit_entries", F.lit(0)).alias("audit_entries"), "last_action_at",
            (F.coalesce("_small", F.lit(0)) - own).alias("split_candidates"),
            "vendor_projects", "vendor_delayed", "vendor_flagged",
        )
    )


def live_counters(alerts: DataFrame) -> DataFrame:
    """Open alerts by severity."""
    return alerts.where(F.col("status") == "OPEN").groupBy("severity").agg(F.count(F.lit(1)).alias("open_alerts"))
