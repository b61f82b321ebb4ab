"""Streams run over the tables, and their batch counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.operators import complaints as cp
from fundlens.plans import common as cm
from fundlens.plans import ingest_queries as iq
from fundlens.plans import text_queries as tq
from fundlens.plans.common import works_sql
from fundlens.plans.registry import query
from fundlens.session import materialise, scratch_path
from fundlens.sources import driver_tables as dt
from fundlens.sources import tables as tb
from fundlens.streaming import feeds, rate_limit as rl, runner, sla

_LIMIT = 3
_WINDOW = 12 * 3600

_RATE_SQL = f"""WITH RECURSIVE attempts AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch_us(ts) AS t_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT key, event_id, rn, TRUE AS accepted, [t_us] AS log FROM attempts WHERE rn = 1
  UNION ALL SELECT a.key, a.event_id, a.rn, len(list_filter(w.log, lambda t : a.t_us - t < {_WINDOW * 1_000_000})) < {_LIMIT},
    CASE WHEN len(list_filter(w.log, lambda t : a.t_us - t < {_WINDOW * 1_000_000})) < {_LIMIT} THEN list_append(list_filter(w.log, lambda t : a.t_us - t < {_WINDOW * 1_000_000}), a.t_us) ELSE list_filter(w.log, lambda t : a.t_us - t < {_WINDOW * 1_000_000}) END
  FROM walk w JOIN attempts a ON a.key = w.key AND a.rn = w.rn + 1)
SELECT key, event_id, accepted FROM walk"""


@query(_RATE_SQL)
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    events = dt.table(spark, sf, "events")
    return rl.rate_limit(events, "user_id", "ts", "event_id", _LIMIT, _WINDOW).select("key", "event_id", "accepted")


@query(_RATE_SQL)
def rate_limit_stream(spark: SparkSession, sf: str) -> DataFrame:
    events = runner.file_stream(spark, f"{sf}/events[.]parquet")
    return runner.drain(rl.rate_limit_stream(events, "user_id", "ts", "event_id", _LIMIT, _WINDOW), "rate-limit")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS severity, count(*) AS alerts FROM events
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def live_counter_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events by hour and kind, standing in for alerts and their severity: the hours that are over
    for good, an hour before the newest event."""
    events = runner.file_stream(spark, f"{sf}/events[.]parquet").withColumnRenamed("event_type", "severity")
    return runner.drain(sla.alert_counters(events, "ts"), "counters")


@query("""SELECT CAST(user_id AS VARCHAR) AS work_id, event_type AS type, count(DISTINCT user_id) AS warnings FROM events GROUP BY 1, 2""")
def warning_dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    events = runner.file_stream(spark, f"{sf}/events[.]parquet").select(
        F.col("user_id").cast("string").alias("work_id"), F.col("event_type").alias("type"), "ts"
    )
    kept = runner.drain(sla.warnings_once(events, "ts", "60 days"), "dedup")
    return kept.groupBy("work_id", "type").agg(F.count(F.lit(1)).alias("warnings"))


@query(works_sql("""SELECT work_id, alert_id, type FROM (SELECT work_id, alert_id, unnest(['SLA_WARNING', 'ESCALATED']) AS type, sla_deadline, (SELECT max(created_at) FROM alerts) - INTERVAL 1 HOUR AS mark FROM alerts)
WHERE mark >= CASE type WHEN 'SLA_WARNING' THEN sla_deadline - INTERVAL 24 HOUR ELSE sla_deadline END""", *cm.alert_ctes()))
def sla_monitor_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts in order of creation; time has passed up to the newest one."""
    alerts = materialise(
        cm.alerts(spark, sf).select("work_id", "alert_id", "status", "sla_deadline", "created_at"), "alert-feed"
    )
    path = alerts.inputFiles()[0].rsplit("/", 1)[0]
    stream = runner.file_stream(spark, path)
    return runner.drain(sla.sla_monitor(stream, "created_at"), "sla").select("work_id", "alert_id", "type")


@query(works_sql("SELECT feedback_id, urgency, distance_km, gps_mismatch, is_high_risk FROM assessed", tq._COMPLAINTS, tq.FEEDBACK_SQL))
def feedback_stream(spark: SparkSession, sf: str) -> DataFrame:
    feed = materialise(tq.feedback(spark, sf), "feedback-feed")
    path = feed.inputFiles()[0].rsplit("/", 1)[0]
    works = materialise(dt.works(spark, sf, "unique_work_number", "nodal_district"), "work-places")
    stream = feeds.assessed_stream(runner.file_stream(spark, path), works).select(
        "feedback_id", "urgency", "distance_km", "gps_mismatch", "is_high_risk"
    )
    return runner.drain(stream, "feedback")


_WORDS = "[" + ", ".join(f"'{w}'" for w in cp.HAZARD_WORDS) + "]"
_SINKS = f"""raised AS (SELECT 'ALT-CITIZEN-' || feedback_id AS alert_id, a.work_id, nodal_district, mp_name, '[Citizen Ground Report] ' || concat_ws(' ',
    CASE WHEN gps_mismatch THEN 'Geotag discrepancy: reported ' || printf('%.3f', distance_km) || ' km from the site.' END,
    CASE WHEN hazard THEN 'Hazard reported: ' || array_to_string(list_filter({_WORDS}, lambda w : contains(lower(feedback_text), w)), ', ') || '.' END) AS reason
  FROM assessed a JOIN works w ON w.unique_work_number = a.work_id WHERE is_high_risk)"""


@query(works_sql("""SELECT 'accepted' AS sink, CAST(feedback_id AS VARCHAR) AS id, work_id, urgency AS detail FROM assessed
UNION ALL SELECT 'rejects', CAST(feedback_id AS VARCHAR), work_id, CASE WHEN work_id = '' THEN 'work_id is required' WHEN length(trim(feedback_text)) < 10 THEN 'feedback_text is too short' ELSE 'work not found' END
  FROM feedback WHERE work_id = '' OR length(trim(feedback_text)) < 10 OR work_id LIKE 'X%'
UNION ALL SELECT 'alerts', alert_id, work_id, reason FROM raised
UNION ALL SELECT 'notifications', 'NTF-' || alert_id || '-DISTRICT', work_id, nodal_district || ': ' || reason FROM raised
UNION ALL SELECT 'notifications', 'NTF-' || alert_id || '-MP', work_id, mp_name || ': ' || reason FROM raised""", tq._COMPLAINTS, tq.FEEDBACK_SQL, _SINKS))
def feedback_sinks_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All feedback, a file per micro-batch, run into four tables; their rows."""
    feed = materialise(tq.feedback(spark, sf).repartition(3, "feedback_id"), "feedback-files")
    works = materialise(dt.works(spark, sf, "unique_work_number", "nodal_district", "mp_name"), "feedback-works")
    root = scratch_path(spark, "feedback-sinks")
    path = feed.inputFiles()[0].rsplit("/", 1)[0]
    feeds.feedback_to_sinks(runner.file_stream(spark, path, 1), works, root, cm.as_of())
    shown = {
        "accepted": ("feedback_id", F.col("urgency")),
        "rejects": ("feedback_id", F.col("reject_reason")),
        "alerts": ("alert_id", F.col("reason")),
        "notifications": ("notification_id", F.concat("scope_id", F.lit(": "), "message")),
    }
    parts = [
        spark.read.parquet(f"{root}/{sink}").select(
            F.lit(sink).alias("sink"), F.col(key).cast("string").alias("id"), "work_id", detail.alias("detail")
        )
        for sink, (key, detail) in shown.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(works_sql("SELECT unique_work_number, CAST(amount AS DOUBLE) AS sanction_amount FROM judged WHERE NOT bad", iq._MESSY))
def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files dropped in a folder, cleaned and merged into a stored table."""
    folder, store = scratch_path(spark, "inbox"), scratch_path(spark, "works")
    messy = iq.messy_works(spark, sf)
    messy.write.option("header", True).option("escape", '"').csv(folder)
    schema = ", ".join(f"`{c}` string" for c in messy.columns)
    feeds.ingest_stream(spark, folder, schema, store, scratch_path(spark, "quarantine"), iq.AS_OF)
    return tb.read_keyed(spark, store).select(
        "unique_work_number", F.col("sanction_amount").cast("double").alias("sanction_amount")
    )
