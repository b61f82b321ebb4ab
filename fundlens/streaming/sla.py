"""Deadline monitor: a warning a day before an open alert is due, escalation when it is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DONE = "ESCALATED"
DAY_MS = 24 * 3600 * 1000
BUCKETS = 1024  # of works; fixed while a stream's state lives
OUTPUT = "work_id string, alert_id string, type string, due_ms bigint"
STATE = "works binary"
COLUMNS = ["work_id", "alert_id", "status", "due_ms", "warned"]


def _pack(works: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(works[COLUMNS], preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(works: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(works).read_all().to_pandas()


def _taken_in(held: pd.DataFrame | None, rows: pd.DataFrame) -> pd.DataFrame:
    """Watched works after new rows: the newest of a work counts, closed ones are forgotten."""
    newest = rows.sort_values("event_at", kind="stable").drop_duplicates("work_id", keep="last").assign(warned=False)[COLUMNS]
    if held is None:
        return newest[newest["status"] == "OPEN"]
    newest["warned"] = newest["work_id"].isin(held.loc[held["warned"], "work_id"])
    is_open = newest["status"] == "OPEN"
    # An escalated work whose alert is still open stays as it is.
    still = newest.loc[is_open, "work_id"]
    stays = ~held["work_id"].isin(newest["work_id"]) | ((held["status"] == DONE) & held["work_id"].isin(still))
    held = held[stays]
    return pd.concat([held, newest[is_open & ~newest["work_id"].isin(held["work_id"])]], ignore_index=True)


def sla_monitor(alerts: DataFrame, event_time: str, lateness: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """One SLA_WARNING and one ESCALATED row per work, as event time passes.

    ``alerts`` is a stream of alert states (work_id, alert_id, status, sla_deadline, event time);
    the latest state of a work counts. A work is due a day before its deadline and at its deadline;
    an escalated one is remembered until its alert closes, so that later rows of the open alert
    don't warn again. A work that is no longer open is forgotten. Works are watched by the bucket:
    the state of a bucket is the table of its works, and its event-time timer the next due one.
    """
    rows = alerts.select(
        F.pmod(F.xxhash64("work_id"), F.lit(buckets)).alias("bucket"), "work_id", "alert_id", "status",
        F.unix_millis(F.col("sla_deadline").cast("timestamp")).alias("due_ms"),
        F.col(event_time).cast("timestamp").alias("event_at"),
    ).withWatermark("event_at", lateness)

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        works = _unpack(state.get[0]) if state.exists else None
        if not state.hasTimedOut:
            works = _taken_in(works, pd.concat(list(batches), ignore_index=True))
        if not len(works):
            if state.exists:
                state.remove()
            return
        works = works.astype({"due_ms": "int64", "warned": "bool"})
        now = state.getCurrentWatermarkMs()
        pending = works["status"] == "OPEN"
        warn = pending & ~works["warned"] & (works["due_ms"] - DAY_MS <= now)
        escalate = pending & (works["due_ms"] <= now)
        out = [
            works.loc[which, ["work_id", "alert_id", "due_ms"]].assign(type=kind)
            for which, kind in ((warn, "SLA_WARNING"), (escalate, DONE)) if which.any()
        ]
        works["warned"] |= warn
        works.loc[escalate, "status"] = DONE
        state.update((_pack(works),))
        left = works[works["status"] == "OPEN"]
        if len(left):
            # A timer goes off when the watermark has passed it.
            due = left["due_ms"] - (~left["warned"]).astype("int64") * DAY_MS
            state.setTimeoutTimestamp(max(now + 1, int(due.min()) - 1))
        if out:
            yield pd.concat(out)[["work_id", "alert_id", "type", "due_ms"]]

    return rows.groupBy("bucket").applyInPandasWithState(
        watch, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def warnings_once(warnings: DataFrame, event_time: str, lateness: str = "1 day") -> DataFrame:
    """At most one warning per work and type within the watermark."""
    timed = warnings.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["work_id", "type"])


def alert_counters(alerts: DataFrame, event_time: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Alerts per time window and severity; rows later than ``lateness`` are not counted."""
    timed = alerts.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, lateness)
    return (
        timed.groupBy(F.window(event_time, width), "severity")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "severity", "alerts")
    )
