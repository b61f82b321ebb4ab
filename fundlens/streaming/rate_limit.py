"""Sliding-log rate limit: at most ``limit`` accepted events per key and window.

An event is accepted when fewer than ``limit`` accepted events of its key are younger than the
window; rejected events leave no trace. So each decision depends on earlier ones of the same key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT = 10
WINDOW_SECONDS = 600


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rate_limit(
    events: DataFrame, key: str, ts: str, event_id: str, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """(key, event_id, ts, accepted) for a table of events, ordered by time and id.

    After a pause of a whole window a key starts afresh. Pauses are found on counts per window-long
    slot, and the stretches between them are decided independently, so a busy key is spread over
    tasks. Within a task rows stream by in order; only the last ``limit`` accepted times are held.
    """
    width = window_seconds * 1_000_000
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.col(event_id).cast("bigint").alias("event_id"),
        F.col(ts).cast("timestamp_ntz").alias("ts"), _micros(ts).alias("at"),
    ).withColumn("slot", F.floor(F.col("at") / width).cast("bigint"))
    by_key = W.partitionBy("key").orderBy("slot")
    # An empty slot in between is longer than the window.
    starts = F.when(F.col("slot") - F.lag("slot").over(by_key) <= 1, 0).otherwise(1)
    stretches = (
        rows.select("key", "slot").distinct().withColumn("new", starts)
        .withColumn("stretch", F.sum("new").over(by_key)).select("key", "slot", "stretch")
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for batch in batches:
            verdicts = []
            for k, stretch, at in zip(batch["key"], batch["stretch"], batch["at"]):
                if (k, stretch) != current:
                    current, accepted = (k, stretch), deque()
                while accepted and at - accepted[0] >= width:
                    accepted.popleft()
                ok = len(accepted) < limit
                if ok:
                    accepted.append(at)
                verdicts.append(ok)
            yield batch[["key", "event_id", "ts"]].assign(accepted=verdicts)

    ordered = (
        rows.join(stretches, ["key", "slot"])
        .select("key", "stretch", "event_id", "ts", "at")
        .repartition("key", "stretch")
        .sortWithinPartitions("key", "stretch", "at", "event_id")
    )
    return ordered.mapInPandas(decide, "key string, event_id bigint, ts timestamp_ntz, accepted boolean")


def rate_limit_stream(
    events: DataFrame,
    key: str,
    ts: str,
    event_id: str,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    lateness: str = "10 minutes",
) -> DataFrame:
    """The same decision on a stream; the state of a key is its accepted times in the window.

    Events later than ``lateness`` are dropped, and a key is forgotten once event time has passed
    its last event by two windows.
    """
    width = window_seconds * 1_000_000
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.col(event_id).cast("bigint").alias("event_id"), _micros(ts).alias("at"),
        F.col(ts).cast("timestamp").alias("event_at"),
    ).withWatermark("event_at", lateness)

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = deque(state.get[0]) if state.exists else deque()
        # One key's part of one micro-batch.
        batch = pd.concat(list(batches)).sort_values(["at", "event_id"])
        verdicts = []
        for at in batch["at"]:
            while accepted and at - accepted[0] >= width:
                accepted.popleft()
            ok = len(accepted) < limit
            if ok:
                accepted.append(at)
            verdicts.append(ok)
        state.update((list(accepted),))
        idle = int(batch["at"].iloc[-1]) // 1000 + 2 * window_seconds * 1000
        state.setTimeoutTimestamp(max(idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "event_id": batch["event_id"], "accepted": verdicts})

    return rows.groupBy("key").applyInPandasWithState(
        decide, "key string, event_id bigint, accepted boolean", "accepted_at array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
