"""Feedback and file feeds: streams that end in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.operators.alerts import feedback_alerts, feedback_notifications
from fundlens.operators.complaints import assess_feedback, split_feedback
from fundlens.plans.ingest import ingest_frame, merge_works
from fundlens.sources.tables import write_quarantine
from fundlens.streaming.runner import for_each_batch


def assessed_stream(feedback: DataFrame, works: DataFrame) -> DataFrame:
    """Streamed feedback joined to the works table and judged row by row."""
    return assess_feedback(split_feedback(feedback, works)[0])


FEEDBACK_SINKS = ("accepted", "rejects", "alerts", "notifications")


def feedback_to_sinks(
    feedback: DataFrame, works: DataFrame, root: str, created_at: Column, state: str | None = None
) -> None:
    """Run a feedback stream to its ends: a table each of the ``FEEDBACK_SINKS`` under ``root``.

    A micro-batch owns one folder per sink, named by its number, and replaces it, so that a batch
    that is replayed after a failure changes none of them. Alerts and notifications come from the
    accepted rows as they were written. ``created_at`` must not depend on the clock: a column of the
    feed or a constant. Feedback that comes in again in a later batch is a row of its own.
    """
    spark = feedback.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        def put(frame: DataFrame, sink: str) -> DataFrame:
            path = f"{root}/{sink}/batch={number}"
            frame.write.mode("overwrite").parquet(path)
            return spark.read.schema(frame.schema).parquet(path)

        accepted, rejected = split_feedback(rows, works)
        put(rejected, "rejects")
        assessed = put(assess_feedback(accepted), "accepted")
        alerts = put(feedback_alerts(assessed, created_at), "alerts")
        put(feedback_notifications(alerts, works), "notifications")

    for_each_batch(feedback, "feedback-sinks", batch, state)


def ingest_stream(
    spark: SparkSession,
    folder: str,
    schema: str,
    store: str,
    quarantine: str,
    as_of: str,
    references: DataFrame | None = None,
    state: str | None = None,
    on_report=None,
) -> None:
    """Ingest all CSV files that are new in ``folder``, a micro-batch at a time.

    Every batch runs the whole cleaning chain and merges into the store as a new version. A batch
    that is replayed after a failure merges the same rows again and replaces its own rejects, which
    changes nothing.
    """
    files = (
        spark.readStream.schema(schema).option("header", True).option("escape", '"').csv(folder)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    )

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        position = F.struct(
            F.col("_file").alias("file"), F.col("_block").alias("block"), F.monotonically_increasing_id().alias("pos")
        )
        done = ingest_frame(rows.withColumn("_row_id", position).drop("_file", "_block"), f"batch-{number}", as_of, references)
        write_quarantine(done.rejects, quarantine)
        merged = merge_works(spark, store, done.valid)
        if on_report is not None:
            on_report(done.report.crossJoin(F.broadcast(merged)))  # two one-row frames

    for_each_batch(files, "ingest", batch, state)
