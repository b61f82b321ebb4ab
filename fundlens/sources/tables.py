"""Sinks and read-back: versioned tables, quarantine, case bundles, the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def table_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table; a write that did not finish has no success marker."""
    fs, hpath = _hadoop_path(spark, path)
    if not fs.exists(hpath):
        return []
    found = []
    for status in fs.listStatus(hpath):
        name = status.getPath().getName()
        if name.startswith("version="):
            marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
                status.getPath(), "_SUCCESS"
            )
            if fs.exists(marker):
                found.append(int(name.split("=")[1]))
    return sorted(found)


def write_version(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write ``df`` as the next version; readers of the old version are not disturbed."""
    done = table_versions(df.sparkSession, path)
    version = done[-1] + 1 if done else 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/version={version}")
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    done = table_versions(spark, path)
    if not done:
        raise FileNotFoundError(f"no complete version under {path}")
    return spark.read.parquet(f"{path}/version={version or done[-1]}")


KEY_BUCKET = "key_bucket"
KEY_BUCKETS = 64  # of a keyed table; fixed when it is first written


def key_bucket(key: str, buckets: int = KEY_BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """A table kept in buckets of its key, with the column ``KEY_BUCKET``; None before its first write."""
    fs, hpath = _hadoop_path(spark, path)
    if not fs.exists(hpath):
        return None
    # Buckets written before a column came up lack it.
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_buckets(df: DataFrame, path: str) -> None:
    """Replace the buckets that occur in ``df`` (with ``KEY_BUCKET``) and leave all others alone."""
    (
        df.repartition(KEY_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(KEY_BUCKET).parquet(path)
    )


def build_or_reuse(
    spark: SparkSession, path: str, build, force_rebuild: bool = False
) -> DataFrame:
    """The stored table, or the result of ``build()`` stored first."""
    if force_rebuild or not table_versions(spark, path):
        write_version(build(), path)
    return read_version(spark, path)


def write_quarantine(rejects: DataFrame, path: str) -> None:
    """Rejected rows as JSON lines, one folder per task; a task that runs again replaces its own."""
    rejects.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").json(path)


def read_quarantine(spark: SparkSession, path: str, task_id: str) -> DataFrame:
    """One task's rejects; only its folder is read."""
    schema = (
        "row_index bigint, original_row string, errors array<string>, reason string, "
        "recorded_at string, task_id string"
    )
    return spark.read.schema(schema).json(path).where(F.col("task_id") == task_id)


def case_bundle_lines(alerts: DataFrame, works: DataFrame, audit_log: DataFrame) -> DataFrame:
    """Case files of all escalated alerts as typed JSON lines.

    A file is the lines of one ``bundle_id`` in order of ``part`` and ``seq``: the alert, its
    work, then its audit trail. Lines instead of one nested document keep an alert with a huge
    trail out of a single row.
    """
    cases = alerts.where(F.col("status") == "ESCALATED").withColumn(
        "bundle_id", F.concat(F.lit("CASE-BUNDLE-"), "alert_id")
    )
    key = cases.select("bundle_id", "alert_id", "work_id")
    head = cases.select(
        "bundle_id",
        F.lit("1-alert").alias("part"),
        F.lit("").alias("seq"),
        F.to_json(F.struct(*[c for c in alerts.columns])).alias("body"),
    )
    work = key.join(works, key.work_id == works.unique_work_number).select(
        "bundle_id",
        F.lit("2-work").alias("part"),
        F.lit("").alias("seq"),
        F.to_json(F.struct(*[works[c] for c in works.columns])).alias("body"),
    )
    trail = key.drop("work_id").join(audit_log, "alert_id").select(
        "bundle_id",
        F.lit("3-audit").alias("part"),
        F.col("log_id").cast("string").alias("seq"),
        F.to_json(F.struct("alert_id", *[c for c in audit_log.columns if c != "alert_id"])).alias(
            "body"
        ),
    )
    return head.unionByName(work).unionByName(trail)
