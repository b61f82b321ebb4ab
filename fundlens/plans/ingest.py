"""Untidy file to clean tables: read, harmonise, normalise, validate, merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.operators import benchmarks as bm
from fundlens.operators import harmonise as hz
from fundlens.operators import store as st
from fundlens.operators import validation as va
from fundlens.operators.pairing import sequential_number
from fundlens.session import materialise
from fundlens.sources.readers import ROW_ID, read_raw
from fundlens.sources.tables import KEY_BUCKET, key_bucket, read_keyed, write_buckets, write_quarantine

_ROW_BITS = 20


@dataclass(frozen=True)
class Ingested:
    """What one run produced; all frames read stored tables."""

    checked: DataFrame
    valid: DataFrame
    rejects: DataFrame
    benchmarks: DataFrame
    report: DataFrame


def row_order():
    """(bucket columns, order column) of rows read with a row id."""
    r = F.col(ROW_ID)
    return [r["file"], r["block"], F.shiftright(r["pos"], _ROW_BITS)], r


def ingest_frame(
    raw: DataFrame, task_id: str, as_of: str, references: DataFrame | None = None
) -> Ingested:
    """Clean a raw frame that carries a row id. The checked rows are stored once and feed the
    valid rows, the rejects, the benchmarks and the report."""
    rows = hz.normalise_rows(hz.harmonise_columns(raw), references)
    staged = materialise(va.validate_rows(rows, as_of, keep=(ROW_ID,)), f"staged-{task_id}")
    bucket, order = row_order()
    indexed = sequential_number(staged.select(ROW_ID), bucket, order, "_n")
    valid = st.assign_vendor_ids(va.valid_rows(staged), bucket, order)
    rejects = va.quarantined_rows(
        staged.join(indexed.select(ROW_ID, "_n"), ROW_ID), task_id, as_of, F.col("_n") - 1
    )
    benchmarks = bm.category_benchmarks(va.valid_rows(staged), order)
    stats = va.batch_stats(staged)
    status = F.when(
        (F.col("warning_count") > 0) | (F.col("quarantined_count") > 0), "completed_with_warnings"
    ).otherwise("completed")
    report = stats.select(F.lit(task_id).alias("task_id"), "*", status.alias("status"))
    return Ingested(staged, valid, rejects, benchmarks, report)


def merge_works(spark: SparkSession, store: str, valid: DataFrame) -> DataFrame:
    """Merge valid rows into the stored works; one row of counts is returned.

    The works lie in buckets of their number. Only buckets with an incoming row are read, merged and
    written again, so a run's work follows the batch; one that is run again changes nothing more.
    """
    _, order = row_order()
    incoming = materialise(valid.drop("warnings").withColumn(KEY_BUCKET, key_bucket(st.KEY)), "incoming-works")
    existing = read_keyed(spark, store)
    if existing is None:
        untouched = 0
        existing = spark.createDataFrame([], incoming.drop(ROW_ID).schema)
    else:
        touched = [r[0] for r in incoming.select(KEY_BUCKET).distinct().collect()]  # KEY_BUCKETS at most
        untouched = existing.where(~F.col(KEY_BUCKET).isin(touched)).count()  # from the files' footers
        existing = existing.where(F.col(KEY_BUCKET).isin(touched))
    merged = materialise(st.upsert(existing, incoming, order).drop(ROW_ID), "merged-works")
    write_buckets(merged.drop("_origin"), store)
    return st.upsert_report(merged).withColumn("total_works", F.col("total_works") + untouched)


def ingest_file(
    spark: SparkSession,
    path: str,
    store: str,
    quarantine: str,
    task_id: str,
    as_of: str,
    mp_master: DataFrame | None = None,
    fmt: str = "auto",
    multi_line: bool = False,
) -> DataFrame:
    """Run the whole chain on a file or folder; returns the run report as one row.

    The input is parsed once, into a stored table that all steps read.
    """
    raw = materialise(read_raw(spark, path, fmt, multi_line, with_row_id=True), "raw")
    references = None if mp_master is None else materialise(hz.reference_lists(mp_master), "references")
    done = ingest_frame(raw, task_id, as_of, references)
    write_quarantine(done.rejects, quarantine)
    merged = merge_works(spark, store, done.valid)
    # Two one-row frames.
    return done.report.crossJoin(F.broadcast(merged))
