"""Additive merge into the works table and vendor ids for nameless vendors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.functions.numbers import count_when
from fundlens.operators.pairing import last_by, sequential_number

KEY = "unique_work_number"
_ORIGIN = "_origin"


def upsert(existing: DataFrame, incoming: DataFrame, row_id: Column, key: str = KEY) -> DataFrame:
    """Merge by key, with ``_origin`` = kept, updated or added.

    Rows with a blank key are skipped and of repeated keys the later row wins. An incoming row
    replaces every column it has, with NULL too; columns only the old table has are kept.
    """
    usable = incoming.where(F.coalesce(F.trim(key), F.lit("")) != "")
    latest = last_by(usable.withColumn("_o", row_id), [key], F.col("_o")).drop("_o")
    old = existing.alias("old")
    new = latest.withColumn("_new", F.lit(True)).alias("new")
    joined = old.withColumn("_old", F.lit(True)).alias("old").join(new, key, "full_outer")
    is_new = F.col("_new").isNotNull()
    out = [F.col(key)]
    for c in [*existing.columns, *[c for c in latest.columns if c not in existing.columns]]:
        if c == key:
            continue
        if c in existing.columns and c in latest.columns:
            value = F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        else:
            value = F.col(c)
        out.append(value.alias(c))
    origin = (
        F.when(~is_new, "kept").when(F.col("_old").isNull(), "added").otherwise("updated")
    )
    return joined.select(*out, origin.alias(_ORIGIN))


def upsert_report(merged: DataFrame) -> DataFrame:
    origin = F.col(_ORIGIN)
    return merged.agg(
        count_when(origin == "added").alias("added"),
        count_when(origin == "updated").alias("updated"),
        F.count(F.lit(1)).alias("total_works"),
    )


def assign_vendor_ids(rows: DataFrame, bucket: list[Column], order: Column) -> DataFrame:
    """Fill blank vendor ids: the id known for the name (the last one wins), else V_AUTO_00001...

    New numbers follow the first row of each new name. ``order`` sorts the rows and ``bucket`` is a
    sortable prefix of it with a bounded number of rows per value.
    """
    name = F.lower(F.trim(F.coalesce("vendor_name", F.lit(""))))
    given = F.trim(F.coalesce("vendor_id", F.lit("")))
    tagged = rows.withColumn("_name", name).withColumn("_order", order)
    known = (
        tagged.where(given != "")
        .groupBy("_name")
        .agg(F.max_by(given, F.col("_order")).alias("_known"))
    )
    missing = tagged.where((given == "") & (F.col("_name") != ""))
    wanted = missing.select("_name", "_order", F.struct(*bucket).alias("_b"))
    fresh = (
        wanted.join(known, "_name", "left_anti")
        .groupBy("_name")
        .agg(F.min(F.struct("_order", "_b")).alias("first"))
    )
    numbered = sequential_number(
        fresh, [F.col("first._b")], F.col("first._order"), "_number"
    ).select("_name", F.format_string("V_AUTO_%05d", "_number").alias("_auto"))
    blank = (given == "") & (F.col("_name") != "")
    return (
        tagged.join(known, "_name", "left")
        .join(numbered, "_name", "left")
        .withColumn(
            "vendor_id",
            F.when(blank, F.coalesce("_known", "_auto")).otherwise(F.col("vendor_id")),
        )
        .drop("_name", "_order", "_known", "_auto")
    )
