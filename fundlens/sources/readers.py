"""Readers for untidy tabular files; every value stays text until it is normalised."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.functions.numbers import MONEY, number_prefix_or_zero

_FORMATS = {".csv": "csv", ".tsv": "tsv", ".txt": "tsv", ".json": "json", ".jsonl": "jsonl"}
ROW_ID = "_row_id"


def file_format(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in _FORMATS:
        raise ValueError(f"cannot tell the format of {path!r}; pass fmt explicitly")
    return _FORMATS[suffix]


def read_raw(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "auto",
    multi_line: bool = False,
    with_row_id: bool = False,
) -> DataFrame:
    """Read CSV, TSV, a JSON array or JSON lines as all-text columns.

    Big files are split over tasks; ``multi_line`` allows quoted line breaks, at the price of one
    task per file. ``with_row_id`` adds a sortable
    position (file, split, place in the task) for rules such as "the later row wins".
    """
    first = path if isinstance(path, str) else path[0]
    kind = file_format(first) if fmt == "auto" else fmt
    reader = spark.read
    if kind in ("csv", "tsv"):
        reader = (
            reader.option("header", True)
            .option("inferSchema", False)
            .option("sep", "\t" if kind == "tsv" else ",")
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multi_line)
            .option("encoding", "UTF-8")
        )
        df = reader.csv(path)
    elif kind in ("json", "jsonl"):
        reader = reader.option("primitivesAsString", True).option("mode", "PERMISSIVE")
        df = reader.option("multiLine", kind == "json").json(path)
        df = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    else:
        raise ValueError(f"unsupported format {kind!r}; use csv, tsv, json or jsonl")
    if with_row_id:
        df = df.withColumn(
            ROW_ID,
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("pos"),
            ),
        )
    return df


def typed_works(raw: DataFrame) -> DataFrame:
    """Text work rows to typed ones: numeric prefixes, 0 for the rest, flag from ``'1'``."""
    numbers = (
        "sanction_amount", "physical_progress_pct", "financial_progress_pct",
        "category_benchmark_min", "category_benchmark_max",
    )
    out = raw.withColumns({c: number_prefix_or_zero(F.col(c)) for c in numbers if c in raw.columns})
    if "sanction_amount" in raw.columns:
        out = out.withColumn("sanction_amount", F.col("sanction_amount").cast(MONEY))
    if "is_anomaly" in raw.columns:
        out = out.withColumn("is_anomaly", F.coalesce(F.col("is_anomaly") == "1", F.lit(False)))
    return out
