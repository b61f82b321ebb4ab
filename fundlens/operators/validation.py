"""Row validation, quality warnings and the valid / quarantined split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens import schemas
from fundlens.functions.numbers import MONEY, count_when, pct, to_number

LARGE_AMOUNT = 5e8


def row_errors(columns: list[str]) -> Column:
    """Array of error messages, empty for a valid row."""

    def text(c: str) -> Column:
        return F.trim(F.col(c).cast("string")) if c in columns else F.lit(None).cast("string")

    def number(c: str) -> Column:
        return to_number(F.col(c)) if c in columns else F.lit(None).cast("double")

    checks = [
        F.when(F.coalesce(text(c), F.lit("")) == "", f"{c}: a value is required")
        for c in schemas.REQUIRED_TEXT
    ]
    amount = number("sanction_amount")
    checks.append(
        F.when(amount.isNull(), "sanction_amount: a number is required").when(
            amount <= 0, "sanction_amount: must be greater than 0"
        )
    )
    for c in schemas.PERCENT_COLUMNS:
        checks.append(F.when(~number(c).between(0, 100), f"{c}: must lie between 0 and 100"))
    return F.array_compact(F.array(*checks))


def quality_warnings(as_of: str) -> Column:
    """Array of non-fatal remarks about a typed work row; ``as_of`` is an ISO date."""
    approved = F.try_to_date(F.col("date_of_administrative_approval").cast("string"), "yyyy-MM-dd")
    return F.array_compact(
        F.array(
            F.when(F.col("sanction_amount") > LARGE_AMOUNT, "LARGE_AMOUNT"),
            F.when(approved > F.lit(as_of).cast("date"), "FUTURE_APPROVAL"),
            F.when(
                (F.col("physical_progress_pct") <= 5) & (F.col("financial_progress_pct") >= 50),
                "POSSIBLE_GHOST_WORK",
            ),
        )
    )


def typed_record(df: DataFrame) -> list[Column]:
    """The columns of the strict record; missing ones are NULL, unknown ones are dropped."""

    def present(c: str) -> Column:
        return F.col(c) if c in df.columns else F.lit(None).cast("string")

    out = [F.trim(present(c)).alias(c) for c in schemas.REQUIRED_TEXT]
    out.append(to_number(present("sanction_amount")).cast(MONEY).alias("sanction_amount"))
    out += [present(c).cast("string").alias(c) for c in schemas.OPTIONAL_TEXT]
    out += [to_number(present(c)).alias(c) for c in schemas.OPTIONAL_NUMBERS]
    return out


def validate_rows(df: DataFrame, as_of: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed record plus ``errors``, ``warnings`` and ``original_row``; ``keep`` is carried over."""
    raw = [c for c in df.columns if c not in keep]
    checked = df.select(
        *keep,
        *typed_record(df),
        row_errors(df.columns).alias("errors"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw])).alias("original_row"),
    )
    return checked.withColumn(
        "warnings",
        F.when(F.size("errors") == 0, quality_warnings(as_of)).otherwise(
            F.array().cast("array<string>")
        ),
    )


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors", "original_row")


def quarantined_rows(checked: DataFrame, task_id: str, recorded_at: str, row_index: Column):
    return checked.where(F.size("errors") > 0).select(
        row_index.cast("bigint").alias("row_index"),
        "original_row",
        "errors",
        F.lit("validation failure").alias("reason"),
        F.lit(recorded_at).alias("recorded_at"),
        F.lit(task_id).alias("task_id"),
    )


def batch_stats(checked: DataFrame) -> DataFrame:
    """One row of counts and rates over a validated batch."""
    bad = F.size("errors") > 0
    stats = checked.agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_when(~bad).alias("valid_count"),
        count_when(bad).alias("quarantined_count"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("bigint").alias("warning_count"),
    )
    total = F.col("total_rows")
    return stats.withColumns(
        {
            "valid_rate_pct": pct(F.col("valid_count"), total),
            "quarantine_rate_pct": pct(F.col("quarantined_count"), total),
        }
    )
