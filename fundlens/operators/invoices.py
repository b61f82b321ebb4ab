"""Invoice fields from text, and their comparison with the sanction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.functions.numbers import round_even, to_number

# Fixed patterns: amounts, dates in order of precedence, vendor labels.
AMOUNT = r"(?i)(?:₹|Rs\.?|INR)\s*([\d,]+(?:\.\d{1,2})?)"
UNIT_AMOUNT = r"(?i)([\d,.]+)\s*(lakh|lac|crore|cr)\b"
DATES = (
    r"\b(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4})\b",
    r"(?i)\b(\d{1,2}[/\-\.](?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[/\-\.]\d{4})\b",
    r"\b(\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2})\b",
)
VENDOR = (
    r"(?i)(?:M/s\.?|Vendor\s*:|Contractor\s*:|Supplier\s*:"
    r"|Name\s+of\s+(?:the\s+)?(?:firm|vendor|contractor)\s*:)\s*(.+)"
)
TOLERANCE_PCT = 5.0
# Confidence of a field that was found.
CONFIDENCE = {"amount": 0.9, "date": 0.85, "vendor_name": 0.80}


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def parse_invoice(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``amount`` (the largest found), ``invoice_date``, ``vendor_name`` and ``notes``.

    Rows with blank text are dropped.
    """
    body = F.col(text)
    plain = F.transform(_all(body, AMOUNT, 1), lambda a: to_number(F.regexp_replace(a, ",", "")))
    units = F.zip_with(
        _all(body, UNIT_AMOUNT, 1),
        _all(body, UNIT_AMOUNT, 2),
        lambda a, u: to_number(F.regexp_replace(a, ",", ""))
        * F.when(F.lower(u).isin("lakh", "lac"), 1e5).otherwise(1e7),
    )
    first_dates = [
        F.when(F.regexp_extract(body, p, 1) != "", F.regexp_extract(body, p, 1)) for p in DATES
    ]
    label = F.regexp_extract(body, VENDOR, 1)
    vendor = F.trim(F.regexp_replace(F.trim(label), r"[.,;:]+$", ""))
    return (
        df.where(F.trim(body) != "")
        .withColumn("_amounts", F.array_compact(F.concat(plain, units)))
        .withColumn("amount", F.array_max("_amounts"))
        .withColumn("invoice_date", F.coalesce(*first_dates))
        .withColumn("vendor_name", F.when(F.length(vendor) > 2, vendor))
        .withColumn(
            "notes",
            F.array_compact(
                F.array(
                    F.when(F.size("_amounts") > 1, "Several amounts found; the largest is used."),
                    F.when(F.col("amount").isNull(), "No amount found."),
                    F.when(F.col("invoice_date").isNull(), "No date found."),
                    F.when(F.col("vendor_name").isNull(), "No vendor name found."),
                )
            ),
        )
        .drop("_amounts")
    )


def field_confidences(parsed: DataFrame, key: str) -> DataFrame:
    def conf(c: str, name: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.lit(CONFIDENCE[name])).otherwise(F.lit(0.0))

    return parsed.select(
        key,
        conf("amount", "amount").alias("amount_confidence"),
        conf("invoice_date", "date").alias("date_confidence"),
        conf("vendor_name", "vendor_name").alias("vendor_confidence"),
    )


def diff_against_sanction(parsed: DataFrame, key: str) -> DataFrame:
    """One row per field with a sanctioned value: (key, field_name, discrepancy, reason).

    Amount discrepancies are in percent; dates and vendors are 0 or 1; NULL means that the field
    was not found or cannot be compared. Needs ``sanctioned_amount``, ``sanctioned_date`` and
    ``sanctioned_vendor``, any of which may be NULL.
    """
    billed = F.col("amount")
    agreed = F.col("sanctioned_amount").cast("double")
    off = F.when(agreed != 0, (billed - agreed) / agreed * 100)

    def field(name: str, discrepancy: Column, reason: Column, extracted: Column, wanted: Column):
        return F.when(
            wanted.isNotNull(),
            F.struct(
                F.lit(name).alias("field_name"),
                extracted.cast("string").alias("extracted_value"),
                wanted.cast("string").alias("sanctioned_value"),
                discrepancy.alias("discrepancy"),
                reason.alias("reason"),
            ),
        )

    def same(name: str, label: str, found: Column, wanted: Column, equal: Column) -> Column:
        value = F.when(found.isNotNull(), F.when(equal, F.lit(0.0)).otherwise(F.lit(1.0)))
        reason = (
            F.when(found.isNull(), f"{label} could not be extracted from the document.")
            .when(equal, f"{label} matches.")
            .otherwise(
                F.concat(
                    F.lit(f"{label} '"), found, F.lit("' differs from sanctioned '"), wanted, F.lit("'.")
                )
            )
        )
        return field(name, value, reason, found, wanted)

    amount_reason = (
        F.when(billed.isNull(), "Amount could not be extracted from the document.")
        .when(
            F.abs(off) > TOLERANCE_PCT,
            F.format_string("Amount %,.2f differs from sanctioned %,.2f by %+.1f%%.", billed, agreed, off),
        )
        .otherwise("Amount is within tolerance.")
    )
    date, want_date = F.col("invoice_date"), F.col("sanctioned_date")
    vendor, want_vendor = F.col("vendor_name"), F.col("sanctioned_vendor")
    fields = F.array_compact(
        F.array(
            field("amount", round_even(off, 2), amount_reason, billed, F.col("sanctioned_amount")),
            same("date", "Date", date, want_date, F.trim(date) == F.trim(want_date)),
            same(
                "vendor_name", "Vendor", vendor, want_vendor,
                F.lower(F.trim(vendor)) == F.lower(F.trim(want_vendor)),
            ),
        )
    )
    return parsed.select(key, F.explode(fields).alias("f")).select(key, "f.*")


def invoice_signals(diffs: DataFrame, key: str) -> DataFrame:
    off = F.col("discrepancy")
    kind = (
        F.when(off.isNull(), "OCR_FIELD_MISSING")
        .when((F.col("field_name") == "amount") & (F.abs(off) > TOLERANCE_PCT), "AMOUNT_MISMATCH")
        .when(
            (F.col("field_name") != "amount") & (off == 1.0),
            F.concat(F.upper("field_name"), F.lit("_MISMATCH")),
        )
    )
    severity = (
        F.when(off.isNull(), F.lit(0.3))
        .when(F.col("field_name") == "amount", round_even(F.least(F.lit(1.0), F.abs(off) / 100), 3))
        .otherwise(F.lit(0.5))
    )
    return (
        diffs.withColumn("signal_type", kind)
        .where(F.col("signal_type").isNotNull())
        .select(key, "signal_type", severity.alias("severity"), "reason")
    )
