"""Audit of generated answers against the data they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases by which an answer says that the data is missing.
ASSISTANT_REFUSALS = (
    "not available in the current data", "i don't have", "i do not have", "cannot determine",
    "no data", "not enough information", "insufficient data",
)
RETRIEVAL_REFUSALS = (
    "not available in the current", "i don't have", "cannot determine", "no data",
    "not enough information",
)
# Fixed pattern: a number with optional thousands commas and decimals.
NUMBER = r"[\d,]+(?:\.\d+)?"
RETRIEVAL_LISTED = 5


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text as strings without commas."""
    found = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)),
        lambda n: F.regexp_replace(n, ",", ""),
    )
    return F.array_distinct(F.filter(found, lambda n: n != ""))


def novel_numbers(answer: Column, context: Column, min_digits: int = 2) -> Column:
    """Numbers of the answer that the context lacks and that have enough digits, sorted."""
    new = F.array_except(numbers_in(answer), numbers_in(context))
    return F.array_sort(
        F.filter(new, lambda n: F.length(F.regexp_replace(n, r"\.", "")) >= min_digits)
    )


def is_refusal(answer: Column, phrases: tuple[str, ...] = ASSISTANT_REFUSALS) -> Column:
    lower = F.lower(answer)
    out = F.lit(False)
    for p in phrases:
        out = out | lower.contains(p)
    return out


def audit_answers(answers: DataFrame, retrieval: bool = False) -> DataFrame:
    """Adds ``novel``, ``refused``, ``confidence``, ``confidence_score``, ``used_fallback``.

    Needs ``context`` and ``answer``. With an empty context or answer the result is a fallback of
    low confidence. ``retrieval`` applies the rules of the retrieval assistant: numbers of three
    or more digits, of which five are listed, and its shorter phrase list.
    """
    no_context = F.trim(F.coalesce("context", F.lit(""))) == ""
    no_answer = F.trim(F.coalesce("answer", F.lit(""))) == ""
    fallback = no_context | no_answer
    novel = novel_numbers(F.col("answer"), F.col("context"), 3 if retrieval else 2)
    if retrieval:
        novel = F.slice(novel, 1, RETRIEVAL_LISTED)
    refused = is_refusal(F.coalesce("answer", F.lit("")), RETRIEVAL_REFUSALS if retrieval else ASSISTANT_REFUSALS)
    level = (
        F.when(F.col("used_fallback") | F.col("refused"), "LOW")
        .when(F.size("novel") > 0, "MEDIUM")
        .otherwise("HIGH")
    )
    score = (
        F.when(F.col("confidence") == "LOW", F.lit(0.3))
        .when(F.col("confidence") == "MEDIUM", F.lit(0.7))
        .otherwise(F.lit(0.95))
    )
    warning = (
        F.when(no_context, F.lit("Data context was empty."))
        .when(no_answer, F.lit("Answer was empty."))
        .when(
            F.size("novel") > 0,
            F.concat(
                F.lit("Answer contains number(s) not found in the supplied data: "),
                F.concat_ws(", ", "novel"), F.lit("."),
            ),
        )
    )
    return (
        answers.withColumn("used_fallback", fallback)
        .withColumn("novel", F.when(fallback, F.array().cast("array<string>")).otherwise(novel))
        .withColumn("refused", ~F.col("used_fallback") & refused)
        .withColumn("confidence", level)
        .withColumn("confidence_score", score)
        .withColumn("warning", warning)
    )


def audit_signals(audited: DataFrame, key: str) -> DataFrame:
    """NL_QUERY_WARNING for every answer with a warning."""
    return audited.where(F.col("warning").isNotNull()).select(
        key,
        F.lit("NL_QUERY_WARNING").alias("signal_type"),
        F.when(F.col("confidence") == "MEDIUM", F.lit(0.3)).otherwise(F.lit(0.5)).alias("severity"),
        F.col("warning").alias("reason"),
    )
