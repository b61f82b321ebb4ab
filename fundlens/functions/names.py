"""Keys for vendor matching, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: legal forms that say nothing about who a company is.
_LEGAL_FORMS = (
    r"(?i)\b(pvt\.?\s*ltd\.?|private\s+limited|ltd\.?|limited|llp|inc\.?"
    r"|corp(\.|oration)?|co\.?)\b"
)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def registration_key(c: Column, length: int) -> Column:
    """Upper-case registration number without blanks or dashes; NULL unless ``length`` long."""
    key = F.upper(F.regexp_replace(F.trim(c), "[ -]", ""))
    return F.when(F.length(key) == length, key)


def vendor_key(c: Column) -> Column:
    """Upper-case identifier without blanks or dashes, NULL when nothing is left."""
    key = F.upper(F.regexp_replace(F.trim(c), "[ -]", ""))
    return F.when(key != "", key)


def clean_company_name(c: Column) -> Column:
    text = F.regexp_replace(c, _LEGAL_FORMS, "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def comparable_company_name(c: Column) -> Column:
    """The cleaned name, or the plain lower-case name when cleaning leaves nothing."""
    cleaned = clean_company_name(c)
    return F.when(cleaned != "", cleaned).otherwise(F.lower(F.trim(c)))
