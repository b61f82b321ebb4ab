"""Amounts written the Indian way, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fundlens.functions.numbers import to_number

# Unit words and what they multiply by.
UNIT_MULTIPLIERS = {
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "c": 1e7,
    "lakh": 1e5, "lakhs": 1e5, "l": 1e5,
    "thousand": 1e3, "k": 1e3,
}

# Fixed patterns of the accepted spellings.
_PREFIX = r"(?i)^[\s₹]*(?:Rs\.?|INR|rupees?)?[\s.:₹]*"
_TRAILING_DASH = r"/-?\s*$"
_TRAILING_NOISE = r"[\s/\-]*$"
_UNIT = r"(?i)\s*(crores?|cr|lakhs?|l|thousand|k|c)\s*$"


def normalize_currency(c: Column) -> Column:
    """Currency text to a double in rupees, NULL when it cannot be read.

    ``₹ 25.5 Lakhs`` is 2550000, ``Rs. 25,00,000/-`` is 2500000, ``1.4 Cr`` is 14000000.
    """
    text = F.trim(c.cast("string"))
    for noise in (_PREFIX, _TRAILING_DASH, _TRAILING_NOISE, "₹"):
        text = F.regexp_replace(text, noise, "")
    text = F.trim(text)
    unit = F.lower(F.regexp_extract(text, _UNIT, 1))
    factor = F.lit(1.0)
    for word, value in UNIT_MULTIPLIERS.items():
        factor = F.when(unit == word, F.lit(value)).otherwise(factor)
    digits = F.regexp_replace(F.regexp_replace(text, _UNIT, ""), ",", "")
    return to_number(digits) * factor
