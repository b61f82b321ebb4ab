"""Numeric column helpers: strict parsing, the two rounding rules, unit conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
CRORE = 1e7
LAKH = 1e5

_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NUMBER_PREFIX = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain decimal number is NULL.

    The pattern guard keeps Java-only spellings such as ``1d`` or ``0x1p3`` out.
    """
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(_PLAIN_NUMBER), text.try_cast("double"))


def number_prefix_or_zero(c: Column) -> Column:
    """The longest numeric prefix of a text as double, 0 when there is none."""
    head = F.regexp_extract(c.cast("string"), _NUMBER_PREFIX, 1)
    return F.coalesce(F.when(head != "", head.try_cast("double")), F.lit(0.0))


def round_even(c: Column, digits: int = 0) -> Column:
    """Round half to even on the scaled double."""
    if digits == 0:
        return F.rint(c)
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def round_up(c: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    if digits == 0:
        return F.floor(c + F.lit(0.5)).cast("double")
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def as_crore(total: Column) -> Column:
    return round_even(total.cast("double") / F.lit(CRORE), 2)


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` in percent, 0 when the whole is 0."""
    ratio = part.cast("double") / whole.cast("double") * F.lit(100.0)
    return F.when(whole == 0, F.lit(0.0)).otherwise(round_even(ratio, digits))


def spent_amount(amount: Column, financial_pct: Column) -> Column:
    """Amount spent so far, rounded half up to whole units."""
    return round_up(amount.cast("double") * (financial_pct / F.lit(100.0))).cast("bigint")


def count_when(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def sum_money(c: Column) -> Column:
    """Order-independent sum of money amounts."""
    return F.sum(c.cast(MONEY))
