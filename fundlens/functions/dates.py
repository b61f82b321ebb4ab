"""Dates written in common Indian office formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The day that serial 0 stands for, and the accepted serial range.
SERIAL_EPOCH = "1899-12-30"
SERIAL_MAX = 200_000

# Fixed patterns, one per accepted layout.
_YMD = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
_DMY = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"
_D_MON_Y = r"^(\d{1,2})[/\-.\s]+([A-Za-z]{3,9})[/\-.\s]+(\d{4})$"
_MON_D_Y = r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})$"

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _month_number(name: Column) -> Column:
    at = F.instr(F.lit(_MONTHS), F.substring(F.lower(name), 1, 3))
    return F.when(at % 3 == 1, ((at + 2) / 3).cast("int"))


def _calendar_date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string"))
    complete = month.isNotNull() & (year != "0000")
    return F.when(complete, F.try_to_date(text, "yyyy-M-d"))


def normalize_date(c: Column) -> Column:
    """Date text to a DATE, NULL when no accepted layout fits or the day does not exist.

    Layouts in order: spreadsheet serial, ``Y-M-D``, ``D/M/Y``, ``D Mon Y``, ``Mon D, Y``.
    """
    text = F.trim(c.cast("string"))
    serial = F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    return (
        F.when(
            serial.between(1, SERIAL_MAX),
            F.date_add(F.lit(SERIAL_EPOCH).cast("date"), serial.cast("int")),
        )
        .when(text.rlike(_YMD), _calendar_date(part(_YMD, 1), part(_YMD, 2), part(_YMD, 3)))
        .when(text.rlike(_DMY), _calendar_date(part(_DMY, 3), part(_DMY, 2), part(_DMY, 1)))
        .when(
            text.rlike(_D_MON_Y),
            _calendar_date(part(_D_MON_Y, 3), _month_number(part(_D_MON_Y, 2)), part(_D_MON_Y, 1)),
        )
        .when(
            text.rlike(_MON_D_Y),
            _calendar_date(part(_MON_D_Y, 3), _month_number(part(_MON_D_Y, 1)), part(_MON_D_Y, 2)),
        )
    )
