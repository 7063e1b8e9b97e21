"""Month arithmetic. A month is the integer year * 12 + month - 1, so a year is always 12 steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def month_year(midx: Column) -> Column:
    return F.floor(midx / F.lit(12)).cast("int")


def month_last_day(midx: Column) -> Column:
    return F.last_day(F.make_date(month_year(midx), F.pmod(midx, F.lit(12)) + 1, F.lit(1)))


def shift_month_end(date: Column, years: int) -> Column:
    """The same calendar month `years` later (negative: earlier), rolled to its last day."""
    return F.last_day(F.add_months(date, 12 * years))
