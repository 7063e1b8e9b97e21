"""Row expressions. Missing is always NULL; every division is a `try_divide`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_key(key: Column, width: int = 5) -> Column:
    """Zero-pad a key. `lpad` alone would cut longer keys."""
    return F.when(F.length(key) < width, F.lpad(key, width, "0")).otherwise(key)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def log_pos(x: Column) -> Column:
    """Natural log of positive values, NULL otherwise (Spark's `ln` already returns NULL there)."""
    return F.ln(x)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def ratio_over_positive(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.when(b > 0, b))


def above(x: Column, floor: float) -> Column:
    return F.when(x > floor, x)


def sum_or_null(cols: list[Column]) -> Column:
    """Sum with missing parts as 0, NULL only when every part is missing."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(F.coalesce(*cols).isNotNull(), total)


def share_of_parts(parts: list[Column], total: Column) -> Column:
    """Sum of parts (missing parts as 0, also when all are missing) over a total."""
    return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in parts]), total)


def pct_from_log(x: Column) -> Column:
    return (F.exp(x) - 1) * 100


def band_index(pct: Column, bands: int = 20) -> Column:
    return F.least(F.floor(pct * bands), F.lit(bands - 1)).cast("int")


def recency_weight(age_years: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_years / F.lit(half_life))


def half_even(x: Column, digits: int = 2) -> Column:
    return F.bround(nan_to_null(x), digits)
