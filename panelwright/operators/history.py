"""Origins and calendar lookups on long series (entity, midx, value), one row per entity and month.

Lookups are windows per entity. An entity has at most one row per month, so such a partition is bounded by
the length of the calendar, and all lookups of a series share one shuffle and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.calendar import month_last_day, month_year


def origins(series: DataFrame, min_year: int = 2000) -> DataFrame:
    """Yearly origins: months with the calendar month of the latest one, from `min_year` on."""
    months = series.select("midx").distinct()
    last = series.agg(F.max("midx")).scalar()
    return months.where(
        (F.pmod("midx", F.lit(12)) == F.pmod(last, F.lit(12))) & (month_year(F.col("midx")) >= min_year)
    ).select("midx", month_last_day(F.col("midx")).alias("origin"), month_year(F.col("midx")).alias("origin_year"))


def at_offset(value: Column | str, months: int) -> Column:
    """The entity's value exactly `months` away; NULL when that month is absent."""
    by_month = W.partitionBy("entity").orderBy("midx")
    return F.max(value).over(by_month.rangeBetween(months, months))


def log_change(value: Column | str, years: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.ln(value) - F.ln(at_offset(value, -12 * years))


def forward_log_change(value: Column | str, years: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.ln(at_offset(value, 12 * years)) - F.ln(value)


def difference(value: Column | str, years: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value - at_offset(value, -12 * years)


def value_history(
    series: DataFrame, lags: tuple[int, ...], horizons: tuple[int, ...], growth_years: int = 0
) -> DataFrame:
    """Log level, trailing and forward changes, and the single-year changes the group slope needs."""
    past = lambda k: at_offset("value", -12 * k)
    return series.select(
        "entity",
        "midx",
        "value",
        F.ln("value").alias("log_value"),
        *[log_change("value", k).alias(f"mom_{k}y") for k in lags],
        *[forward_log_change("value", h).alias(f"fwd_{h}y") for h in horizons],
        *[(F.ln(past(k)) - F.ln(past(k + 1))).alias(f"_growth_{k}") for k in range(growth_years)],
    )


def panel_base(history: DataFrame, origin_months: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per entity and origin where the value and the group are known."""
    return (
        history.where(F.col("log_value").isNotNull())
        .join(origin_months, "midx")
        .join(meta.where(F.col("grp").isNotNull()), "entity")
    )
