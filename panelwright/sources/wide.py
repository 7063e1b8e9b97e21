"""Wide files (one row per entity, one column per month) to long series and back-ends for optional files."""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.calendar import month_index
from panelwright.functions.scalar import nan_to_null, pad_key

log = logging.getLogger(__name__)

# Header names of the wide files (fixed values).
KEY_COLUMN = "RegionName"
META_COLUMNS = {"State": "state", "City": "city", "Metro": "grp", "CountyName": "sub"}
BASE_DATE_COLUMN = "BaseDate"

SERIES_SCHEMA = "entity string, midx int, value double"


def month_columns(columns: list[str]) -> list[str]:
    """Columns named like a date of the 20th or 21st century; new months simply appear as new columns."""
    return [c for c in columns if c[:2] in ("19", "20") and c[4:5] == "-"]


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every column as text (keys keep leading zeros); numbers are cast when unpivoted."""
    return spark.read.csv(path, header=True)


def wide_meta(wide: DataFrame, key: str = KEY_COLUMN, names: dict[str, str] | None = None) -> DataFrame:
    names = META_COLUMNS if names is None else names
    return wide.select(
        pad_key(F.col(key).cast("string")).alias("entity"), *[F.col(c).alias(n) for c, n in names.items()]
    )


def wide_series(wide: DataFrame, key: str = KEY_COLUMN) -> DataFrame:
    """(entity, midx, value), known values only."""
    months = month_columns(wide.columns)
    keyed = wide.select(
        pad_key(F.col(key).cast("string")).alias("entity"),
        *[nan_to_null(F.col(f"`{m}`").try_cast("double")).alias(m) for m in months],
    )
    long = keyed.unpivot("entity", months, "month", "value")
    return long.where("value is not null").select(
        "entity", month_index(F.to_date("month")).cast("int").alias("midx"), "value"
    )


def optional_series(spark: SparkSession, path: str) -> DataFrame:
    """The series of a wide file, or an empty one of the same shape when the file is absent."""
    try:
        return wide_series(read_wide(spark, path))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        log.warning("%s missing; its columns stay empty", path)
        return spark.createDataFrame([], SERIES_SCHEMA)


def nearest_column(columns: list[str], base: dt.date, days: int = 365) -> str:
    """The date column closest to `base` + `days`, the first one on a tie."""
    return min(month_columns(columns), key=lambda c: abs((dt.date.fromisoformat(c) - base).days - days))


def outside_forecast(wide: DataFrame, base: dt.date | None = None, key: str = KEY_COLUMN) -> DataFrame:
    """(entity, forecast_1y_pct): the column nearest to one year after the base date. Reads two columns. Rows with
    different base dates, or none in the whole table, are an error."""
    if base is None:
        date = F.to_date(BASE_DATE_COLUMN)
        base, last = wide.agg(F.min(date), F.max(date)).first()
        if base is None or base != last:
            raise ValueError(f"one base date expected, found {base} to {last}")
    column = nearest_column([c for c in wide.columns if c[:2] == "20"], base)
    return wide.select(
        pad_key(F.col(key).cast("string")).alias("entity"),
        F.col(f"`{column}`").try_cast("double").alias("forecast_1y_pct"),
    )


def optional_forecast(spark: SparkSession, path: str) -> DataFrame:
    try:
        return outside_forecast(read_wide(spark, path))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        log.warning("%s missing; no outside forecast", path)
        return spark.createDataFrame([], "entity string, forecast_1y_pct double")


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(entity, lat, lon) from a tab-separated file whose header names carry stray blanks."""
    raw = spark.read.csv(path, sep="\t", header=True)
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    return trimmed.select(
        pad_key(F.trim("GEOID")).alias("entity"),
        F.trim("INTPTLAT").try_cast("double").alias("lat"),
        F.trim("INTPTLONG").try_cast("double").alias("lon"),
    )


def read_observations(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(series, date, value) from a two-column file, columns by position, '.' for missing."""
    raw = spark.read.csv(path, header=True).toDF("date", "value")
    return observations(raw.withColumn("series", F.lit(name)))


def observations(raw: DataFrame) -> DataFrame:
    """Typed (series, date, value) rows from text; what is not a number is missing and dropped."""
    return raw.select(
        "series", F.to_date("date").alias("date"), F.col("value").try_cast("double").alias("value")
    ).where("value is not null")
