"""Attribute tables published per vintage: header-row JSON, code names, missing marks, partial pulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.scalar import pad_key, sum_or_null

# The mark for a suppressed number, and column names with their published variable codes.
MISSING_MARK = -666666666
BASE_CODES = {
    "pop": "B01003_001E",
    "median_age": "B01002_001E",
    "male_25_29": "B01001_011E",
    "male_30_34": "B01001_012E",
    "female_25_29": "B01001_035E",
    "female_30_34": "B01001_036E",
    "median_income": "B19013_001E",
    "median_home_value": "B25077_001E",
    "median_rent": "B25064_001E",
    "housing_units": "B25001_001E",
    "vacant_units": "B25002_003E",
    "occupied_units": "B25003_001E",
    "owner_occupied": "B25003_002E",
    "mobility_total": "B07001_001E",
    "moved_other_county": "B07001_049E",
    "moved_other_state": "B07001_065E",
    "moved_abroad": "B07001_081E",
    "labor_force": "B23025_003E",
    "unemployed": "B23025_005E",
    "commuters": "B08301_001E",
    "transit_commuters": "B08301_010E",
    "median_year_built": "B25035_001E",
}
# Education tables in order of preference: the newer one, else the older one split by sex.
EDUCATION_CODES = {
    "B15003": {
        "edu_total": ("B15003_001E",),
        "edu_bachelors_plus": tuple(f"B15003_{i:03d}E" for i in range(22, 26)),
    },
    "B15002": {
        "edu_total": ("B15002_001E",),
        "edu_bachelors_plus": tuple(f"B15002_{i:03d}E" for i in (*range(15, 19), *range(32, 36))),
    },
}
ENTITY_COLUMN = "zip code tabulation area"


def header_row_table(documents: DataFrame, text: str, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows of JSON documents shaped [[header...], [row...], ...] as columns picked by header name."""
    keep = keep or []
    parsed = documents.select(*keep, F.from_json(text, "array<array<string>>").alias("_rows"))
    rows = parsed.select(*keep, F.get("_rows", F.lit(0)).alias("_head"), F.explode(F.slice("_rows", 2, 1 << 30)).alias("_row"))

    def cell(name: str) -> Column:
        return F.get("_row", (F.array_position("_head", name) - 1).cast("int")).alias(name)

    return rows.select(*keep, *[cell(c) for c in columns])


def read_header_row_json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return header_row_table(spark.read.text(path, wholetext=True), "value", columns)


def number(x: Column) -> Column:
    """Text to number: what does not parse and the missing mark become NULL."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value) & (value > MISSING_MARK), value)


def education_table(available: list[str]) -> str:
    for table in EDUCATION_CODES:
        if f"{table}_001E" in available:
            return table
    raise ValueError("no educational attainment table among the columns")


def check_base_codes(available: list[str]) -> None:
    missing = [code for code in BASE_CODES.values() if code not in available]
    if missing:
        raise ValueError(f"missing attribute codes {missing}")


def merge_parts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two partial pulls of one vintage; an entity in either stays."""
    return left.join(right, key, "full_outer")


def normalise_vintage(merged: DataFrame, vintage: int | Column, entity: str = ENTITY_COLUMN) -> DataFrame:
    """Named numeric columns of one vintage from a table of codes."""
    check_base_codes(merged.columns)
    education = EDUCATION_CODES[education_table(merged.columns)]
    year = F.lit(vintage).cast("int") if isinstance(vintage, int) else vintage.cast("int")
    return merged.select(
        pad_key(F.col(f"`{entity}`")).alias("entity"),
        year.alias("vintage"),
        *[number(F.col(code)).alias(name) for name, code in BASE_CODES.items()],
        *[sum_or_null([number(F.col(c)) for c in codes]).alias(name) for name, codes in education.items()],
    )


def write_vintages(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").partitionBy("vintage").parquet(path)


def read_vintages(spark: SparkSession, path: str) -> DataFrame:
    """All vintages of a folder written by `write_vintages`; the year is the partition column."""
    return spark.read.parquet(path)


def read_vintage_files(spark: SparkSession, pattern: str) -> DataFrame:
    """All vintages from files named `<prefix>_<year>.parquet`; the year comes from the file name."""
    name = F.regexp_extract(F.input_file_name(), r"_(\d{4})\.parquet", 1)
    return spark.read.parquet(pattern).withColumn("vintage", name.cast("int"))
