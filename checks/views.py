"""Panel-shaped views of the given tables.

Entity = part, group = part type, subgroup = brand, focus group = PROMO; a year is its December. The fact table
is always aggregated by part before it meets the part table, so a hot part is combined before any shuffle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.folder import ready
from panelwright.operators.macro import last_observation_per_month
from panelwright.operators.vintages import attribute_features
from panelwright.options import EvaluationOptions, PanelOptions
from panelwright.plans.panel import PanelInputs, base_panel
from panelwright.session import cut_lineage, settle, tune

FOCUS = "PROMO"
OPT = PanelOptions(
    min_origin_year=1990,
    lags=(1, 2, 3),
    rent_lag=2,
    horizons=(1, 2, 3, 5),
    beta_window=4,
    beta_min=3,
    min_group=10,
    focus_group=FOCUS,
    macro_window=12,
    macro_min=6,
)
WHOLE = replace(OPT, vintage_gap=2)  # so that the few years hold changes of attributes
EVAL = EvaluationOptions(horizons=(1, 2, 3, 5), first_test_year=1997, draws=200, focus_min_rows=100)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ready(tune(spark)).read.parquet(f"{sf}/{name}.parquet")


def parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("entity"), F.col("p_type").alias("grp"), F.col("p_brand").alias("sub")
    )


def yearly(spark, sf) -> DataFrame:
    """(entity, yr, val, rent, inventory, new_listings, cut_share) from the line items."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("entity"), F.year("l_shipdate").alias("yr"))
        .agg(
            F.avg("l_extendedprice").alias("val"),
            F.avg("l_quantity").alias("rent"),
            F.count("*").cast("double").alias("inventory"),
            F.count_distinct("l_orderkey").cast("double").alias("new_listings"),
            F.avg("l_discount").alias("cut_share"),
        )
        .withColumn("midx", F.col("yr") * 12 + 11)
    )


def part_panel(spark, sf) -> DataFrame:
    return yearly(spark, sf).join(parts(spark, sf), "entity")


def as_series(rows: DataFrame, value: str) -> DataFrame:
    return rows.select("entity", "midx", F.col(value).alias("value"))


def inputs(spark, sf, rows: DataFrame | None = None) -> PanelInputs:
    rows = yearly(spark, sf) if rows is None else rows
    return PanelInputs(
        series=as_series(rows, "val"),
        meta=parts(spark, sf),
        rent=as_series(rows, "rent"),
        tempo={
            "inventory": as_series(rows, "inventory"),
            "new_listings": as_series(rows, "new_listings"),
            "price_cut_share": as_series(rows, "cut_share"),
        },
        coords=points(spark, sf),
    )


def attribute_vintages(rows: DataFrame) -> DataFrame:
    """Attribute counts of every part and year, made from its line items, under their normalised names."""
    e, c = F.col("entity"), F.col
    return rows.select(
        "entity", c("yr").alias("vintage"), (1000 * c("inventory")).alias("pop"), (c("val") / 10).alias("median_income"),
        (30 * c("rent")).alias("median_rent"), (100 * c("inventory") + e % 50).alias("housing_units"),
        (20.0 + e % 40).alias("median_age"), F.when(e % 9 > 0, 1900.0 + e * 7 % 120).otherwise(0.0).alias("median_year_built"),
        c("rent").alias("male_25_29"), F.lit(None).cast("double").alias("male_30_34"), c("inventory").alias("female_25_29"),
        c("rent").alias("female_30_34"), c("rent").alias("owner_occupied"), (2 * c("rent") + c("inventory")).alias("occupied_units"),
        c("new_listings").alias("vacant_units"), c("rent").alias("edu_bachelors_plus"), (60 + c("inventory")).alias("edu_total"),
        c("inventory").alias("moved_other_county"), F.when(e % 3 > 0, c("rent")).alias("moved_other_state"),
        F.lit(None).cast("double").alias("moved_abroad"), (100 * c("new_listings")).alias("mobility_total"),
        (100 * c("cut_share")).alias("unemployed"), (100 + c("rent")).alias("labor_force"), c("inventory").alias("transit_commuters"),
        (c("inventory") + c("rent")).alias("commuters"),
    )


def every_input(spark, sf) -> PanelInputs:
    """All sources that a panel can have. All but the months come from one written table of years."""
    rows = cut_lineage(yearly(spark, sf))
    some = inputs(spark, sf, rows)
    items = table(spark, sf, "lineitem").select((F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("midx"), "l_quantity")
    rates = last_observation_per_month(order_observations(spark, sf).withColumn("series", F.lit("rate")), "id")
    return replace(
        some,
        tempo={**some.tempo, "days_pending": some.rent},
        rate=rates.select("midx", "value"),
        rent_index=items.groupBy("midx").agg(F.avg("l_quantity").alias("value")),
        attributes=attribute_features(attribute_vintages(rows)),
    )


def panel(spark, sf) -> DataFrame:
    """Momentum, outcomes, beta, group and subgroup features and flags."""
    some = inputs(spark, sf)
    # Written, as history, months and the last month each read it.
    return base_panel(replace(some, series=cut_lineage(some.series)), OPT)


def written_panel(spark, sf) -> DataFrame:
    """The same as a written table, which is how evaluations read a panel."""
    return settle(lambda: panel(spark, sf))


def points(spark, sf) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("entity"),
        F.col("p_type").alias("grp"),
        ((key * 37 % 1200).cast("double") / 10.0 - 60.0).alias("lat"),
        ((key * 91 % 3400).cast("double") / 10.0 - 170.0).alias("lon"),
    )


def group_month(spark, sf) -> DataFrame:
    """Line items with their group and month: (series, midx, price, qty, id). Not aggregated."""
    items = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("entity"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("midx"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        "l_orderkey",
        "l_linenumber",
    )
    return items.join(parts(spark, sf).select("entity", F.col("grp").alias("series")), "entity")


def order_observations(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("value"),
    )


def vintages(spark, sf) -> DataFrame:
    """(entity, vintage, total, part_a, income) per brand and order year; 1998 is a gap on purpose."""
    orders = table(spark, sf, "orders").where(F.year("o_orderdate") != 1998)
    items = (
        table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    )
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "l_partkey", F.year("o_orderdate").alias("vintage")
    ).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("n")).otherwise(0)).alias("f"),
        F.sum(F.col("o_totalprice") * F.col("n")).alias("spent"),
    )
    brands = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    return (
        rows.join(brands, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("entity", "vintage")
        .agg(
            F.sum("n").cast("double").alias("total"),
            F.sum("f").cast("double").alias("part_a"),
            F.try_divide(F.sum("spent"), F.sum("n").cast("double")).alias("income"),
        )
    )


def wide(spark, sf) -> DataFrame:
    """One row per part, one text column per year end, header names as in the wide files."""
    years = range(1995, 2002)
    rows = yearly(spark, sf).groupBy("entity").agg(
        *[F.max(F.when(F.col("yr") == y, F.col("val"))).alias(f"{y}-12-31") for y in years]
    )
    meta = parts(spark, sf).select(
        F.col("entity").cast("string").alias("RegionName"),
        F.substring("sub", 1, 5).alias("State"),
        F.concat(F.lit("Town "), F.col("entity").cast("string")).alias("City"),
        F.col("grp").alias("Metro"),
        F.col("sub").alias("CountyName"),
        "entity",
    )
    return meta.join(rows, "entity").drop("entity")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums depend on their order in the last places."""
    return df.select(*[rounded_column(n, digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def rounded_column(name: str, digits: int) -> Column:
    """`round` in decimals, which it does by way of text. Where the scaled value is small enough to be known to a thousandth
    and is no near tie, its nearest whole number divided by the scale is the same double and needs no text."""
    scaled = F.col(f"`{name}`") * F.lit(10.0**digits)
    sure = (F.abs(scaled) < F.lit(2.0**42)) & (F.abs(F.abs(scaled - F.rint(scaled)) - F.lit(0.5)) > F.lit(0.01))
    return F.when(sure, F.rint(scaled) / F.lit(10.0**digits)).otherwise(F.round(F.col(f"`{name}`"), digits)) + F.lit(0.0)
