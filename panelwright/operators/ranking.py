"""Final ranked lists: rank, percentile, historical analogue, sub-area lists, list shape, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.scalar import band_index, pct_from_log
from panelwright.operators.agreement import grouped_spearman
from panelwright.operators.positions import (
    DEFAULT_PLAN,
    SplitPlan,
    add_percentiles,
    medians,
    with_row_number,
)


def analogue_bands(
    train: DataFrame, target: str, bands: int = 20, ids: tuple[str, ...] = ("entity", "midx"), plan: SplitPlan = DEFAULT_PLAN
) -> DataFrame:
    """(band, growth) for every band: median realised relative growth of focus rows whose realised percentile
    fell in the band. Empty bands are interpolated; leading ones stay NULL, trailing ones keep the last value.
    The windows run over `bands` rows."""
    rows = train.where(F.col("in_focus") & F.col(target).isNotNull()).withColumn(
        "band", band_index(F.col(f"{target}_pct"), bands)
    )
    found = medians(rows, ["band"], target, list(ids), "_median", plan)
    every = train.sparkSession.range(bands).select(F.col("id").cast("int").alias("band"))
    line = every.join(found, "band", "left")
    back = W.partitionBy(F.lit(0)).orderBy("band").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(F.lit(0)).orderBy("band").rowsBetween(0, W.unboundedFollowing)
    here = F.when(F.col("_median").isNotNull(), F.col("band"))
    lined = line.select(
        "band",
        F.last("_median", ignorenulls=True).over(back).alias("_pv"),
        F.last(here, ignorenulls=True).over(back).alias("_pb"),
        F.first("_median", ignorenulls=True).over(ahead).alias("_nv"),
        F.first(here, ignorenulls=True).over(ahead).alias("_nb"),
    )
    step = F.try_divide((F.col("band") - F.col("_pb")).cast("double"), (F.col("_nb") - F.col("_pb")).cast("double"))
    between = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * F.coalesce(step, F.lit(0.0))
    return lined.select("band", F.coalesce(between, F.col("_pv")).alias("growth"))


def rank_rows(scored: DataFrame, keys: list[str], plan: SplitPlan = DEFAULT_PLAN) -> DataFrame:
    """Add `rank` (best first, ties by entity) and `focus_percentile` within `keys` to rows with entity and score.

    A list may hold a third of all entities, so both come from split positions, not from one window. `keys` must be
    columns of the data, such as the origin: a constant would turn the joins on it into cross joins."""
    ranked = with_row_number(scored, keys, ["-score", "entity"], ["entity"], "rank", plan)
    out = add_percentiles(ranked, keys, [*keys, "entity"], {"_pct": "score"}, plan)
    return out.withColumn("focus_percentile", 100 * F.col("_pct")).drop("_pct")


def add_analogue(ranked: DataFrame, bands: DataFrame, n_bands: int = 20) -> DataFrame:
    band = F.greatest(band_index(F.col("score") / 100, n_bands), F.lit(0))
    return (
        ranked.withColumn("band", band)
        .join(bands, "band", "left")
        .withColumn("hist_relative_pct", pct_from_log(F.col("growth")))
        .drop("band", "growth")
    )


def area_subset(ranking: DataFrame, areas: dict[str, tuple[list[str], str | None]], n: int) -> DataFrame:
    """Top n of each named area `{title: (subgroups, flagged city)}` with the rank inside the area and overall."""
    parts = F.array_compact(
        F.array(*[
            F.when(F.col("sub").isin(subs), F.struct(F.lit(title).alias("area"),
                   (F.coalesce(F.col("city") == F.lit(city), F.lit(False))).alias("flagged")))
            for title, (subs, city) in areas.items()
        ])
    )
    rows = ranking.withColumn("_a", F.explode(parts)).select(*ranking.columns, "_a.area", "_a.flagged")
    order = W.partitionBy("area").orderBy("rank")
    return rows.withColumn("sub_rank", F.row_number().over(order)).where(F.col("sub_rank") <= n)


def top_and_bottom(ranking: DataFrame, n: int) -> DataFrame:
    top = ranking.orderBy("rank").limit(n).withColumn("side", F.lit("top"))
    bottom = ranking.orderBy(F.desc("rank")).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def list_shape(ranking: DataFrame, n: int, level: str = "level_rel_group", growth: str = "mom_1y_rel") -> DataFrame:
    """Median level and growth of the first and last n rows."""
    return top_and_bottom(ranking, n).groupBy("side").agg(
        F.median(level).alias("median_level"), F.median(growth).alias("median_growth"), F.count("*").alias("n_rows")
    )


def outside_agreement(
    ranking: DataFrame, forecast: str, keys: list[str], top: int = 25, min_pairs: int = 20, plan: SplitPlan = DEFAULT_PLAN
) -> DataFrame:
    """Per key: Spearman of our score with an outside forecast, its mean over our top rows and over all, count."""
    rho = grouped_spearman(ranking, keys, ["entity"], "score", forecast, min_pairs, plan).select(*keys, "rho")
    sums = ranking.groupBy(*keys).agg(
        F.avg(F.when(F.col("rank") <= top, F.col(forecast))).alias("top_mean"),
        F.avg(forecast).alias("all_mean"),
        F.count(forecast).alias("n_known"),
    )
    return sums.join(rho, keys, "left")
