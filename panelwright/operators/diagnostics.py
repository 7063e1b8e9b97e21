"""One feature at a time: agreement with the outcome per origin, the beta split, and sign stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.agreement import grouped_spearman
from panelwright.operators.evaluation import usable_rows
from panelwright.operators.positions import DEFAULT_PLAN, SplitPlan

FACTOR_FEATURES = (
    "level_rel_group",
    "nbr_level_gap",
    "price_to_income",
    "rent_yield",
    "log_income",
    "bachelors_share",
    "mom_1y",
    "mom_5y",
    "unemployment_rate",
    "beta",
    "level_rel_sub",
    "inventory_yoy",
    "price_cut_share",
)


def factor_agreement(
    panel: DataFrame, horizon: int, features: list[str], min_pairs: int = 20, plan: SplitPlan = DEFAULT_PLAN
) -> DataFrame:
    """Long (origin_year, feature, scope, n, rho) with scope `all` or `focus`."""
    pairs = ", ".join(f"'{f}', `cs_{f}`" for f in features)
    scopes = F.when(F.col("in_focus"), F.array(F.lit("all"), F.lit("focus"))).otherwise(F.array(F.lit("all")))
    rows = (
        usable_rows(panel, horizon)
        .select("entity", "origin_year", F.col(f"target_{horizon}y").alias("y"), scopes.alias("_s"),
                F.expr(f"stack({len(features)}, {pairs}) as (feature, x)"))
        .where("x is not null")
        .withColumn("scope", F.explode("_s"))
    )
    return grouped_spearman(rows, ["origin_year", "feature", "scope"], ["entity"], "x", "y", min_pairs, plan)


def factor_history(
    panel: DataFrame, horizon: int, features: tuple[str, ...] = FACTOR_FEATURES, min_pairs: int = 20, plan=DEFAULT_PLAN
) -> DataFrame:
    """One row per origin: usable rows, and per feature its agreement for everyone and for the focus group."""
    have = [f for f in features if f"cs_{f}" in panel.columns]
    counts = usable_rows(panel, horizon).groupBy("origin_year").agg(F.count("*").cast("int").alias("n"))
    long = factor_agreement(panel, horizon, have, min_pairs, plan)
    cell = lambda f, s: F.max(F.when((F.col("feature") == f) & (F.col("scope") == s), F.col("rho")))
    wide = long.groupBy("origin_year").agg(
        *[c for f in have for c in (cell(f, "all").alias(f), cell(f, "focus").alias(f"{f}_focus"))]
    )
    return counts.join(wide, "origin_year", "left")


def beta_history(panel: DataFrame, horizon: int = 1, min_pairs: int = 20, plan: SplitPlan = DEFAULT_PLAN) -> DataFrame:
    """Per origin: does beta predict relative growth, overall, where the group rose, where it fell, in focus."""
    target = F.col(f"target_{horizon}y")
    rows = (
        usable_rows(panel, horizon)
        .where("beta is not null")
        .select("entity", "origin_year", "in_focus", "beta", target.alias("y"),
                (F.col(f"fwd_{horizon}y") - target).alias("group_growth"))
    )
    growth = F.col("group_growth")
    counts = rows.groupBy("origin_year").agg(
        F.count("*").cast("int").alias("n"),
        F.avg((growth > 0).cast("double")).alias("share_in_rising_groups"),
        F.avg(F.when(F.col("in_focus"), growth)).alias("focus_group_growth"),
    )
    scopes = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(growth > 0, F.lit("up")),
            F.when(growth < 0, F.lit("down")),
            F.when(F.col("in_focus"), F.lit("focus")),
        )
    )
    rho = grouped_spearman(
        rows.select("entity", "origin_year", "beta", "y", F.explode(scopes).alias("scope")),
        ["origin_year", "scope"], ["entity"], "beta", "y", min_pairs, plan,
    )
    cell = lambda s: F.max(F.when(F.col("scope") == s, F.col("rho")))
    wide = rho.groupBy("origin_year").agg(
        cell("all").alias("beta_spearman_all"),
        cell("up").alias("beta_spearman_up_groups"),
        cell("down").alias("beta_spearman_down_groups"),
        cell("focus").alias("beta_spearman_focus"),
    )
    return counts.join(wide, "origin_year", "left")


def beta_summary(history: DataFrame) -> DataFrame:
    """Means over origins where groups rose or fell, and the focus score split by the sign of its growth."""
    up, down = F.col("focus_group_growth") > 0, F.col("focus_group_growth") < 0
    focus = F.col("beta_spearman_focus")
    return history.agg(
        F.avg("beta_spearman_up_groups").alias("mean_up"),
        F.avg("beta_spearman_down_groups").alias("mean_down"),
        F.count_if(up).alias("n_focus_up"),
        F.avg(F.when(up, focus)).alias("mean_focus_up"),
        F.count_if(down).alias("n_focus_down"),
        F.avg(F.when(down, focus)).alias("mean_focus_down"),
    )


def sign_stability(agreement: DataFrame) -> DataFrame:
    """Per feature: share of origins whose sign equals the sign of the mean over origins."""
    known = agreement.where("rho is not null")
    means = known.groupBy("feature").agg(F.avg("rho").alias("mean_rho"))
    return (
        known.join(means, "feature")
        .groupBy("feature")
        .agg(
            F.max("mean_rho").alias("mean_rho"),
            F.avg((F.signum("rho") == F.signum("mean_rho")).cast("double")).alias("same_sign_share"),
            F.count("*").alias("n_origins"),
        )
    )
