"""Group statistics put back on rows.

Always an aggregate (combined before the shuffle) joined back on the group keys, never a window over the
whole group: a group of any size stays spread over many tasks and the join side is one row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.positions import DEFAULT_PLAN, SplitPlan, medians
from panelwright.options import PanelOptions
from panelwright.session import cut_lineage


def attach(df: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    found = df.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()])
    return df.join(found, keys, "left")


def group_means(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per group: the means that `demean` takes from the sources in `columns`."""
    return df.groupBy(*keys).agg(*[F.avg(source).alias(f"_mean_{source}") for source in dict.fromkeys(columns.values())])


def demean(df: DataFrame, keys: list[str], columns: dict[str, str], means: DataFrame | None = None) -> DataFrame:
    """Add `{name: source}` = source minus its group mean; `means` where they are at hand as a written table."""
    out = df.join(group_means(df, keys, columns) if means is None else means, keys, "left")
    return out.select(
        *df.columns, *[(F.col(s) - F.col(f"_mean_{s}")).alias(name) for name, s in columns.items()]
    )


def group_flags(df: DataFrame, min_group: int, focus_group: str | None) -> DataFrame:
    """Add `group_ok` (group large enough at that origin) and `in_focus`."""
    sized = attach(df, ["midx", "grp"], {"_group_size": F.count("*")})
    return sized.withColumn("group_ok", F.col("_group_size") >= min_group).withColumn(
        "in_focus", F.col("grp") == F.lit(focus_group)
    ).drop("_group_size")


def slope(years: int, min_years: int) -> Column:
    """Slope of `_growth_k` on the group means `_growth_k_m`, over the years where both are known."""
    both = [f"(_growth_{k} IS NOT NULL AND _growth_{k}_m IS NOT NULL)" for k in range(years)]
    n = " + ".join(f"cast({k} as int)" for k in both)

    def total(term: str) -> str:
        return "(" + " + ".join(
            f"CASE WHEN {known} THEN {term.format(g=f'_growth_{k}', m=f'_growth_{k}_m')} ELSE 0D END"
            for k, known in enumerate(both)
        ) + ")"

    mean_g, mean_m = f"try_divide({total('{g}')}, cast({n} as double))", f"try_divide({total('{m}')}, cast({n} as double))"
    # transform over a one-element array names the two means once
    cov = total("({g} - x.g) * ({m} - x.m)")
    var = total("({m} - x.m) * ({m} - x.m)")
    means = f"array(named_struct('g', {mean_g}, 'm', {mean_m}))"
    return F.expr(f"get(transform({means}, x -> CASE WHEN {n} >= {min_years} THEN try_divide({cov}, {var}) END), 0)")


def group_features(rows: DataFrame, opt: PanelOptions, plan: SplitPlan = DEFAULT_PLAN) -> DataFrame:
    """Everything an origin row learns from its group and subgroup: demeaned momentum and outcomes, beta, level,
    spread, momentum and size of the group, level and momentum inside the subgroup, and the flags.

    `rows` is read once per statistic, so pass a written table. All means of a group come from one aggregate. The tables of
    statistics are written, so that their size is known before the rows are joined: small ones go to the rows, which are
    then not shuffled and not sorted by group."""
    keys, ids = ["midx", "grp"], ["entity", "midx"]
    short, long = f"mom_{opt.short_lag}y", f"mom_{opt.long_lag}y"
    moved = [*[f"mom_{k}y" for k in opt.lags], *[f"fwd_{h}y" for h in opt.horizons]]
    growth = [f"_growth_{k}" for k in range(opt.beta_window)]
    keyed = rows.withColumn("_sub", F.coalesce("sub", F.lit("")))

    in_group = keyed.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in moved],
        *[F.avg(g).alias(f"{g}_m") for g in growth],
        F.stddev_samp("log_value").alias("group_level_spread"),
        F.count("*").alias("_size"),
    )
    in_sub = keyed.groupBy(*keys, "_sub").agg(F.avg(short).alias("_sub_short"), F.avg(long).alias("_sub_long"))
    group_median = medians(keyed, keys, "log_value", ids, "group_level_median", plan)
    sub_median = medians(keyed, [*keys, "_sub"], "log_value", ids, "_sub_median", plan)

    of_group = cut_lineage(in_group.join(group_median, keys))
    of_sub = cut_lineage(in_sub.join(sub_median, [*keys, "_sub"]))
    wide = keyed.join(of_group, keys, "left").join(of_sub, [*keys, "_sub"], "left")
    c = F.col
    return wide.select(
        *[n for n in rows.columns if n not in growth],
        *[(c(f"mom_{k}y") - c(f"_mean_mom_{k}y")).alias(f"mom_{k}y_rel") for k in opt.lags],
        *[(c(f"fwd_{h}y") - c(f"_mean_fwd_{h}y")).alias(f"target_{h}y") for h in opt.horizons],
        (c("log_value") - c("group_level_median")).alias("level_rel_group"),
        "group_level_median",
        "group_level_spread",
        c(f"_mean_{long}").alias(f"group_{long}"),
        c(f"_mean_{short}").alias(f"group_{short}"),
        F.ln(c("_size").cast("double")).alias("group_log_size"),
        slope(opt.beta_window, opt.beta_min).alias("beta"),
        (c("log_value") - c("_sub_median")).alias("level_rel_sub"),
        (c("_sub_median") - c("group_level_median")).alias("sub_level_rel_group"),
        (c(short) - c("_sub_short")).alias(f"{short}_rel_sub"),
        (c("_sub_short") - c(f"_mean_{short}")).alias(f"sub_{short}_rel"),
        (c("_sub_long") - c(f"_mean_{long}")).alias(f"sub_{long}_rel"),
        (c("_size") >= opt.min_group).alias("group_ok"),
        (c("grp") == F.lit(opt.focus_group)).alias("in_focus"),
    )
