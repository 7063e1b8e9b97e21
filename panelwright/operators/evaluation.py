"""Walk-forward folds, one-line rules, scores and their summary.

Predictions are always long: horizon, test_year, model, entity, sub, in_focus, pred, actual. Everything that is
not a fit is one set-based plan over all folds, horizons and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators.agreement import paired_ranks, rank_correlation, top_minus_bottom
from panelwright.operators.positions import DEFAULT_PLAN, SplitPlan

METRICS = (
    "spearman_national",
    "spearman_focus",
    "spearman_focus_within_sub",
    "q5_q1_spread_national",
    "q5_q1_spread_focus",
)


def baselines(short: int = 1, long: int = 5) -> dict[str, Callable[[], Column]]:
    """Registry: rule name -> expression on panel rows."""
    return {
        f"momentum_{short}y": lambda: F.col(f"mom_{short}y_rel"),
        f"momentum_{long}y": lambda: F.col(f"mom_{long}y_rel"),
        "catch_up_price": lambda: -F.col("level_rel_group"),
        "catch_up_neighbours": lambda: -F.col("nbr_level_gap"),
        "beta_x_group_trend": lambda: F.col("beta") * F.col(f"group_mom_{short}y"),
    }


def usable_rows(panel: DataFrame, horizon: int) -> DataFrame:
    return panel.where(F.col("group_ok") & F.col(f"target_{horizon}y").isNotNull())


def walk_forward_folds(panel: DataFrame, horizons: tuple[int, ...], first_test_year: int) -> DataFrame:
    """(horizon, test_year, n_train, n_test): training outcomes must be realised before the test origin, so a
    fold trains on origins up to test_year - horizon. Counted from one row per (horizon, origin year)."""
    targets = ", ".join(f"{h}, target_{h}y" for h in horizons)
    yearly = (
        panel.where("group_ok")
        .selectExpr("origin_year", f"stack({len(horizons)}, {targets}) as (horizon, actual)")
        .where("actual is not null")
        .groupBy("horizon", "origin_year")
        .agg(F.count("*").alias("n_test"))
    )
    return _folds_from_counts(yearly, first_test_year)


def _folds_from_counts(yearly: DataFrame, first_test_year: int) -> DataFrame:
    """The window runs over one row per origin year and horizon. The frame end differs by horizon, so the
    counts are first moved to the first test year that may use them."""
    usable_from = yearly.select(
        "horizon", (F.col("origin_year") + F.col("horizon")).alias("test_year"), F.col("n_test").alias("_add")
    )
    line = yearly.select("horizon", F.col("origin_year").alias("test_year"), "n_test").unionByName(
        usable_from, allowMissingColumns=True
    )
    summed = line.groupBy("horizon", "test_year").agg(F.max("n_test").alias("n_test"), F.sum("_add").alias("_add"))
    so_far = W.partitionBy("horizon").orderBy("test_year").rowsBetween(W.unboundedPreceding, 0)
    return (
        summed.withColumn("n_train", F.coalesce(F.sum("_add").over(so_far), F.lit(0)))
        .where((F.col("test_year") >= first_test_year) & F.col("n_test").isNotNull() & (F.col("n_train") > 0))
        .select("horizon", "test_year", "n_train", "n_test")
    )


def rule_predictions(
    panel: DataFrame,
    horizons: tuple[int, ...],
    rules: dict[str, Callable[[], Column]],
    first_test_year: int | None = None,
) -> DataFrame:
    """All rules on all horizons in one pass over the panel."""
    targets = F.explode(
        F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}y").alias("actual")) for h in horizons])
    )
    names = F.array(*[F.lit(n) for n in rules])
    rows = panel.where("group_ok")
    if first_test_year is not None:
        rows = rows.where(F.col("origin_year") >= first_test_year)
    return (
        rows.select(
            "entity",
            F.col("origin_year").alias("test_year"),
            "sub",
            "in_focus",
            F.array(*[f() for f in rules.values()]).alias("_preds"),
            targets.alias("t"),
        )
        .where("t.actual is not null")
        .select("entity", "test_year", "sub", "in_focus", "t.horizon", "t.actual", F.posexplode("_preds").alias("_i", "pred"))
        .withColumn("model", F.element_at(names, F.col("_i") + 1))
        .drop("_i")
    )


FOLD = ["horizon", "test_year", "model"]


def score(
    predictions: DataFrame, min_pairs: int = 20, min_spread_pairs: int = 50, plan: SplitPlan = DEFAULT_PLAN
) -> DataFrame:
    """One row per (horizon, test_year, model): national, focus and within-subgroup agreement, spreads, counts.

    A row enters up to three scopes (everyone, focus, its focus subgroup), so all five metrics come from one
    ranking pass keyed by fold and scope."""
    counts = predictions.groupBy(*FOLD).agg(
        F.count("actual").cast("int").alias("n_test"),
        F.count(F.when(F.col("in_focus"), F.col("actual"))).cast("int").alias("n_test_focus"),
    )
    scopes = F.when(
        F.col("in_focus"),
        F.array(F.lit("national"), F.lit("focus"), F.concat(F.lit("sub="), F.coalesce("sub", F.lit("")))),
    ).otherwise(F.array(F.lit("national")))
    scoped = predictions.select(*FOLD, "entity", "pred", "actual", F.explode(scopes).alias("scope"))
    keys = [*FOLD, "scope"]
    per_scope = (
        paired_ranks(scoped, keys, ["entity"], "pred", "actual", plan)
        .groupBy(*keys)
        .agg(rank_correlation(min_pairs).alias("rho"), top_minus_bottom(min_spread_pairs).alias("spread"))
    )
    whole = lambda scope, col: F.max(F.when(F.col("scope") == scope, F.col(col)))
    metrics = per_scope.groupBy(*FOLD).agg(
        whole("national", "rho").alias("spearman_national"),
        whole("focus", "rho").alias("spearman_focus"),
        F.avg(F.when(F.col("scope").startswith("sub="), F.col("rho"))).alias("spearman_focus_within_sub"),
        whole("national", "spread").alias("q5_q1_spread_national"),
        whole("focus", "spread").alias("q5_q1_spread_focus"),
    )
    return counts.join(metrics, FOLD, "left").select(*FOLD, *METRICS, "n_test", "n_test_focus")


def block_bootstrap(
    scores: DataFrame, keys: list[str], value: str, order: str, block: Column, draws: int, level: float, seed: int
) -> DataFrame:
    """Interval for the mean of a short ordered series per key from circular blocks.

    The series are per-year scores, so an array per key is bounded by the calendar. Block starts come from a
    digest of (seed, draw, block number): the same numbers on any machine and any retry. NULL bounds with fewer
    than 3 values or fewer than two blocks."""
    series = (
        scores.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("_v"),
            F.max(block).cast("int").alias("_block"),
        )
        .withColumn("_n", F.size("_v"))
    )
    fits = (F.col("_n") >= 3) & (F.col("_block") <= F.floor(F.col("_n") / 2))
    start = lambda b: F.conv(
        F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_draw").cast("string"), b.cast("string"))), 1, 8),
        16,
        10,
    ).cast("bigint")
    size = F.greatest(F.col("_block"), F.lit(1))
    pick = lambda i: F.get(
        F.col("_v"),
        F.pmod(start(F.floor(i / size).cast("int")) + F.pmod(i, size), F.col("_n")).cast("int"),
    )
    total = F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), F.lit(0.0), lambda acc, i: acc + pick(i))
    tail = (1 - level) / 2
    bounds = (
        series.where(fits)
        .withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("_mean", total / F.col("_n"))
        .groupBy(*keys)
        .agg(F.percentile("_mean", [tail, 1 - tail]).alias("_q"))
    )
    return (
        series.select(*keys)
        .join(bounds, keys, "left")
        .select(*keys, F.get("_q", F.lit(0)).alias("ci_low"), F.get("_q", F.lit(1)).alias("ci_high"))
    )


def best_baseline(scores: DataFrame, names: list[str], metric: str = "spearman_focus") -> DataFrame:
    """(horizon, best_baseline): highest mean score, first name on a tie."""
    means = scores.where(F.col("model").isin(names)).groupBy("horizon", "model").agg(F.avg(metric).alias("_m"))
    # min_by over (-mean, name): the highest mean, then the first name
    return (
        means.where("_m is not null").groupBy("horizon").agg(
            F.min_by("model", F.struct((-F.col("_m")).alias("m"), "model")).alias("best_baseline")
        )
    )


def gaps_to_best(scores: DataFrame, best: DataFrame, model: str, metric: str = "spearman_focus") -> DataFrame:
    """(horizon, best_baseline, test_year, gap) over folds where both the model and the rule were scored."""
    both = scores.join(best, "horizon").where((F.col("model") == model) | (F.col("model") == F.col("best_baseline")))
    sides = both.groupBy("horizon", "best_baseline", "test_year").agg(
        F.max(F.when(F.col("model") == model, F.col(metric))).alias("_ours"),
        F.max(F.when(F.col("model") == F.col("best_baseline"), F.col(metric))).alias("_rule"),
    )
    return sides.where("_ours is not null and _rule is not null").select(
        "horizon", "best_baseline", "test_year", (F.col("_ours") - F.col("_rule")).alias("gap")
    )


def summarize(
    scores: DataFrame,
    baseline_names: list[str],
    model: str = "gbm_national",
    draws: int = 2000,
    level: float = 0.90,
    seed: int = 7,
    metrics: tuple[str, ...] = METRICS,
) -> DataFrame:
    """One row per (horizon, model): means, worst folds, interval, and for `model` the comparison with the best
    rule of its horizon."""
    metrics = [m for m in metrics if m in scores.columns]
    by_model = scores.groupBy("horizon", "model").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.min(m).alias(f"{m}_min") for m in metrics],
        F.count("*").cast("int").alias("n_folds"),
    )
    ci = block_bootstrap(
        scores, ["horizon", "model"], "spearman_focus", "test_year", F.col("horizon"), draws, level, seed
    ).select(
        "horizon", "model", F.col("ci_low").alias("spearman_focus_ci_low"), F.col("ci_high").alias("spearman_focus_ci_high")
    )
    scored = scores.where(F.col("model") == model).select("horizon").distinct()
    best = best_baseline(scores, baseline_names).join(scored, "horizon", "left_semi")
    gaps = gaps_to_best(scores, best, model)
    wins = gaps.groupBy("horizon").agg(
        F.count_if(F.col("gap") > 0).cast("int").alias("folds_model_beats_best"),
        F.count("*").cast("int").alias("folds_compared"),
        F.avg("gap").alias("gap_vs_best"),
    )
    gap_ci = block_bootstrap(gaps, ["horizon"], "gap", "test_year", F.col("horizon"), draws, level, seed).select(
        "horizon", F.col("ci_low").alias("gap_ci_low"), F.col("ci_high").alias("gap_ci_high")
    )
    compared = (
        best.join(wins, "horizon", "left")
        .join(gap_ci, "horizon", "left")
        .withColumn("model", F.lit(model))
        .withColumn("folds_model_beats_best", F.coalesce("folds_model_beats_best", F.lit(0)))
        .withColumn("folds_compared", F.coalesce("folds_compared", F.lit(0)))
    )
    return by_model.join(ci, ["horizon", "model"], "left").join(compared, ["horizon", "model"], "left")


def scores_by_year(scores: DataFrame, models: list[str], metric: str = "spearman_focus") -> DataFrame:
    """test_year x model for reading. The model list is given, so the pivot needs no extra pass."""
    return scores.groupBy("horizon", "test_year").pivot("model", models).agg(F.first(metric))


def ablation_summary(ablation: DataFrame, variants: list[str]) -> DataFrame:
    """One row per variant from the wide per-year table: mean, change against `full`, folds helped and changed."""
    pairs = ", ".join(f"'{v}', `{v}`" for v in variants)
    long = ablation.selectExpr("test_year", "full", f"stack({len(variants)}, {pairs}) as (variant, score)")
    other = F.col("variant") != "full"
    return long.groupBy("variant").agg(
        F.avg("score").alias("mean_score"),
        F.when(F.first(other), F.avg("full") - F.avg("score")).alias("change"),
        F.when(F.first(other), F.count_if(F.col("full") > F.col("score"))).alias("helped"),
        F.when(F.first(other), F.count_if(~F.coalesce(F.col("full") == F.col("score"), F.lit(False)))).alias("changed"),
    )


def is_fresh(summary: DataFrame, panel: DataFrame) -> bool:
    """Whether a stored summary was computed on this panel: its stamped origin is the panel's last origin."""
    if "panel_origin" not in summary.columns:
        return False
    stored = summary.select(F.col("panel_origin").cast("string").alias("o")).first()
    current = panel.agg(F.max("origin").cast("string").alias("o")).first()
    return stored is not None and stored["o"] == current["o"]


def stamp_origin(summary: DataFrame, panel: DataFrame) -> DataFrame:
    return summary.withColumn("panel_origin", panel.agg(F.max("origin")).scalar().cast("string"))


def panel_fingerprint(panel: DataFrame) -> Column:
    """A digest of the panel's rows, whatever their order: rows and a sum of row hashes per origin.

    Sums are combined before the shuffle; one row per origin is left for the digest."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(panel.columns)]).cast("decimal(20,0)")
    yearly = panel.select("origin", row.alias("_h")).groupBy("origin").agg(F.count("*").alias("_n"), F.sum("_h").alias("_s"))
    line = F.concat_ws("/", F.col("origin").cast("string"), F.col("_n").cast("string"), F.col("_s").cast("string"))
    return yearly.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256)).scalar()


def stamp_panel(summary: DataFrame, panel: DataFrame) -> DataFrame:
    """The summary with the last origin and the fingerprint of the panel it was computed on."""
    return stamp_origin(summary, panel).withColumn("panel_fingerprint", panel_fingerprint(panel))
