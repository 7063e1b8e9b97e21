"""Panels, result tables and ranking documents on storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.scalar import half_even, pct_from_log


def write_panel(panel: DataFrame, path: str) -> None:
    """Parquet by origin year, so a fold reads only its years."""
    panel.write.mode("overwrite").partitionBy("origin_year").parquet(path)


def read_panel(spark: SparkSession, path: str, horizons: tuple[int, ...]) -> DataFrame:
    panel = spark.read.parquet(path)
    missing = [h for h in horizons if f"target_{h}y" not in panel.columns]
    if missing:
        raise ValueError(f"panel has no targets for horizons {missing}; build it again")
    return panel


def write_table(table: DataFrame, path: str) -> None:
    """A small result table (one row per fold, model or origin) as one CSV file."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_by_horizon(table: DataFrame, path: str) -> None:
    """CSV per horizon. A static overwrite also drops horizons that are not part of this run."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("horizon").csv(path, header=True)


def skill_map(summary: DataFrame, models: list[str], fingerprint: Column | None = None) -> DataFrame:
    """(horizon, skill): a map from model to its measured walk-forward skill; one row per model goes in.

    With a panel's `fingerprint`, only rows stamped with it count: skill that was measured on another panel is not
    written into documents."""
    entry = F.struct(
        half_even(F.col("spearman_focus_mean")).alias("spearman_focus_mean"),
        F.array(half_even(F.col("spearman_focus_ci_low")), half_even(F.col("spearman_focus_ci_high"))).alias("spearman_focus_ci90"),
        half_even(F.col("spearman_focus_min")).alias("spearman_focus_min"),
        F.col("n_folds").alias("folds"),
    )
    known = summary.where(F.col("model").isin(models))
    if fingerprint is not None:
        stamped = "panel_fingerprint" in summary.columns
        known = known.where(F.col("panel_fingerprint") == fingerprint) if stamped else known.limit(0)
    return known.groupBy("horizon").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", entry.alias("skill"))))).alias("skill")
    )


MEANINGS = {
    "score": "Mean of what both models expect as the entity's percentile of growth inside its group, from 0 to 100; no forecast of growth itself.",
    "historical_growth_vs_group_pct": "Growth against the group that earlier entities of the focus group had after the same predicted percentile; a comparison with the past.",
    "level_vs_group_median_pct": "Value against the median entity of the group at the origin.",
    "past_growth_vs_group_pct": "Growth over the years before the origin against the group's mean.",
}


def ranking_documents(
    ranking: DataFrame,
    agreement: Column | None = None,
    skill: DataFrame | None = None,
    chunk: int = 1000,
    long: int = 5,
    generated: Column | None = None,
) -> DataFrame:
    """(horizon, part, json): nested documents with the ranked entities.

    `ranking` is what `rank_focus` gives: horizon, rank, origin and the entity columns, past growth over `long` years
    among them. A document says when it was made (today, or `generated`) and what its fields mean. A list of up to `chunk` entities is one document;
    a longer one continues in further parts, so no task ever holds an unbounded list. Missing values are written
    as null and numbers are rounded to two places."""
    entity = F.struct(
        "rank",
        "entity",
        *[c for c in ("city", "sub", "state") if c in ranking.columns],
        half_even(F.round("value", 0)).alias("value"),
        *[half_even(F.col(c)).alias(c) for c in ("score", "focus_percentile")],
        half_even(F.col("hist_relative_pct")).alias("historical_growth_vs_group_pct"),
        half_even(F.col("forecast_1y_pct")).alias("forecast_1y_pct"),
        half_even(pct_from_log(F.col("level_rel_group"))).alias("level_vs_group_median_pct"),
        half_even(pct_from_log(F.col(f"mom_{long}y_rel"))).alias("past_growth_vs_group_pct"),
    )
    counts = ranking.groupBy("horizon").agg(F.count("*").alias("n_entities"), F.max("origin").alias("origin"))
    parts = ranking.groupBy("horizon", F.floor((F.col("rank") - 1) / F.lit(chunk)).cast("int").alias("part")).agg(
        F.array_sort(F.collect_list(entity)).alias("entities")
    )
    rows = parts.join(counts, "horizon")
    rows = rows.join(skill, "horizon", "left") if skill is not None else rows
    doc = F.struct(
        F.col("horizon").alias("horizon_years"),
        F.col("origin").cast("string").alias("origin"),
        (F.current_date() if generated is None else generated).cast("string").alias("generated"),
        "n_entities",
        "part",
        F.struct(*[F.lit(v).alias(k) for k, v in MEANINGS.items()]).alias("meanings"),
        *([F.col("skill").alias("walk_forward_skill")] if skill is not None else []),
        (half_even(agreement) if agreement is not None else F.lit(None).cast("double")).alias("spearman_vs_outside_forecast"),
        "entities",
    )
    return rows.select("horizon", "part", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def write_documents(documents: DataFrame, path: str) -> None:
    documents.select("horizon", "json").write.mode("overwrite").partitionBy("horizon").text(path)
