"""Rank agreement of two columns within keys of any size, and the top-minus-bottom spread."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from panelwright.operators.chunks import Cell, Spots, once_per_row, with_spots
from panelwright.operators.positions import DEFAULT_PLAN, SplitPlan


def paired_ranks(
    pairs: DataFrame, keys: list[str], ids: list[str], a: str, b: str, plan: SplitPlan = DEFAULT_PLAN
) -> DataFrame:
    """Rows with both values, with their average ranks `rank_a`, `rank_b` and, for `a`, its position. `pairs` is read
    more than once and must give the same rows each time. Rows of one key and `ids` are one row of the greatest."""
    cols = list(dict.fromkeys([*keys, *ids]))
    both = pairs.where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL")
    both = both.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{a}`").cast("double").alias("_a"), F.col(f"`{b}`").cast("double").alias("_b"))

    def put(table: pa.Table, spots: list[Spots]) -> pa.Table:
        one, two = spots
        rank = lambda s: pa.array(s.before + (s.ties + 1) / 2.0)
        found = {"rank_a": rank(one), "rank_b": rank(two), "value_b": pa.array(two.value), "before_a": pa.array(one.before)}
        found |= {"last_a": pa.array(one.before + one.ties - 1), "n": pa.array(one.n)}
        first, _, found = once_per_row(table, cols, found)
        return pa.table([*(table.column(c).take(pa.array(first)) for c in cols), *found.values()], names=[*cols, *found])

    numbers = [("rank_a", DoubleType()), ("rank_b", DoubleType()), ("value_b", DoubleType()), ("before_a", LongType()), ("last_a", LongType()), ("n", LongType())]
    schema = StructType([*both.select(*[F.col(f"`{c}`") for c in cols]).schema.fields, *[StructField(c, t) for c, t in numbers]])
    cells = [Cell("a", "_a", tuple(keys)), Cell("b", "_b", tuple(keys))]
    return with_spots(both, cells, cols, put, schema, plan.rows_per_split, plan.max_splits)


def rank_correlation(min_pairs: int) -> Column:
    return F.expr(
        f"CASE WHEN count(*) >= {min_pairs} THEN "
        "try_divide(covar_pop(rank_a, rank_b), stddev_pop(rank_a) * stddev_pop(rank_b)) END"
    )


def top_minus_bottom(min_pairs: int) -> Column:
    """Mean of b where a is at or above its 80% quantile minus its mean at or below the 20% quantile.

    A value is at or above the interpolated quantile exactly when the last position of its tie group reaches
    the next whole position, so positions are enough and no quantile is joined back."""
    return F.expr(
        f"CASE WHEN count(*) >= {min_pairs} THEN avg(CASE WHEN last_a >= (4 * (n - 1) + 4) div 5 THEN value_b END) "
        "- avg(CASE WHEN before_a <= (n - 1) div 5 THEN value_b END) END"
    )


def grouped_spearman(
    pairs: DataFrame,
    keys: list[str],
    ids: list[str],
    a: str,
    b: str,
    min_pairs: int = 20,
    plan: SplitPlan = DEFAULT_PLAN,
) -> DataFrame:
    """Spearman per key: `n` pairs and `rho`, NULL below `min_pairs` or without variation. Keys without any
    pair are absent. `corr` is avoided because it fails on a constant column under ANSI."""
    ranks = paired_ranks(pairs, keys, ids, a, b, plan)
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), rank_correlation(min_pairs).alias("rho"))


def grouped_spread(
    pairs: DataFrame, keys: list[str], ids: list[str], a: str, b: str, min_pairs: int = 50, plan=DEFAULT_PLAN
) -> DataFrame:
    ranks = paired_ranks(pairs, keys, ids, a, b, plan)
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), top_minus_bottom(min_pairs).alias("spread"))
