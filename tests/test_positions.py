import numpy as np
import pandas as pd
import pytest
from panelwright.session import cut_lineage
from pyspark.sql import functions as F

from panelwright.operators.positions import (
    SplitPlan,
    add_percentiles,
    quantiles,
    with_positions,
    with_row_number,
)

PLANS = [SplitPlan(), SplitPlan(rows_per_split=4, max_splits=16, tie_salts=3), SplitPlan(7, 200, 2)]


@pytest.fixture(scope="module")
def rows():
    """One key holds two thirds of the rows and one value a third of those."""
    rng = np.random.default_rng(0)
    n = 1500
    key = np.where(rng.random(n) < 0.66, "hot", rng.choice(list("abcd"), n))
    value = np.where(rng.random(n) < 0.33, 0.0, np.round(rng.normal(size=n), 1))
    value[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"id": np.arange(n), "key": key, "value": value})


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows)
    return df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@pytest.mark.parametrize("plan", PLANS)
def test_percentiles_equal_the_library_rank(table, rows, plan):
    got = add_percentiles(table, ["key"], ["id"], {"p": "value"}, plan).toPandas().sort_values("id")
    want = rows.groupby("key")["value"].rank(pct=True)
    np.testing.assert_allclose(got["p"].to_numpy(dtype=float), want.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("plan", PLANS)
def test_quantiles_interpolate(table, rows, plan):
    got = (
        quantiles(table, ["key"], "value", ["id"], {"q20": (1, 5), "med": (1, 2), "q80": (4, 5)}, plan)
        .toPandas()
        .set_index("key")
        .sort_index()
    )
    want = rows.groupby("key")["value"].quantile([0.2, 0.5, 0.8]).unstack()
    np.testing.assert_allclose(got[["q20", "med", "q80"]].to_numpy(), want.to_numpy(), atol=1e-12)


@pytest.mark.parametrize("plan", PLANS)
def test_row_numbers_are_a_full_order(table, rows, plan):
    df = table.where("value is not null")
    got = with_row_number(df, ["key"], ["-value", "id"], ["id"], "rank", plan).toPandas()
    ordered = got.sort_values(["key", "rank"])
    want = got.sort_values(["key", "value", "id"], ascending=[True, False, True])
    assert ordered["id"].tolist() == want["id"].tolist()
    for _, one in ordered.groupby("key"):
        assert one["rank"].tolist() == list(range(1, len(one) + 1))


def test_a_large_key_is_cut_and_a_heavy_tie_is_spread(spark, table):
    from panelwright.operators.positions import _SPLIT, _fill

    known = table.where("value is not null")
    text = "WITH known AS (SELECT * FROM {rows}), <split> SELECT * FROM placed"
    placed = spark.sql(_fill(text, known, ["key"], "value", ["id"], PLANS[1]), rows=known)
    sizes = placed.groupBy("key", "_range", "_salt").count().where("key = 'hot'").toPandas()
    total = int(sizes["count"].sum())
    assert sizes["count"].max() < total / 3
    assert len(sizes[sizes["_range"] % 2 == 1]) > 1


def test_positions_of_an_all_null_column_are_empty(spark):
    df = spark.createDataFrame([(1, "k", None)], "id long, key string, value double")
    assert with_positions(df, ["key"], "value", ["id"]).count() == 0


def test_a_null_key_is_cut_like_any_other(spark, table, rows):
    df = table.withColumn("key", F.when(F.col("key") != "hot", F.col("key")))
    got = add_percentiles(df, ["key"], ["id"], {"p": "value"}, PLANS[1]).toPandas().sort_values("id")
    want = rows.groupby("key")["value"].rank(pct=True)
    np.testing.assert_allclose(got["p"].to_numpy(dtype=float), want.to_numpy(), rtol=1e-12)
    ordered = with_row_number(df.where("key is null"), ["key"], ["id"], ["id"], "at", PLANS[1]).toPandas().sort_values("id")
    assert ordered["at"].tolist() == list(range(1, len(ordered) + 1))


def test_wide_rows_are_neither_long_nor_sorted_by_key(spark):
    """Cells travel as arrays: no window and no pivot, and one shuffle of the rows that both sides use."""
    rows = cut_lineage(spark.range(200).selectExpr("id", "id % 3 as k", "id % 7 as a", "nullif(id % 5, 0) as b"))
    out = add_percentiles(rows, ["k"], ["id"], {"pa": "a", "pb": "b"}, SplitPlan(16, 8, 4))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rank(" not in plan and "max(CASE" not in plan
    assert out.where("pb is null").count() == 40


def test_cut_keys_repeated_and_null_ids_and_odd_values(spark):
    """Rows of one id share the greatest of their percentiles, rows without an id have none; NaN is above all, NULL is a key."""
    given = [(1, "x", 1.0), (1, "x", 3.0), (2, "x", float("nan")), (None, "x", 2.0), (3, None, -0.0), (4, None, 0.0), (5, None, None)]
    rows = cut_lineage(spark.createDataFrame(given, "id long, k string, v double"))
    for plan in (SplitPlan(), SplitPlan(1, 4, 2)):
        found = {(r["id"], r["k"]): r["p"] for r in add_percentiles(rows, ["k"], ["id"], {"p": "v"}, plan).collect()}
        assert found == {(1, "x"): 0.75, (2, "x"): 1.0, (None, "x"): None, (3, None): 0.75, (4, None): 0.75, (5, None): None}
