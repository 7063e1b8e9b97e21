import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import agreement, groups, history, macro, neighbours, vintages
from panelwright.operators.features import FEATURE_GROUPS, model_features, ranked_columns, usable_features
from panelwright.operators.positions import SplitPlan
from panelwright.options import PanelOptions
from panelwright.plans.panel import PanelInputs, build_panel


def midx(year, month):
    return year * 12 + month - 1


@pytest.fixture(scope="module")
def walks(spark):
    """(rows, table): random walks of five entities up to September 1994, an eighth of the months absent."""
    rng = np.random.default_rng(61)
    months = range(midx(1985, 4), midx(1994, 9) + 1)
    level = np.exp(np.cumsum(rng.normal(0, 0.05, (5, len(months))), axis=1))
    rows = {(f"e{i}", m): float(level[i, j]) for i in range(5) for j, m in enumerate(months) if m == months[-1] or rng.random() > 0.125}
    return rows, spark.createDataFrame([(e, m, v) for (e, m), v in rows.items()], "entity string, midx int, value double")


def test_origins_keep_the_calendar_month_of_the_end(walks):
    rows, table = walks
    got = {(r["midx"], r["origin"], r["origin_year"]) for r in history.origins(table, 1988).collect()}
    held = {m for _, m in rows}
    assert got == {(midx(y, 9), dt.date(y, 9, 30), y) for y in range(1988, 1995) if midx(y, 9) in held}


def test_changes_equal_a_lookup_by_hand(walks):
    rows, table = walks
    got = history.value_history(table, (1, 4), (2,), 3).toPandas().set_index(["entity", "midx"])
    assert set(got.index) == set(rows)

    def change(e, a, b):
        return np.log(rows[e, b]) - np.log(rows[e, a]) if (e, a) in rows and (e, b) in rows else np.nan

    for (e, m), r in got.iterrows():
        want = [change(e, m - 12, m), change(e, m - 48, m), change(e, m, m + 24), *[change(e, m - 12 * k - 12, m - 12 * k) for k in range(3)]]
        np.testing.assert_allclose(r[["mom_1y", "mom_4y", "fwd_2y", "_growth_0", "_growth_1", "_growth_2"]].astype(float), want, atol=1e-12)


def test_demean_by_two_keys_leaves_gaps_alone(spark):
    rng = np.random.default_rng(62)
    pdf = pd.DataFrame({"id": range(90), "g": rng.integers(0, 4, 90), "h": rng.choice(["u", "v"], 90), "a": rng.normal(size=90), "b": rng.normal(size=90)})
    pdf.loc[::11, "a"] = None
    df = spark.createDataFrame(pdf).withColumn("a", F.expr("nullif(a, double('NaN'))"))
    got = groups.demean(df, ["g", "h"], {"x": "a", "y": "b"}).orderBy("id").toPandas()
    by = pdf.groupby(["g", "h"])
    np.testing.assert_allclose(got["x"].astype(float), pdf["a"] - by["a"].transform("mean"), atol=1e-12)
    np.testing.assert_allclose(got["y"], pdf["b"] - by["b"].transform("mean"), atol=1e-12)


@pytest.mark.parametrize("lag", [0, 1, 3])
def test_asof_vintage_equals_a_search(spark, lag):
    origins, vintage = [1978, 1980, 1981, 1985, 1999], [1977, 1980, 1982, 1984]
    table = spark.createDataFrame([(y,) for y in origins], "origin_year int")
    held = spark.createDataFrame([(y,) for y in vintage * 2], "vintage int")
    got = {r["origin_year"]: r["vintage"] for r in vintages.vintage_asof(table, held, lag).collect()}
    assert got == {y: max((v for v in vintage if v <= y - lag), default=None) for y in origins}


def test_beta_equals_a_least_squares_line(spark):
    rng = np.random.default_rng(63)
    years, entities = range(1970, 1988), [f"{g}{i}" for g in "ab" for i in range(5)]
    level = {e: np.cumsum(rng.normal(0.02, 0.05, len(years))) for e in entities}
    value = {(e, y): float(level[e][i]) for e in entities for i, y in enumerate(years) if (e, y) not in {("a1", 1983), ("b3", 1987), ("b0", 1979)}}
    series = spark.createDataFrame([(e, midx(y, 6), float(np.exp(v))) for (e, y), v in value.items()], "entity string, midx int, value double")
    meta = spark.createDataFrame([(e, e[0], None) for e in entities], "entity string, grp string, sub string")
    opt = PanelOptions(horizons=(1,), beta_window=7, beta_min=5)
    base = history.panel_base(history.value_history(series, opt.lags, opt.horizons, 7), history.origins(series, 1970), meta)
    got = groups.group_features(base, opt).toPandas().set_index(["entity", "origin_year"])["beta"]
    assert len(got) == len(value)

    def growth(e, y):
        return value[e, y] - value[e, y - 1] if (e, y) in value and (e, y - 1) in value else np.nan

    for (e, y), beta in got.items():
        mates = [m for m in entities if m[0] == e[0] and (m, y) in value]
        own = np.array([growth(e, y - k) for k in range(7)])
        table = np.array([[growth(m, y - k) for m in mates] for k in range(7)])
        mean = np.array([np.nanmean(r) if np.isfinite(r).any() else np.nan for r in table])
        known = np.isfinite(own) & np.isfinite(mean)
        want = np.polyfit(mean[known], own[known], 1)[0] if known.sum() >= 5 else np.nan
        np.testing.assert_allclose(float("nan") if beta is None else beta, want, rtol=1e-8, err_msg=f"{e} {y}")


@pytest.mark.parametrize("plan", [SplitPlan(), SplitPlan(3, 16, 2)])
def test_grouped_spearman_equals_ranks_in_pandas(spark, plan):
    rng = np.random.default_rng(64)
    sizes = [7, 8, 23, 61, 110]
    pdf = pd.DataFrame({"g": np.repeat(range(5), sizes)})
    pdf["a"] = rng.integers(0, 12, len(pdf)) * 0.5
    pdf["b"] = rng.poisson(3, len(pdf)) - pdf["g"] * pdf["a"] / 3
    pdf["id"] = range(len(pdf))
    pdf.loc[pdf["g"] == 2, "b"] = -4.0
    got = {r["g"]: r["rho"] for r in agreement.grouped_spearman(spark.createDataFrame(pdf), ["g"], ["id"], "a", "b", 8, plan).collect()}
    assert got[0] is None and got[2] is None  # too few, and no variation
    for g in (1, 3, 4):
        part = pdf[pdf["g"] == g]
        assert np.isclose(got[g], part["a"].rank().corr(part["b"].rank()))


def test_national_median_and_rolling_deviation(spark, walks):
    rows, table = walks
    natl = macro.national_log_median(table)
    dev = macro.rolling_deviation(natl.withColumn("s", F.lit(1)), "natl", "dev", 10, 4, by=("s",)).orderBy("midx").toPandas()
    months = sorted({m for _, m in rows})
    median = pd.Series([np.log(np.median([v for (_, k), v in rows.items() if k == m])) for m in months], index=months)
    assert dev["midx"].tolist() == months
    np.testing.assert_allclose(dev["natl"].astype(float), median, atol=1e-12)
    whole = median.reindex(range(months[0], months[-1] + 1))
    want = (whole - whole.rolling(10, min_periods=4).mean()).loc[months]
    np.testing.assert_allclose(dev["dev"].to_numpy(dtype=float), want.to_numpy(), atol=1e-12)


def brute_force(points, k):
    out = {}
    lat, lon = np.radians(points["lat"].to_numpy()), np.radians(points["lon"].to_numpy())
    for i in range(len(points)):
        h = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat) * np.cos(lat[i]) * np.sin((lon - lon[i]) / 2) ** 2
        d = np.round(2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1))), 6)
        order = sorted((d[j], points["entity"].iloc[j]) for j in range(len(points)) if j != i)
        out[points["entity"].iloc[i]] = [e for _, e in order[:k]]
    return out


def test_nearest_is_exact_at_poles_date_line_and_hot_spots(spark):
    rng = np.random.default_rng(5)
    n = 400
    lat, lon = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    lat[:130], lon[:130] = 40.0, -74.0  # a third of all entities at one spot
    lat[130:190], lon[130:190] = 40 + rng.normal(0, 0.01, 60), -74 + rng.normal(0, 0.01, 60)
    lat[190:210] = 89.9
    lon[210:230] = np.where(rng.random(20) < 0.5, 179.95, -179.95)
    lat[210:230] = rng.uniform(-5, 5, 20)
    pdf = pd.DataFrame({"entity": np.arange(n), "lat": lat, "lon": lon})
    df = spark.createDataFrame(pdf).withColumn("key", F.lit(1))
    got = neighbours.nearest(df, 10, ["key"]).toPandas()
    want = brute_force(pdf, 10)
    assert len(got) == n
    for _, row in got.iterrows():
        assert [x["entity"] for x in row["neighbours"]] == want[row["entity"]]


def test_too_few_points_have_no_neighbours(spark):
    df = spark.createDataFrame([(i, float(i), 0.0, 1) for i in range(10)], "entity int, lat double, lon double, key int")
    assert neighbours.nearest(df, 10, ["key"]).count() == 0


OPT = PanelOptions(lags=(1, 2, 3), rent_lag=1, horizons=(1, 2), beta_window=4, beta_min=3, min_group=5, focus_group="g0",
                   neighbours=3, macro_window=24, macro_min=6, min_pairs=5)


def world(spark, last_year=2008):
    """40 entities in two groups, monthly, with rent, tempo, macro, coordinates and attributes."""
    rng = np.random.default_rng(11)
    months = range(midx(2000, 1), midx(last_year, 12) + 1)
    shocks = {e: rng.normal(0.003, 0.02, len(range(midx(2000, 1), midx(2008, 12) + 1))) for e in range(40)}
    rows = []
    for e in range(40):
        level = 100 * (1 + e % 7) * np.exp(np.cumsum(shocks[e]))
        rows += [(f"{e:05d}", m, float(v)) for m, v in zip(months, level)]
    series = spark.createDataFrame(rows, "entity string, midx int, value double")
    meta = spark.createDataFrame(
        [(f"{e:05d}", f"g{e % 2}", f"s{e % 4}" if e % 8 else None) for e in range(40)], "entity string, grp string, sub string")
    coords = spark.createDataFrame([(f"{e:05d}", 40 + e % 6 * 0.1, -74 + e // 6 * 0.1) for e in range(40)], "entity string, lat double, lon double")
    rent = series.withColumn("value", F.col("value") / 200 + F.col("midx") % 7)
    monthly = series.select("midx").distinct()
    rate = monthly.withColumn("value", 3.0 + F.col("midx") % 5)
    attrs = spark.createDataFrame(
        [(f"{e:05d}", v, float(10 + e + v % 5), 0.5 + e / 100) for e in range(40) for v in range(1998, 2008)],
        "entity string, vintage int, log_income double, bachelors_share double")
    names = ("log_pop", "log_attr_rent", "log_housing_units", "median_age", "young_adult_share", "owner_share", "inflow_share")
    attrs = attrs.select("*", *[(F.col("log_income") + i).alias(n) for i, n in enumerate(names)])
    tempo = {"inventory": rent, "new_listings": rent.withColumn("value", F.col("value") + 1)}
    return PanelInputs(series, meta, rent, tempo, rate, rate, coords, attrs)


@pytest.fixture(scope="module")
def panel(spark):
    return build_panel(world(spark), OPT).cache()


def test_panel_invariants(panel):
    pdf = panel.toPandas()
    assert len(pdf) == 40 * 9 and pdf.groupby("entity").size().eq(9).all()
    ranked = [c for c in pdf if c.startswith("cs_") or c.endswith("_pct")]
    values = pdf[ranked].astype(float)
    assert ((values > 0) & (values <= 1) | values.isna()).all().all()
    for c in ("mom_1y_rel", "target_1y", "rent_yield_rel", "price_to_income_rel", "d5_log_income_rel"):
        assert np.allclose(pdf.groupby(["origin", "grp"])[c].mean().dropna(), 0, atol=1e-9)
    for c in ("log_value", "beta", "inventory_yoy", "nbr_level_gap"):
        want = pdf.groupby(["origin", "grp"])[c].rank(pct=True)
        np.testing.assert_allclose(pdf[f"cs_{c}"].astype(float), want, rtol=1e-12)
    sub = pdf.groupby(["origin", "grp", pdf["sub"].fillna("")])["fwd_1y"].rank(pct=True)
    np.testing.assert_allclose(pdf["target_1y_sub_pct"].astype(float), sub, rtol=1e-12)


def test_outcomes_never_become_features(panel):
    assert not [c for c in model_features(panel) if "fwd" in c or "target" in c]
    assert not [c for c in ranked_columns(panel) if c.startswith(("fwd_", "target_", "cs_", "group_", "rg_")) or c.endswith("_rel")]


def test_feature_groups_of_a_panel_do_not_overlap(panel):
    features = model_features(panel)
    held = {name: {f for f in features if member(f)} for name, member in FEATURE_GROUPS.items()}
    assert all(held.values()) and sum(map(len, held.values())) == len(set.union(*held.values())) < len(features)
    assert held["regime"] == {f for f in features if not f.startswith("cs_")} and held["beta"] == {"cs_beta"}


def test_features_at_an_origin_do_not_change_when_later_data_arrives(spark, panel):
    earlier = build_panel(world(spark, 2006), OPT)
    cols = ["entity", "origin_year", *[c for c in model_features(earlier) if c in panel.columns]]
    a = earlier.select(cols).where("origin_year = 2006").toPandas().sort_values("entity").reset_index(drop=True)
    b = panel.select(cols).where("origin_year = 2006").toPandas().sort_values("entity").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)


def test_absent_sources_leave_null_columns(spark, panel):
    full = world(spark, 2003)
    bare = build_panel(PanelInputs(full.series, full.meta), OPT)
    for c in ("inventory_yoy", "rg_rate_level", "rent_yield_rel", "nbr_dist_km"):
        assert c in bare.columns and bare.where(F.col(c).isNotNull()).count() == 0


def test_usable_features_need_two_values(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None), (1.0, None, None)], "a double, b double, c double")
    assert usable_features(df, ["a", "b", "c"]) == ["b"]
