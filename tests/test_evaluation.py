import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import agreement, diagnostics, evaluation, ranking
from panelwright.operators.features import ablation_sets
from panelwright.operators.models import Rule, TreeSettings, fit_ridge, fit_trees, permutation_importance, seeded_sample
from panelwright.operators.positions import SplitPlan
from panelwright.options import EvaluationOptions
from panelwright.plans import evaluate as plan
from panelwright.sources import panels


def rank_agreement(x, y, least):
    known = x.notna() & y.notna()
    if known.sum() < least or x[known].nunique() < 2 or y[known].nunique() < 2:
        return None
    return x[known].rank().corr(y[known].rank())


def same(got, want):
    return (pd.isna(got) and pd.isna(want)) or np.isclose(got, want)


def test_spread_equals_the_quantile_definition(spark):
    rng = np.random.default_rng(41)
    sizes = {"ties": 137, "plain": 90, "flat": 64, "at_least": 50, "too_few": 49}
    parts = [pd.DataFrame({"k": k, "pred": rng.normal(size=n).round(1 if k == "ties" else 8), "actual": rng.gamma(2.0, size=n)}) for k, n in sizes.items()]
    pdf = pd.concat(parts, ignore_index=True).assign(id=lambda d: d.index)
    pdf.loc[pdf["k"] == "flat", "pred"] = 0.25
    df = spark.createDataFrame(pdf)
    got = {r["k"]: r["spread"] for r in agreement.grouped_spread(df, ["k"], ["id"], "pred", "actual").collect()}
    for k, part in pdf.groupby("k"):
        high, low = part["pred"].quantile(0.8), part["pred"].quantile(0.2)
        want = part.loc[part["pred"] >= high, "actual"].mean() - part.loc[part["pred"] <= low, "actual"].mean()
        assert same(got[k], None if k == "too_few" else want), k


def test_spearman_counts_complete_pairs_only(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"id": range(160), "k": np.repeat(["w", "x", "y", "z"], 40), "a": rng.integers(0, 9, 160) * 1.0, "b": rng.normal(size=160)})
    pdf.loc[pdf["id"] % 7 == 0, "a"] = None
    pdf.loc[pdf["id"] % 5 == 1, "b"] = None
    pdf.loc[pdf["id"].between(40, 69), "b"] = None  # leaves under 20 pairs in x
    df = spark.createDataFrame(pdf).selectExpr("id", "k", "nullif(a, double('NaN')) as a", "nullif(b, double('NaN')) as b")
    got = {r["k"]: r for r in agreement.grouped_spearman(df, ["k"], ["id"], "a", "b").collect()}
    for k, part in pdf.groupby("k"):
        assert got[k]["n"] == part.dropna().shape[0]
        assert same(got[k]["rho"], rank_agreement(part["a"], part["b"], 20)), k
    assert got["x"]["rho"] is None and got["w"]["rho"] is not None


def test_folds_equal_a_count_by_hand(spark):
    rng = np.random.default_rng(43)
    rows = []
    for e in range(9):
        for y in range(1990, 2004):
            one = None if y == 1999 or rng.random() < 0.2 else float(rng.normal())
            three = None if y > 2000 or rng.random() < 0.2 else float(rng.normal())
            rows.append((e, y, bool(rng.random() < 0.8), one, three))
    df = spark.createDataFrame(rows, "entity int, origin_year int, group_ok boolean, target_1y double, target_3y double")
    want = {}
    for place, h in ((3, 1), (4, 3)):
        used = [r[1] for r in rows if r[2] and r[place] is not None]
        for t in range(1994, 2004):
            train, test = sum(y + h <= t for y in used), used.count(t)
            if train and test:
                want[h, t] = (train, test)
    got = {(r["horizon"], r["test_year"]): (r["n_train"], r["n_test"]) for r in evaluation.walk_forward_folds(df, (1, 3), 1994).collect()}
    assert got == want and (1, 1999) not in got and (3, 2001) not in got


def test_rules_are_formulas_of_one_row(spark):
    row = spark.sql("select 0.3d as mom_2y_rel, -0.1d as mom_4y_rel, 0.7d as level_rel_group, -0.2d as nbr_level_gap, 1.5d as beta, 0.04d as group_mom_2y")
    got = row.select(*[rule().alias(name) for name, rule in evaluation.baselines(2, 4).items()]).first().asDict()
    want = {"momentum_2y": 0.3, "momentum_4y": -0.1, "catch_up_price": -0.7, "catch_up_neighbours": 0.2, "beta_x_group_trend": 0.06}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def scores(spark, rows):
    schema = "horizon int, model string, test_year int, spearman_focus double, spearman_national double"
    return spark.createDataFrame(rows, schema)


def test_summary_equals_a_comparison_by_hand(spark):
    rng = np.random.default_rng(44)
    names = list(evaluation.baselines())
    rows = [
        (h, m, y, None if rng.random() < 0.25 else float(rng.uniform(-1, 1)), float(rng.uniform(-1, 1)))
        for h in (1, 2, 3) for m in ["gbm_national", *names[:3]] for y in range(1980, 1993) if rng.random() < 0.9
        if (h, m) != (3, "gbm_national")
    ]
    pdf = pd.DataFrame(rows, columns=["horizon", "model", "year", "focus", "national"])
    got = evaluation.summarize(scores(spark, rows), names, draws=20).toPandas().set_index(["horizon", "model"])
    for h, part in pdf.groupby("horizon"):
        table = part.pivot(index="year", columns="model", values="focus").astype(float)
        for m in table:
            assert got.loc[(h, m), "n_folds"] == (part["model"] == m).sum()
            assert np.isclose(got.loc[(h, m), "spearman_focus_mean"], table[m].mean())
            assert np.isclose(got.loc[(h, m), "spearman_national_min"], part.loc[part["model"] == m, "national"].min())
            if m != "gbm_national":
                assert got.loc[(h, m), "best_baseline"] is None
        if h == 3:  # the model was not run there
            continue
        best = table[names[:3]].mean().idxmax()
        gap = (table["gbm_national"] - table[best]).dropna()
        r = got.loc[(h, "gbm_national")]
        assert r["best_baseline"] == best and r["folds_compared"] == len(gap) and r["folds_model_beats_best"] == (gap > 0).sum()
        assert np.isclose(r["gap_vs_best"], gap.mean())


def interval(spark, values, block, draws=300, seed=19):
    rows = [(block, "m", 1970 + i, v, 0.0) for i, v in enumerate(values)]
    table = scores(spark, rows).repartition(3)
    got = evaluation.block_bootstrap(table, ["horizon"], "spearman_focus", "test_year", F.col("horizon"), draws, 0.8, seed).collect()
    return (got[0]["ci_low"], got[0]["ci_high"]) if got else (None, None)


def drawn_interval(values, block, draws=300, seed=19):
    """The same draws one by one: block starts from digests, circular blocks, the mean of as many values as there are."""
    v = [x for x in values if x is not None]
    means = []
    for draw in range(draws):
        starts = [int(hashlib.md5(f"{seed}|{draw}|{b}".encode()).hexdigest()[:8], 16) for b in range(-(-len(v) // block))]
        means.append(np.mean([v[(s + k) % len(v)] for s in starts for k in range(block)][: len(v)]))
    return np.quantile(means, [0.1, 0.9])


@pytest.mark.parametrize("block", [1, 3, 5])
def test_bootstrap_equals_the_draws_one_by_one(spark, block):
    values = [*np.random.default_rng(45).normal(0.1, 0.3, 11).tolist(), None]
    np.testing.assert_allclose(interval(spark, values, block), drawn_interval(values, block), atol=1e-12)


def test_bootstrap_bounds_at_its_limits(spark):
    assert np.allclose(interval(spark, [0.625] * 6, 3), 0.625)  # as many values as two blocks hold
    assert interval(spark, [0.625] * 6, 4) == (None, None)
    assert interval(spark, [0.1, 0.2, None, None], 1) == (None, None)
    assert interval(spark, [None, None], 1) == (None, None)


def test_scores_equal_each_scope_by_hand(spark):
    rng = np.random.default_rng(46)
    n = 260
    pdf = pd.DataFrame({"horizon": 2, "test_year": 1988, "model": "m", "entity": range(n), "in_focus": rng.random(n) < 0.6,
                        "sub": rng.choice(["north", "south", "west", "rare"], n, p=[0.4, 0.3, 0.25, 0.05]), "pred": rng.normal(size=n).round(1)})
    pdf["actual"] = pdf["pred"] * pdf["sub"].map({"north": 1.0, "south": -1.0, "west": 0.3, "rare": 5.0}) + rng.normal(size=n)
    pdf.loc[pdf["sub"] == "west", "sub"] = None  # without a name they are a subgroup of their own
    kinds = "horizon int, test_year int, model string, entity int, in_focus boolean, sub string, pred double, actual double"
    rows = [tuple(None if c == "sub" and pd.isna(x) else x for c, x in zip(pdf.columns, r)) for r in pdf.itertuples(index=False, name=None)]
    r = evaluation.score(spark.createDataFrame(rows, ", ".join(kinds.split(", ")))).first()
    focus = pdf[pdf["in_focus"]]
    within = [rank_agreement(p["pred"], p["actual"], 20) for _, p in focus.groupby(focus["sub"].fillna(""))]
    assert None in within and sum(x is not None for x in within) == 3
    assert np.isclose(r["spearman_focus_within_sub"], np.mean([x for x in within if x is not None]))
    assert np.isclose(r["spearman_national"], rank_agreement(pdf["pred"], pdf["actual"], 20))
    assert np.isclose(r["spearman_focus"], rank_agreement(focus["pred"], focus["actual"], 20))
    assert (r["n_test"], r["n_test_focus"]) == (n, len(focus))


def test_a_model_without_any_prediction_keeps_its_row(spark):
    rows = [(1, 2015, "m", i, "s", True, None, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "horizon int, test_year int, model string, entity int, sub string, in_focus boolean, pred double, actual double")
    r = evaluation.score(df).first()
    assert r["n_test"] == 30 and r["spearman_national"] is None


def test_beta_history_equals_each_split_by_hand(spark):
    rng = np.random.default_rng(47)
    moves = {("p", 1981): 0.06, ("q", 1981): -0.03, ("r", 1981): 0.02, ("p", 1982): -0.01, ("q", 1982): 0.0, ("r", 1982): 0.05}
    parts = []
    for (grp, year), move in moves.items():
        n = 35 if grp == "q" else 27
        relative = rng.normal(0, 0.02, n)
        parts.append(pd.DataFrame({"entity": [f"{grp}{i}" for i in range(n)], "origin_year": year, "grp": grp, "group_ok": grp != "r",
                                   "in_focus": grp == "p", "beta": 1 + 10 * relative + rng.normal(0, 0.3, n), "target_1y": relative, "move": move}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf["fwd_1y"] = pdf["target_1y"] + pdf["move"]
    # Sums of floats: growth that is meant to be 0 is set so exactly.
    pdf.loc[pdf["move"] == 0, "fwd_1y"] = pdf["target_1y"]
    got = diagnostics.beta_history(spark.createDataFrame(pdf.drop(columns="move"))).toPandas().set_index("origin_year")
    for year, part in pdf[pdf["group_ok"]].groupby("origin_year"):
        r = got.loc[year]
        for name, rows in {"all": part, "up_groups": part[part["move"] > 0], "down_groups": part[part["move"] < 0], "focus": part[part["in_focus"]]}.items():
            assert same(r[f"beta_spearman_{name}"], rank_agreement(rows["beta"], rows["target_1y"], 20)), (year, name)
        assert r["n"] == len(part) and np.isclose(r["share_in_rising_groups"], (part["move"] > 0).mean())
        assert np.isclose(r["focus_group_growth"], moves["p", year])
    assert np.isnan(got.loc[1982, "beta_spearman_up_groups"])


def test_ablation_summary(spark):
    df = spark.createDataFrame([(2010, 0.5, 0.4, 0.5), (2011, 0.1, 0.3, 0.1)], "test_year int, full double, a double, b double")
    got = evaluation.ablation_summary(df, ["full", "a", "b"]).toPandas().set_index("variant")
    assert np.isclose(got.loc["a", "change"], -0.05) and got.loc["a", ["helped", "changed"]].tolist() == [1, 2]
    assert got.loc["b", "changed"] == 0 and np.isnan(got.loc["full", "helped"])


def test_a_stamp_holds_until_the_last_origin_moves(spark):
    panel = spark.sql("select explode(sequence(date'1991-03-31', date'1996-03-31', interval 1 year)) as origin")
    stamped = evaluation.stamp_origin(spark.range(3), panel)
    assert evaluation.is_fresh(stamped, panel)
    assert evaluation.is_fresh(stamped, panel.where("origin > date'1994-01-01'"))  # the beginning does not matter
    assert not evaluation.is_fresh(stamped, panel.selectExpr("origin + interval 1 year as origin"))
    assert not evaluation.is_fresh(stamped, panel.where("origin < date'1994-01-01'"))
    assert not evaluation.is_fresh(stamped.limit(0), panel) and not evaluation.is_fresh(spark.range(3), panel)


@pytest.fixture(scope="module")
def listed(spark):
    """A ranked list of 23 shops, as the final ranking gives it; shop 7 has no history and shop 9 no level."""
    rng = np.random.default_rng(31)
    pdf = pd.DataFrame({"rank": range(1, 24), "score": np.sort(rng.uniform(5, 95, 23))[::-1]})
    pdf = pdf.assign(horizon=3, entity=[f"shop {i:02d}" for i in pdf["rank"]], sub=["north", "south", "west"] * 7 + ["north", "west"], city=[f"place {i % 4}" for i in pdf["rank"]])
    pdf["value"], pdf["focus_percentile"] = rng.uniform(900, 1100, 23), pdf["score"].rank(pct=True) * 100
    pdf["hist_relative_pct"], pdf["level_rel_group"], pdf["mom_4y_rel"] = rng.normal(size=23), rng.normal(size=23) / 5, rng.normal(size=23) / 9
    pdf.loc[6, "hist_relative_pct"], pdf.loc[8, "level_rel_group"] = np.nan, np.nan
    df = spark.createDataFrame(pdf)
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("hist_relative_pct", "level_rel_group")})
    return pdf, df.withColumns({"forecast_1y_pct": F.lit(None).cast("double"), "origin": F.lit("2011-03-31")})


def test_ranking_documents_hold_the_list(listed):
    pdf, df = listed
    docs = [json.loads(d["json"]) for d in panels.ranking_documents(df, chunk=10, long=4, generated=F.lit("2011-04-02")).orderBy("part").collect()]
    assert [len(d["entities"]) for d in docs] == [10, 10, 3]
    assert {(d["horizon_years"], d["origin"], d["generated"], d["n_entities"]) for d in docs} == {(3, "2011-03-31", "2011-04-02", 23)}
    entities = [e for d in docs for e in d["entities"]]
    assert [e["entity"] for e in entities] == pdf["entity"].tolist()
    for e, row in zip(entities, pdf.itertuples()):
        for name, raw in (("historical_growth_vs_group_pct", row.hist_relative_pct), ("level_vs_group_median_pct", 100 * np.expm1(row.level_rel_group)),
                          ("past_growth_vs_group_pct", 100 * np.expm1(row.mom_4y_rel)), ("score", row.score)):
            assert e[name] is None if np.isnan(raw) else abs(e[name] - raw) < 0.00501
        assert e["value"] == round(row.value) and e["forecast_1y_pct"] is None
    assert set(docs[0]["meanings"]) - {"score"} <= set(entities[0]) and "walk_forward_skill" not in docs[0]


def test_documents_take_the_final_ranking_and_fresh_skill_only(spark, training, tmp_path):
    _, df = training
    mix = df.withColumns({c: F.col("cs_a") for c in ("target_1y", "target_1y_pct", "mom_5y_rel", "level_rel_group", "value")})
    panel = mix.withColumns({"group_ok": F.lit(True), "in_focus": F.col("entity") % 2 == 0, "origin": F.lit("2000-12-31").cast("date"), "sub": F.lit("s")})
    rows = plan.rank_focus(panel, 1, EvaluationOptions(), TreeSettings(step=0.3, trees=2, depth=2, min_rows=5, bins=16))
    summary = spark.createDataFrame([(1, "a", 0.5, 0.25, None, -0.125, 6), (1, "b", 0.0, 0.0, 0.0, 0.0, 6)],
                                    "horizon int, model string, spearman_focus_mean double, spearman_focus_ci_low double, spearman_focus_ci_high double, spearman_focus_min double, n_folds int")
    print_ = evaluation.panel_fingerprint(panel)
    for stamped, models in ((evaluation.stamp_panel(summary, panel.orderBy(F.desc("entity"))), {"a"}), (evaluation.stamp_panel(summary, panel.where("entity > 0")), None), (summary, None)):
        docs = panels.ranking_documents(rows, skill=panels.skill_map(stamped, ["a"], print_))
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        panels.write_documents(docs, path)
        (doc,) = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
        assert doc["n_entities"] == 200 and [e["rank"] for e in doc["entities"]] == list(range(1, 201))
        skill = doc.get("walk_forward_skill")
        assert (skill and set(skill)) == models
        if skill:
            assert skill["a"] == {"spearman_focus_mean": 0.5, "spearman_focus_ci90": [0.25, None], "spearman_focus_min": -0.12, "folds": 6}


def test_rank_rows_breaks_ties_by_entity(spark):
    df = spark.createDataFrame([(1, "c", 1.0), (1, "a", 2.0), (1, "b", 2.0), (1, "d", 0.5)], "horizon int, entity string, score double")
    got = ranking.rank_rows(df, ["horizon"]).orderBy("rank").toPandas()
    assert got["entity"].tolist() == ["a", "b", "c", "d"] and got["focus_percentile"].tolist() == [87.5, 87.5, 50.0, 25.0]


def test_area_lists_and_shape(listed):
    pdf, df = listed
    areas = {"cold": (["north", "west"], None), "warm": (["south"], "place 1")}
    got = ranking.area_subset(df, areas, 6).orderBy("area", "rank").toPandas()
    for area, (subs, flagged) in areas.items():
        want = pdf[pdf["sub"].isin(subs)].head(6)
        part = got[got["area"] == area]
        assert part["sub_rank"].tolist() == [1, 2, 3, 4, 5, 6] and part["rank"].tolist() == want["rank"].tolist()
        assert part["flagged"].tolist() == (want["city"] == flagged).tolist()
    ends = ranking.top_and_bottom(df, 5).toPandas()
    shape = ranking.list_shape(df, 5, growth="mom_4y_rel").toPandas().set_index("side")
    assert sorted(ends["rank"]) == [*range(1, 6), *range(19, 24)] and len(shape) == 2
    for side, part in (("top", pdf.head(5)), ("bottom", pdf.tail(5))):
        assert np.isclose(shape.loc[side, "median_growth"], part["mom_4y_rel"].median()) and shape.loc[side, "n_rows"] == 5


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(2)
    n = 400
    x = rng.uniform(size=(n, 3))
    pdf = pd.DataFrame({"entity": range(n), "midx": 0, "origin_year": 2000, "cs_a": x[:, 0], "cs_b": x[:, 1], "rg_c": x[:, 2] - 0.5, "cs_dead": 1.0})
    pdf["label"] = 0.6 * x[:, 0] - 0.3 * x[:, 1] + 0.1 * rng.normal(size=n)
    pdf.loc[::7, "cs_b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("cs_b", F.when(~F.isnan("cs_b"), F.col("cs_b")))
    return pdf, df.cache()


def test_ridge_equals_the_closed_form(training):
    pdf, df = training
    fitted = fit_ridge(df, ["cs_a", "cs_b", "rg_c", "cs_dead"], "label")
    assert fitted.features == ("cs_a", "cs_b", "rg_c")
    x = pdf[["cs_a", "cs_b", "rg_c"]].copy()
    x = x.fillna(x.median())
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    y = pdf["label"].to_numpy()
    coef = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    want = z @ coef + y.mean()
    got = fitted.predict(df).orderBy("entity").toPandas()["pred"]
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_trees_learn_and_importance_finds_the_feature(training):
    pdf, df = training
    fitted = fit_trees(df, ["cs_a", "cs_b", "rg_c", "cs_dead"], "label", TreeSettings(step=0.3, trees=4, depth=3, min_rows=5, bins=32))
    assert "cs_dead" not in fitted.features
    got = fitted.predict(df).toPandas()
    assert got["pred"].corr(got["label"]) > 0.8
    imp = permutation_importance(fitted, df, "label", ["entity", "midx"], repeats=2).toPandas().set_index("feature")
    assert imp["importance_mean"].idxmax() == "cs_a" and imp.loc["cs_a", "importance_mean"] > 0


class Doubled:
    """A model that knows one of its two features."""

    features = ("x", "other")

    def predict(self, df):
        return df.withColumn("pred", 2 * F.col("x"))


def test_importance_shuffles_all_rows_however_they_are_cut(spark):
    pdf = pd.DataFrame({"entity": range(600), "x": np.arange(600) % 2 * 1.0, "other": np.random.default_rng(48).normal(size=600)})
    df = spark.createDataFrame(pdf.assign(label=2 * pdf["x"])).withColumn("label", F.expr("if(entity < 40, null, label)"))
    whole, cut = [
        permutation_importance(Doubled(), df, "label", ["entity"], repeats=4, plan=plan).toPandas().set_index("feature")
        for plan in (SplitPlan(), SplitPlan(100, 64, 3))
    ]
    pd.testing.assert_frame_equal(whole.sort_index(), cut.sort_index())
    assert whole.loc["other"].tolist() == [0, 0]
    # Half of the pairs differ by 1, so half of the errors are 4.
    assert abs(whole.loc["x", "importance_mean"] - 2) < 0.25 and whole.loc["x", "importance_std"] > 0
    assert permutation_importance(Doubled(), df.where("label is null"), "label", ["entity"]).count() == 0


def test_sample_is_exact_and_repeatable(spark):
    a = seeded_sample(spark.range(1000), ["id"], 100).toPandas()["id"].tolist()
    assert len(a) == 100 and a == seeded_sample(spark.range(1000).repartition(7), ["id"], 100).toPandas()["id"].tolist()


def test_ablation_sets_drop_one_group_each():
    sets = ablation_sets(["cs_beta", "rg_x", "cs_mom_1y", "cs_inventory_yoy"])
    assert sets["without_beta"] == ["rg_x", "cs_mom_1y", "cs_inventory_yoy"] and sets["without_all_groups"] == ["cs_mom_1y"]


def test_ridge_query_has_every_horizon_and_fold(spark):
    import __spark_entry__ as registry
    from checks import views
    from panelwright.plans import evaluate as plan

    sf = "/root/testdata/sf0.01"
    rows = registry.queries()["m_ridge_predictions"](spark, sf)
    panel = views.written_panel(spark, sf)
    want = {(h, y) for h in views.EVAL.horizons for y in plan.fold_list(panel, h, views.EVAL.first_test_year)}
    assert {(r.horizon, r.test_year) for r in rows.select("horizon", "test_year").distinct().collect()} == want and len(want) > 4


def test_importance_of_a_stump_is_the_error_of_its_exchanged_rows(spark):
    import hashlib

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"entity": range(300), "x": rng.normal(size=300), "z": rng.normal(size=300)})
    pdf.loc[::7, "x"] = np.nan
    pdf["label"] = np.where(pdf["x"] > 0.2, 1.0, 0.0) + pdf["z"] / 10
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    stump = Rule(F.when(F.col("x") > 0.2, 1.0).otherwise(0.0), ("x", "z"))
    got = permutation_importance(stump, df, "label", ["entity"], repeats=3, plan=SplitPlan(50, 16, 2)).toPandas().set_index("feature")
    rises = []
    for repeat in range(3):
        order = sorted(range(300), key=lambda e: hashlib.md5(f"7|{repeat}|{e}".encode()).hexdigest())
        pred = np.where(pdf["x"].to_numpy()[order] > 0.2, 1.0, 0.0)
        rises.append(((pred - pdf["label"]) ** 2).mean() - ((pdf["z"] / 10) ** 2).mean())
    np.testing.assert_allclose(got.loc["x"], [np.mean(rises), np.std(rises)], atol=1e-12)
    assert got.loc["z"].abs().max() < 1e-12
