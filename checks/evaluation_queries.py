"""Rules, folds, scores, intervals, histories, models and ranked lists."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import views as V
from checks.sqltext import BLOCKS, HORIZONS, bootstrap_block, pct, r, spearman, sql
from panelwright.operators import agreement, diagnostics, evaluation, gram, neighbours, ranking
from panelwright.operators.models import Rule, TreeSettings, permutation_importance, seeded_sample
from panelwright.plans import evaluate as plan
from panelwright.plans import fits
from panelwright.plans.panel import add_ranks
from panelwright.session import cut_lineage, settle
from panelwright.sources import panels

Q, O = {}, {}
SMALL_TREES = TreeSettings(step=0.3, trees=3, depth=4, min_rows=20, bins=64)
RULES = {n: f for n, f in evaluation.baselines(1, 3).items() if n != "catch_up_neighbours"}


def query(name: str, oracle: str | None = None):
    def register(fn):
        Q[name] = fn
        if oracle is not None:
            O[name] = oracle
        return fn

    return register


def predictions(spark, sf):
    """Rule predictions of all horizons and folds from a written panel."""
    rows = V.written_panel(spark, sf)
    folds = evaluation.walk_forward_folds(rows, V.EVAL.horizons, V.EVAL.first_test_year)
    preds = evaluation.rule_predictions(rows, V.EVAL.horizons, RULES, V.EVAL.first_test_year)
    return preds.join(folds, ["horizon", "test_year"], "left_semi")


def scores(spark, sf):
    return evaluation.score(cut_lineage(predictions(spark, sf)))


def written_scores(spark, sf):
    return cut_lineage(scores(spark, sf))


_horizon = "cast(horizon as integer) as horizon"
_fold = f"{_horizon}, cast(test_year as integer) as test_year"


@query("e_walk_forward_folds", sql(f"select {_fold}, cast(n_train as bigint) as n_train, n_test from folds"))
def _(spark, sf):
    return evaluation.walk_forward_folds(V.panel(spark, sf), V.EVAL.horizons, V.EVAL.first_test_year)


@query("e_rule_predictions", sql(f"select entity, {_fold}, sub, in_focus, model, {r('actual')}, {r('pred')} from preds"))
def _(spark, sf):
    return V.rounded(predictions(spark, sf))


@query("e_rule_with_neighbours", sql(f"""select t.entity, {_horizon}, cast(t.test_year as integer) as test_year, {r('t.actual', 'actual')}, {r('-g.nbr_level_gap', 'pred')}
       from targets t left join nbr_gaps g on g.entity = t.entity and g.yr = t.test_year where t.horizon = 1"""))
def _(spark, sf):
    from panelwright.operators.neighbours import neighbour_gaps

    rows = V.written_panel(spark, sf)
    gaps = neighbour_gaps(rows, V.points(spark, sf), V.OPT.neighbours, "mom_3y")
    rules = {n: f for n, f in evaluation.baselines(1, 3).items() if n == "catch_up_neighbours"}
    preds = evaluation.rule_predictions(rows.join(gaps, ["entity", "midx"], "left"), (1,), rules)
    return V.rounded(preds.select("entity", "horizon", "test_year", "actual", "pred"))


@query("e_momentum_spearman", sql(f"select cast(yr as integer) as origin_year, n, {r('rho')} from ({spearman('yr', 'mom_1y_rel', 'target_1y', 'panel')})"))
def _(spark, sf):
    return V.rounded(agreement.grouped_spearman(V.written_panel(spark, sf), ["origin_year"], ["entity"], "mom_1y_rel", "target_1y"))


@query("e_quintile_spread", sql(f"""select cast(p.yr as integer) as origin_year, count(*) as n, {r('''case when count(*) >= 50 then
       avg(case when mom_1y_rel >= hi then target_1y end) - avg(case when mom_1y_rel <= lo then target_1y end) end''', 'spread')}
       from (select * from panel where mom_1y_rel is not null and target_1y is not null) p
       join (select yr, quantile_cont(mom_1y_rel, 0.8) as hi, quantile_cont(mom_1y_rel, 0.2) as lo from panel
             where mom_1y_rel is not null and target_1y is not null group by yr) q on q.yr = p.yr group by p.yr"""))
def _(spark, sf):
    return V.rounded(agreement.grouped_spread(V.written_panel(spark, sf), ["origin_year"], ["entity"], "mom_1y_rel", "target_1y"))


_metrics = ", ".join(r(m) for m in evaluation.METRICS)


@query("e_rule_scores", sql(f"select {_fold}, model, {_metrics}, cast(n_test as integer) as n_test, cast(n_test_focus as integer) as n_test_focus from scores"))
def _(spark, sf):
    return V.rounded(scores(spark, sf))


@query("e_within_subgroup", sql(f"select {_fold}, model, sub, n, {r('rho')} from rho_sub"))
def _(spark, sf):
    focus = cut_lineage(predictions(spark, sf)).where("in_focus")
    return V.rounded(agreement.grouped_spearman(focus, [*evaluation.FOLD, "sub"], ["entity"], "pred", "actual"))


@query("e_block_bootstrap", sql(f"select {_horizon}, k.model, {r('b.ci_low', 'ci_low')}, {r('b.ci_high', 'ci_high')} from "
       "(select distinct horizon, model from scores where spearman_focus is not null) k left join boot b using (horizon, model)"))
def _(spark, sf):
    rows = written_scores(spark, sf)
    return V.rounded(evaluation.block_bootstrap(rows, ["horizon", "model"], "spearman_focus", "test_year", F.col("horizon"),
                                                V.EVAL.draws, V.EVAL.level, V.EVAL.seed))


MODEL = "momentum_1y"  # stands in for the fitted model in the comparison queries, which need no fit
_others = [n for n in RULES if n != MODEL]
_best = f"""select horizon, model as best_baseline from (select horizon, model, row_number() over (partition by horizon order by avg(spearman_focus) desc, model) as i
       from scores where model <> '{MODEL}' and spearman_focus is not null group by horizon, model) where i = 1"""
_gaps = f"""select a.horizon, b.model as best_baseline, a.test_year, a.spearman_focus - b.spearman_focus as gap
       from scores a join best x on x.horizon = a.horizon join scores b on b.horizon = a.horizon and b.test_year = a.test_year and b.model = x.best_baseline
       where a.model = '{MODEL}' and a.spearman_focus is not null and b.spearman_focus is not null"""
_extra = {"best": _best, "gaps": _gaps, **bootstrap_block("gapboot", "gaps", "horizon", "gap")}


@query("e_best_baseline", sql(f"select {_horizon}, best_baseline from best", **_extra))
def _(spark, sf):
    return evaluation.best_baseline(written_scores(spark, sf), _others)


@query("e_gaps_to_best", sql(f"select {_fold}, best_baseline, {r('gap')} from gaps", **_extra))
def _(spark, sf):
    rows = written_scores(spark, sf)
    return V.rounded(evaluation.gaps_to_best(rows, evaluation.best_baseline(rows, _others), MODEL))


_means = ", ".join([r(f"avg({m})", f"{m}_mean") for m in evaluation.METRICS] + [r(f"min({m})", f"{m}_min") for m in evaluation.METRICS])


@query("e_summary", sql(f"""select cast(s.horizon as integer) as horizon, s.model, s.* exclude (horizon, model), {r('b.ci_low', 'spearman_focus_ci_low')}, {r('b.ci_high', 'spearman_focus_ci_high')},
       x.best_baseline, cast(x.wins as integer) as folds_model_beats_best, cast(x.n as integer) as folds_compared, {r('x.gap', 'gap_vs_best')},
       {r('x.ci_low', 'gap_ci_low')}, {r('x.ci_high', 'gap_ci_high')}
       from (select horizon, model, {_means}, cast(count(*) as integer) as n_folds from scores group by 1, 2) s
       left join boot b on b.horizon = s.horizon and b.model = s.model
       left join (select e.horizon, e.best_baseline, g.wins, g.n, g.gap, c.ci_low, c.ci_high from best e
                  join (select horizon, count(case when gap > 0 then 1 end) as wins, count(*) as n, avg(gap) as gap from gaps group by 1) g on g.horizon = e.horizon
                  left join gapboot c on c.horizon = e.horizon) x on x.horizon = s.horizon and s.model = '{MODEL}'""", **_extra))
def _(spark, sf):
    rows = written_scores(spark, sf)
    return V.rounded(evaluation.summarize(rows, _others, MODEL, V.EVAL.draws, V.EVAL.level, V.EVAL.seed))


@query("a_scores_by_year", sql(f"select {_fold}, " + ", ".join(r(f"max(case when model = '{m}' then spearman_focus end)", m) for m in RULES) + " from scores group by 1, 2"))
def _(spark, sf):
    return V.rounded(evaluation.scores_by_year(scores(spark, sf), list(RULES)))


_wide = "select test_year, " + ", ".join(f"max(case when model = '{m}' then spearman_focus end) as {m}" for m in RULES) + " from scores where horizon = 1 group by 1"
_long = " union all ".join(f"select '{m if m != MODEL else 'full'}' as variant, {MODEL} as f, {m} as s from yearly" for m in RULES)


@query("a_ablation_summary", sql(f"""select variant, {r('avg(s)', 'mean_score')}, {r("case when variant <> 'full' then avg(f) - avg(s) end", 'change')},
       case when variant <> 'full' then count(case when f > s then 1 end) end as helped, case when variant <> 'full' then count(case when f is distinct from s then 1 end) end as changed
       from long group by variant""", yearly=_wide, long=_long))
def _(spark, sf):
    table = evaluation.scores_by_year(scores(spark, sf), list(RULES)).where("horizon = 1").withColumnRenamed(MODEL, "full")
    return V.rounded(evaluation.ablation_summary(table, ["full", *_others]))


# ---------------------------------------------------------------- histories

FEATURES = ["level_rel_group", "mom_1y", "beta", "level_rel_sub"]
_ranked = "select p.*, " + ", ".join(f"{pct(f, 'yr, grp')} as cs_{f}" for f in FEATURES) + " from panel p"
_cells = " union all ".join(
    f"select yr, '{f}' as feature, '{s}' as scope, n, rho from ({spearman('yr', f'cs_{f}', 'target_1y', f'(select * from ranked where group_ok and {w})')})"
    for f in FEATURES for s, w in (("all", "true"), ("focus", "in_focus")))


def ranked_panel(spark, sf):
    return cut_lineage(add_ranks(V.written_panel(spark, sf), (1,)))


@query("e_factor_history", sql("select cast(u.yr as integer) as origin_year, cast(u.n as integer) as n, " + ", ".join(
    r(f"max(case when c.feature = '{f}' and c.scope = '{s}' then c.rho end)", f if s == "all" else f"{f}_focus") for f in FEATURES for s in ("all", "focus"))
    + " from (select yr, count(*) as n from panel where group_ok and target_1y is not null group by 1) u left join cells c on c.yr = u.yr group by u.yr, u.n",
    ranked=_ranked, cells=_cells))
def _(spark, sf):
    return V.rounded(diagnostics.factor_history(ranked_panel(spark, sf), 1, tuple(FEATURES)))


@query("a_sign_stability", sql(f"""select c.feature, {r('any_value(m.m)', 'mean_rho')}, {r('avg(case when sign(c.rho) = sign(m.m) then 1.0 else 0.0 end)', 'same_sign_share')}, count(*) as n_origins
       from cells c join (select feature, avg(rho) as m from cells where scope = 'all' group by 1) m on m.feature = c.feature
       where c.scope = 'all' and c.rho is not null group by c.feature""", ranked=_ranked, cells=_cells))
def _(spark, sf):
    long = diagnostics.factor_agreement(ranked_panel(spark, sf), 1, FEATURES)
    return V.rounded(diagnostics.sign_stability(cut_lineage(long).where("scope = 'all'")))


_bh = "select *, fwd_1y - target_1y as mg from panel where group_ok and target_1y is not null and beta is not null"
_bcell = lambda w, n: f"left join ({spearman('yr', 'beta', 'target_1y', f'(select * from bh where {w})')}) {n} on {n}.yr = u.yr"
_bhist = f"""select u.yr, u.n, u.up as share_in_rising_groups, u.fg as focus_group_growth, a.rho as beta_spearman_all, b.rho as beta_spearman_up_groups,
       c.rho as beta_spearman_down_groups, d.rho as beta_spearman_focus
       from (select yr, count(*) as n, avg(case when mg > 0 then 1.0 else 0.0 end) as up, avg(case when in_focus then mg end) as fg from bh group by 1) u
       {_bcell('true', 'a')} {_bcell('mg > 0', 'b')} {_bcell('mg < 0', 'c')} {_bcell('in_focus', 'd')}"""
_bcols = ["share_in_rising_groups", "focus_group_growth", "beta_spearman_all", "beta_spearman_up_groups", "beta_spearman_down_groups", "beta_spearman_focus"]


@query("e_beta_history", sql("select cast(yr as integer) as origin_year, cast(n as integer) as n, " + ", ".join(r(c) for c in _bcols) + " from bhist", bh=_bh, bhist=_bhist))
def _(spark, sf):
    return V.rounded(diagnostics.beta_history(V.written_panel(spark, sf), 1))


@query("a_beta_summary", sql(f"""select {r('avg(beta_spearman_up_groups)', 'mean_up')}, {r('avg(beta_spearman_down_groups)', 'mean_down')},
       count(case when focus_group_growth > 0 then 1 end) as n_focus_up, {r('avg(case when focus_group_growth > 0 then beta_spearman_focus end)', 'mean_focus_up')},
       count(case when focus_group_growth < 0 then 1 end) as n_focus_down, {r('avg(case when focus_group_growth < 0 then beta_spearman_focus end)', 'mean_focus_down')} from bhist""", bh=_bh, bhist=_bhist))
def _(spark, sf):
    return V.rounded(diagnostics.beta_summary(diagnostics.beta_history(V.written_panel(spark, sf), 1)))


# ---------------------------------------------------------------- ranked lists

_list = """select entity, grp, sub, yr, mom_1y_rel as score, level_rel_group, mom_1y_rel, val, row_number() over (order by mom_1y_rel desc, entity) as rank,
       'Town ' || (entity % 7) as city, mom_3y_rel from panel where in_focus and yr = 2000 and mom_1y_rel is not null"""


def ranked_list(spark, sf):
    """Focus parts at the 2000 origin scored by a rule."""
    rows = V.written_panel(spark, sf).where("in_focus and origin_year = 2000 and mom_1y_rel is not null")
    rows = rows.withColumn("score", F.col("mom_1y_rel")).withColumn("city", F.concat(F.lit("Town "), (F.col("entity") % 7).cast("string")))
    return ranking.rank_rows(rows, ["origin_year"])


def forecast(spark, sf):
    """An outside figure for some parts: its next-year growth against its group, known for all brands but one."""
    return V.panel(spark, sf).where("origin_year = 2000 and sub <> 'Brand#11'").select("entity", (100 * F.col("target_1y")).alias("forecast_1y_pct"))


@query("o_ranked_list", sql(f"select entity, cast(rank as integer) as rank, {r(pct('score', '1'), 'focus_percentile').replace('round(', 'round(100 * (', 1).replace(', 6)', '), 6)', 1)}, {r('score')} from list", list=_list))
def _(spark, sf):
    return V.rounded(ranked_list(spark, sf).select("entity", "rank", "focus_percentile", "score"))


@query("o_top_and_bottom", sql("""select entity, cast(rank as integer) as rank, 'top' as side from list where rank <= 15 union all
       select entity, cast(rank as integer), 'bottom' from list where rank > (select count(*) from list) - 15""", list=_list))
def _(spark, sf):
    return ranking.top_and_bottom(cut_lineage(ranked_list(spark, sf)), 15).select("entity", "rank", "side")


AREAS = {"North": (["Brand#11", "Brand#12", "Brand#13"], None), "South": (["Brand#21", "Brand#13"], "Town 3")}
_area = lambda t, subs, city: f"""select '{t}' as area, entity, cast(rank as integer) as rank, {city} as flagged, cast(row_number() over (order by rank) as integer) as sub_rank
       from list where sub in ({", ".join("'" + s + "'" for s in subs)}) qualify sub_rank <= 15"""  # noqa: E731


@query("o_area_subset", sql(_area("North", AREAS["North"][0], "false") + " union all " + _area("South", AREAS["South"][0], "coalesce(city = 'Town 3', false)"), list=_list))
def _(spark, sf):
    return ranking.area_subset(ranked_list(spark, sf), AREAS, 15).select("area", "entity", "rank", "flagged", "sub_rank")


@query("a_list_shape", sql(f"""select side, {r('median(level_rel_group)', 'median_level')}, {r('median(mom_1y_rel)', 'median_growth')}, count(*) as n_rows from (
       select *, 'top' as side from list where rank <= 15 union all select *, 'bottom' from list where rank > (select count(*) from list) - 15) group by side""", list=_list))
def _(spark, sf):
    return V.rounded(ranking.list_shape(cut_lineage(ranked_list(spark, sf)), 15))


_joined = "select l.*, 1 as one, f.f as fc from list l left join (select entity, 100 * target_1y as f from panel where yr = 2000 and sub <> 'Brand#11') f on f.entity = l.entity"


@query("j_forecast_on_ranking", sql(f"select entity, cast(rank as integer) as rank, {r('fc', 'forecast_1y_pct')} from joined", list=_list, joined=_joined))
def _(spark, sf):
    rows = ranked_list(spark, sf).join(forecast(spark, sf), "entity", "left")
    return V.rounded(rows.select("entity", "rank", "forecast_1y_pct"))


@query("a_outside_agreement", sql(f"""select {r('avg(case when rank <= 25 then fc end)', 'top_mean')}, {r('avg(fc)', 'all_mean')}, count(fc) as n_known,
       {r(f"(select rho from ({spearman('one', 'score', 'fc', 'joined')}))", 'rho')} from joined""", list=_list, joined=_joined))
def _(spark, sf):
    rows = ranked_list(spark, sf).join(forecast(spark, sf), "entity", "left")
    return V.rounded(ranking.outside_agreement(cut_lineage(rows), "forecast_1y_pct", ["origin_year"]).drop("origin_year"))


_pcts = f"select *, {pct('fwd_1y', 'yr, grp')} as tp from panel"
_bands = """select b.band, m.med from (select unnest(range(20)) as band) b left join (
       select cast(least(floor(tp * 20), 19) as integer) as band, median(target_1y) as med from pcts where in_focus and group_ok and target_1y is not null group by 1) m on m.band = b.band"""
_filled = """select band, med, last_value(med ignore nulls) over w as pv, last_value(case when med is not null then band end ignore nulls) over w as pb,
       first_value(med ignore nulls) over n as nv, first_value(case when med is not null then band end ignore nulls) over n as nb from bands
       window w as (order by band rows between unbounded preceding and current row), n as (order by band rows between current row and unbounded following)"""


@query("m_analogue_bands", sql(f"select cast(band as integer) as band, {r('case when pv is null then null when nv is null or nb = pb then pv else pv + (nv - pv) * (band - pb) / (nb - pb) end', 'growth')} from filled",
       pcts=_pcts, bands=_bands, filled=_filled))
def _(spark, sf):
    rows = evaluation.usable_rows(ranked_panel(spark, sf), 1)
    return V.rounded(ranking.analogue_bands(rows, "target_1y", 20))


@query("k_ranking_documents", sql(f"""select 1 as horizon, cast((rank - 1) // 100 as integer) as part, cast(rank as integer) as rank, entity, {r('round_even(score, 2)', 'score')},
       {r('round_even(round(val, 0), 2)', 'value')}, cast((select count(*) from list) as integer) as n_entities, '2000-12-31' as origin from list""", list=_list))
def _(spark, sf):
    rows = ranked_list(spark, sf).select(
        "*", F.lit(1).alias("horizon"), F.lit(None).cast("double").alias("hist_relative_pct"),
        F.lit(None).cast("double").alias("forecast_1y_pct"))
    docs = panels.ranking_documents(cut_lineage(rows), chunk=100, long=3)
    schema = "origin string, n_entities int, entities array<struct<rank:int, entity:long, value:double, score:double>>"
    parsed = docs.select("horizon", "part", F.from_json("json", schema).alias("d"))
    return V.rounded(parsed.select("horizon", "part", "d.origin", "d.n_entities", F.explode("d.entities").alias("e")).select(
        "horizon", "part", "e.rank", "e.entity", "e.score", "e.value", "n_entities", "origin"))


@query("a_panel_counts", sql("""select count(*) as n_rows, make_date(min(yr), 12, 31) as first_origin, make_date(max(yr), 12, 31) as last_origin,
       count(distinct case when yr = (select max(yr) from panel) then entity end) as n_entities,
       count(distinct case when in_focus and yr = (select max(yr) from panel) then entity end) as n_focus from panel"""))
def _(spark, sf):
    return plan.panel_counts(V.panel(spark, sf))


@query("e_stamped_summary", sql(f"select {_horizon}, model, cast(count(*) as integer) as n_folds, (select cast(make_date(max(yr), 12, 31) as varchar) from part_panel) as panel_origin from scores group by horizon, model"))
def _(spark, sf):
    rows = V.panel(spark, sf)
    summary = scores(spark, sf).groupBy("horizon", "model").agg(F.count("*").cast("int").alias("n_folds"))
    return evaluation.stamp_origin(summary, rows)


@query("k_skill_of_fresh_summaries", sql(f"""select cast(h.horizon as integer) as horizon, cast(count(distinct model) as integer) as fresh, cast(0 as integer) as stale
       from (select unnest([{', '.join(map(str, HORIZONS))}]) as horizon) h left join scores s on s.horizon = h.horizon group by h.horizon"""))
def _(spark, sf):
    """Models whose skill stands in the documents of each horizon, if the summary is of this panel and if it is of another."""
    rows = V.written_panel(spark, sf)
    summary = evaluation.summarize(cut_lineage(evaluation.score(cut_lineage(predictions(spark, sf)))), list(RULES), draws=20)
    blank = ("rank", "entity", "value", "score", "focus_percentile", "hist_relative_pct", "forecast_1y_pct", "level_rel_group", "mom_3y_rel")
    ranking_rows = spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in V.EVAL.horizons])).alias("horizon"), F.lit("2000-12-31").alias("origin"), *[F.lit(1.0).alias(c) for c in blank])

    def models(stamped, name):
        skill = panels.skill_map(stamped, list(RULES), evaluation.panel_fingerprint(rows))
        docs = panels.ranking_documents(ranking_rows, skill=skill, long=3)
        found = F.from_json("json", "walk_forward_skill map<string, struct<folds:int>>")["walk_forward_skill"]
        return docs.select("horizon", F.coalesce(F.size(F.map_keys(found)), F.lit(0)).alias(name))

    fresh = models(evaluation.stamp_panel(summary, rows), "fresh")
    stale = models(evaluation.stamp_panel(summary, rows.withColumn("value", F.col("value") + 1)), "stale")
    return fresh.join(stale, "horizon")


@query("o_seeded_sample", "select entity from (select p_partkey as entity from part) order by md5('7|' || entity), entity limit 500")
def _(spark, sf):
    return seeded_sample(V.parts(spark, sf).select("entity"), ["entity"], 500)


# ---------------------------------------------------------------- fitted models (no SQL)


def model_panel(spark, sf, horizons=(1,)):
    from panelwright.operators.signs import add_trailing_signs

    def ranked():
        base = V.written_panel(spark, sf)
        return add_ranks(cut_lineage(add_trailing_signs(base, base)), horizons)

    return settle(ranked)


@query("m_model_scores")
def _(spark, sf):
    """A run that is stopped after its first tree fit and taken up again."""
    rows, opt = model_panel(spark, sf), replace(V.EVAL, horizons=(1,))
    run = plan.new_run(spark)
    fits.run_fits(run, rows, replace(opt, first_test_year=2000), SMALL_TREES, (fits.TREES[0], fits.RIDGE))
    preds = plan.model_predictions(rows, opt, SMALL_TREES, run=run)
    return evaluation.score(cut_lineage(preds))


@query("m_feature_group_ablation")
def _(spark, sf):
    return plan.feature_group_ablation(model_panel(spark, sf), 1, V.EVAL, SMALL_TREES)


@query("m_permutation_importance")
def _(spark, sf):
    return plan.feature_importance(model_panel(spark, sf), 1, V.EVAL, SMALL_TREES)


_blend = "coalesce(beta * group_mom_1y, 0) - 0.25 * coalesce(level_rel_group, 0)"
_moved = lambda f, i: f"case when which = {i} then g.{f} else r.{f} end"
_used = ("beta", "group_mom_1y", "level_rel_group")


@query("m_importance_of_a_rule", sql(f"""
    select feature, {r('avg(rise)', 'importance_mean', 9)}, {r('stddev_pop(rise)', 'importance_std', 9)} from (
      select feature, repeat, avg(power({_blend} - y, 2)) - (select avg(power({_blend} - y, 2)) from scored) as rise from exchanged group by 1, 2) group by 1""",
    scored="select *, target_1y as y, row_number() over (order by entity, yr) as place from panel where target_1y is not null",
    givers="""select s.*, t.repeat, row_number() over (partition by repeat order by md5('7|' || repeat || '|' || entity || '|' || (yr * 12 + 11)), entity, yr) as gives
              from scored s, (select unnest([0, 1, 2]) as repeat) t""",
    exchanged="select r.y, g.repeat, w.feature, " + ", ".join(f"{_moved(f, i)} as {f}" for i, f in enumerate(_used)) + " from scored r "
    "join givers g on g.gives = r.place, (select unnest([0, 1, 2]) as which, unnest([" + ", ".join(f"'{f}'" for f in _used) + "]) as feature) w",
))
def _(spark, sf):
    """Permutation importance of a formula of three features, over all labelled rows."""
    rule = Rule(F.coalesce(F.col("beta") * F.col("group_mom_1y"), F.lit(0.0)) - 0.25 * F.coalesce("level_rel_group", F.lit(0.0)), _used)
    found = permutation_importance(rule, V.written_panel(spark, sf), "target_1y", ["entity", "midx"])
    return V.rounded(found, 9)


@query("m_focus_ranking")
def _(spark, sf):
    out = plan.rank_focus(model_panel(spark, sf), 1, V.EVAL, SMALL_TREES)
    return out.select("rank", "entity", "score", "focus_percentile", "hist_relative_pct", "pred_gbm", "pred_ridge")


@query("m_ridge_predictions")
def _(spark, sf):
    rows = model_panel(spark, sf, V.EVAL.horizons)
    preds = plan.model_predictions(rows, V.EVAL, models=(fits.RIDGE,))
    return preds.select("entity", "horizon", "test_year", "pred")


RANKED = ("log_value", "mom_1y", "mom_2y", "mom_3y", "level_rel_group", "beta", "level_rel_sub", "sub_level_rel_group", "mom_1y_rel_sub")
_trained = " union all ".join(
    f"select {h} as horizon, yr, '{f}' as feature, {f} as v from ridge_panel where group_ok and target_{h}y is not null" for h in HORIZONS for f in RANKED
)


@query("m_ridge_folds", sql(f"""
    select {_fold}, cast(n_train as bigint) as n_train, 'cs_' || feature as feature, {r('median(v)', 'median')},
      {r('avg(coalesce(v, m))', 'mean')}, {r('stddev_pop(coalesce(v, m))', 'deviation')}, 0.0::double as residual
    from (select *, median(v) over (partition by horizon, test_year, feature) as m from cells)
    group by horizon, test_year, n_train, feature having min(v) < max(v)""",
    ridge_panel=f"select yr, group_ok, {', '.join(f'target_{h}y' for h in HORIZONS)}, {', '.join(pct(f, 'yr, grp') + ' as ' + f for f in RANKED)} from panel",
    trained=_trained,
    cells="select f.horizon, f.test_year, f.n_train, t.feature, t.v from folds f join trained t on t.horizon = f.horizon and t.yr <= f.test_year - f.horizon",
))
def _(spark, sf):
    """Medians, means and deviations of each fold's training rows, and how far its weights are from the optimum (0)."""
    rows = model_panel(spark, sf, V.EVAL.horizons)
    found = gram.ridge_folds(rows, [f"cs_{c}" for c in RANKED], V.EVAL.horizons, V.EVAL.first_test_year)
    parts = F.explode(F.arrays_zip(F.col("features").alias("feature"), "median", "mean", "deviation")).alias("f")
    cells = found.select("horizon", "test_year", "n_train", "residual", parts)
    return V.rounded(cells.select("horizon", "test_year", "n_train", "f.feature", "f.median", "f.mean", "f.deviation", "residual"))


@query("e_evaluate", sql(f"""select {_fold}, model, {_metrics}, cast(n_test as integer) as n_test, cast(n_test_focus as integer) as n_test_focus,
    cast(n_train as bigint) as n_train from scores join (select horizon, test_year, n_train from folds) using (horizon, test_year)""",
    rules4=BLOCKS["rules4"] + """ union all select t.entity, t.test_year, t.sub, t.in_focus, t.horizon, t.actual, 'catch_up_neighbours', -g.nbr_level_gap
      from targets t left join nbr_gaps g on g.entity = t.entity and g.yr = t.test_year"""))
def _(spark, sf):
    """Every rule over every horizon and fold, from a panel with the neighbours' gaps."""
    rows = V.written_panel(spark, sf)
    gaps = cut_lineage(neighbours.neighbour_gaps(rows, V.points(spark, sf), V.OPT.neighbours, "mom_3y"))
    return V.rounded(plan.evaluate(rows.join(gaps, ["entity", "midx"], "left"), V.EVAL, long=3))
