"""Named SQL building blocks for the DuckDB side, put together with their dependencies."""

from __future__ import annotations

import re

LAGS, HORIZONS, BETA_YEARS = (1, 2, 3), (1, 2, 3, 5), 4


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 as {name or expr.split('.')[-1]}"


def _at(k: int) -> str:
    side = "preceding" if k <= 0 else "following"
    return f"max(val) over (partition by entity order by yr range between {abs(k)} {side} and {abs(k)} {side})"


_history = ", ".join(
    [f"ln(val) - ln({_at(-k)}) as mom_{k}y" for k in LAGS]
    + [f"ln({_at(h)}) - ln(val) as fwd_{h}y" for h in HORIZONS]
    + [f"ln({_at(-k)}) - ln({_at(-k - 1)}) as g{k}" for k in range(BETA_YEARS)]
)
_rel = ", ".join(
    [f"mom_{k}y - avg(mom_{k}y) over g as mom_{k}y_rel" for k in LAGS]
    + [f"fwd_{h}y - avg(fwd_{h}y) over g as target_{h}y" for h in HORIZONS]
)
_growth = " union all ".join(f"select entity, yr, grp, {k} as k, g{k} as g from hist" for k in range(BETA_YEARS))


def pct(value: str, part: str) -> str:
    """Average-rank percentile of a column within a partition list; NULL stays NULL."""
    known = f"count({value}) over (partition by {part})"
    rank = f"rank() over (partition by {part} order by {value} nulls last)"
    ties = f"count(*) over (partition by {part}, {value})"
    return f"case when {value} is not null then ({rank} + ({ties} - 1) / 2.0) / {known} end"


def spearman(keys: str, a: str, b: str, source: str, minimum: int = 20) -> str:
    """Select of keys, n, rho from a relation name or a parenthesised query."""
    return (
        f"select {keys}, count(*) as n, case when count(*) >= {minimum} and not isnan(corr(ra, rb)) "
        f"then corr(ra, rb) end as rho from (select {keys}, "
        f"rank() over (partition by {keys} order by a_) + (count(*) over (partition by {keys}, a_) - 1) / 2.0 as ra, "
        f"rank() over (partition by {keys} order by b_) + (count(*) over (partition by {keys}, b_) - 1) / 2.0 as rb "
        f"from (select {keys}, {a} as a_, {b} as b_ from {source}) where a_ is not null and b_ is not null) group by {keys}"
    )


BLOCKS = {
    "part_panel": """
        select p.p_partkey as entity, p.p_type as grp, p.p_brand as sub, year(l.l_shipdate) as yr,
               avg(l.l_extendedprice) as val, avg(l.l_quantity) as rent,
               cast(count(*) as double) as inventory,
               cast(count(distinct l.l_orderkey) as double) as new_listings,
               avg(l.l_discount) as cut_share
        from lineitem l join part p on l.l_partkey = p.p_partkey group by 1, 2, 3, 4""",
    "hist": f"select *, ln(val) as log_value, {_history} from part_panel",
    "slopes": f"""
        select entity, yr, case when count(g) >= 3 and not isnan(regr_slope(g, m)) then regr_slope(g, m) end as beta
        from (select *, avg(g) over (partition by yr, grp, k) as m from ({_growth})) group by entity, yr""",
    "panel": f"""
        select b.*, s.beta from (
        select *, {_rel},
               median(log_value) over g as group_level_median,
               log_value - median(log_value) over g as level_rel_group,
               stddev_samp(log_value) over g as group_level_spread,
               avg(mom_3y) over g as group_mom_3y, avg(mom_1y) over g as group_mom_1y,
               ln(count(*) over g) as group_log_size,
               log_value - median(log_value) over s as level_rel_sub,
               median(log_value) over s - median(log_value) over g as sub_level_rel_group,
               mom_1y - avg(mom_1y) over s as mom_1y_rel_sub,
               avg(mom_1y) over s - avg(mom_1y) over g as sub_mom_1y_rel,
               avg(mom_3y) over s - avg(mom_3y) over g as sub_mom_3y_rel,
               count(*) over g >= 10 as group_ok, grp = 'PROMO' as in_focus
        from hist window g as (partition by yr, grp), s as (partition by yr, grp, sub)) b
        join slopes s using (entity, yr)""",
    "pts": """
        select p_partkey as entity, p_type as grp,
               cast((p_partkey * 37) % 1200 as double) / 10.0 - 60.0 as lat,
               cast((p_partkey * 91) % 3400 as double) / 10.0 - 170.0 as lon from part""",
    "pairs": """
        select a.entity as entity, b.entity as nbr,
               round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
                 + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 6) as d
        from pts a join pts b on a.entity <> b.entity""",
    "near": """
        select yr, entity, nbr, d from (
          select x.yr, p.entity, p.nbr, p.d,
                 row_number() over (partition by x.yr, p.entity order by p.d, p.nbr) as i
          from pairs p join part_panel x on x.entity = p.entity join part_panel y on y.entity = p.nbr and y.yr = x.yr)
        where i <= 10""",
    "nbr_gaps": """
        select h.entity, h.yr, h.log_value - g.lv as nbr_level_gap, h.mom_3y - g.m as nbr_mom_3y_gap, g.d as nbr_dist_km
        from hist h join (
          select n.yr, n.entity, avg(v.log_value) as lv, avg(v.mom_3y) as m, avg(n.d) as d
          from near n join hist v on v.entity = n.nbr and v.yr = n.yr group by 1, 2) g
        on g.entity = h.entity and g.yr = h.yr""",
    "vint": """
        select p.p_brand as entity, year(o.o_orderdate) as vintage, cast(count(*) as double) as total,
               cast(sum(case when o.o_orderstatus = 'F' then 1 else 0 end) as double) as part_a,
               avg(o.o_totalprice) as income
        from orders o join lineitem l on l.l_orderkey = o.o_orderkey join part p on p.p_partkey = l.l_partkey
        where year(o.o_orderdate) <> 1998 group by 1, 2""",
    "wide": "select lpad_key as entity, * exclude (lpad_key) from (select case when length(cast(p_partkey as varchar)) < 5 "
    "then lpad(cast(p_partkey as varchar), 5, '0') else cast(p_partkey as varchar) end as lpad_key, * from part)",
    "targets": " union all ".join(
        f"select entity, yr as test_year, sub, in_focus, {h} as horizon, target_{h}y as actual, mom_1y_rel, mom_3y_rel, "
        f"level_rel_group, beta, group_mom_1y from panel where group_ok and target_{h}y is not null"
        for h in HORIZONS
    ),
    "rules4": """
        select entity, test_year, sub, in_focus, horizon, actual, 'momentum_1y' as model, mom_1y_rel as pred from targets
        union all select entity, test_year, sub, in_focus, horizon, actual, 'momentum_3y', mom_3y_rel from targets
        union all select entity, test_year, sub, in_focus, horizon, actual, 'catch_up_price', -level_rel_group from targets
        union all select entity, test_year, sub, in_focus, horizon, actual, 'beta_x_group_trend', beta * group_mom_1y from targets""",
    "folds": """
        select t.horizon, t.test_year, t.n_test, sum(p.n_test) as n_train
        from (select horizon, test_year, count(*) as n_test from targets group by 1, 2) t
        join (select horizon, test_year, count(*) as n_test from targets group by 1, 2) p
          on p.horizon = t.horizon and p.test_year <= t.test_year - t.horizon
        where t.test_year >= 1997 group by 1, 2, 3""",
    "preds": "select r.* from rules4 r join folds f on f.horizon = r.horizon and f.test_year = r.test_year",
    "rho_national": spearman("horizon, test_year, model", "pred", "actual", "preds"),
    "rho_focus": spearman("horizon, test_year, model", "pred", "actual", "(select * from preds where in_focus)"),
    "rho_sub": spearman(
        "horizon, test_year, model, sub", "pred", "actual",
        "(select * exclude (sub), coalesce(sub, '') as sub from preds where in_focus)",
    ),
    "known": "select * from preds where pred is not null",
    "spread_all": """
        select p.horizon, p.test_year, p.model, case when count(*) >= 50 then
               avg(case when pred >= hi then actual end) - avg(case when pred <= lo then actual end) end as spread
        from known p join (select horizon, test_year, model, quantile_cont(pred, 0.8) as hi, quantile_cont(pred, 0.2) as lo
                           from known group by 1, 2, 3) q
          on q.horizon = p.horizon and q.test_year = p.test_year and q.model = p.model group by 1, 2, 3""",
    "spread_focus": """
        select p.horizon, p.test_year, p.model, case when count(*) >= 50 then
               avg(case when pred >= hi then actual end) - avg(case when pred <= lo then actual end) end as spread
        from known p join (select horizon, test_year, model, quantile_cont(pred, 0.8) as hi, quantile_cont(pred, 0.2) as lo
                           from known where in_focus group by 1, 2, 3) q
          on q.horizon = p.horizon and q.test_year = p.test_year and q.model = p.model where in_focus group by 1, 2, 3""",
    "scores": """
        select c.horizon, c.test_year, c.model, n.rho as spearman_national, f.rho as spearman_focus,
               w.rho as spearman_focus_within_sub, sa.spread as q5_q1_spread_national, sf.spread as q5_q1_spread_focus,
               c.n_test, c.n_test_focus
        from (select horizon, test_year, model, count(actual) as n_test,
                     count(case when in_focus then actual end) as n_test_focus from preds group by 1, 2, 3) c
        left join rho_national n using (horizon, test_year, model)
        left join rho_focus f using (horizon, test_year, model)
        left join (select horizon, test_year, model, avg(rho) as rho from rho_sub group by 1, 2, 3) w using (horizon, test_year, model)
        left join spread_all sa using (horizon, test_year, model)
        left join spread_focus sf using (horizon, test_year, model)""",
}


RATES = """(select midx, value from (select year(o_orderdate) * 12 + month(o_orderdate) - 1 as midx, o_totalprice as value,
       row_number() over (partition by year(o_orderdate), month(o_orderdate) order by cast(o_orderdate as date) desc, o_orderkey desc) as i from orders) where i = 1)"""
_sign = lambda f, e: f"select '{f}' as factor, yr, rho from ({spearman('yr', e, 'fwd_1y', 'panel')})"
_signg = lambda f, e: f"select '{f}' as factor, yr, grp, rho from ({spearman('yr, grp', e, 'fwd_1y', 'panel')})"
_CHANGED = ("log_pop", "log_income", "log_housing_units", "bachelors_share", "young_adult_share", "inflow_share", "owner_share")
_TWINS = ["rent_yield", "rent_mom_2y", "price_to_income", "log_income", "bachelors_share", "young_adult_share"] + [f"d2_{c}" for c in _CHANGED]

# Every source joined to the panel: what the whole plan makes, but for the percentiles.
BLOCKS |= {
    "signs": _sign("cheap", "-level_rel_group") + " union all " + _sign("mom", "mom_1y_rel"),
    "rolled": "select factor, yr, rho, case when count(rho) over w >= 2 then avg(rho) over w end as m from signs "
    "window w as (partition by factor order by yr rows between 2 preceding and current row)",
    "gsigns": _signg("cheap", "-level_rel_group") + " union all " + _signg("mom", "mom_1y_rel"),
    "tempo": """
        select a.entity, a.yr, ln(a.inventory) - ln(q.inventory) as inventory_yoy, ln(a.new_listings) - ln(q.new_listings) as new_listings_yoy,
               a.inventory / a.new_listings as inv_to_new_listings, a.rent as days_pending, a.rent - q.rent as days_pending_yoy,
               a.cut_share as price_cut_share, a.cut_share - q.cut_share as price_cut_share_yoy, 12 * a.rent / a.val as rent_yield,
               ln(a.rent) - ln(o.rent) as rent_mom_2y, a.inventory as listed
        from part_panel a left join part_panel q on q.entity = a.entity and q.yr = a.yr - 1
        left join part_panel o on o.entity = a.entity and o.yr = a.yr - 2""",
    "natl": """
        select a.yr, a.natl, a.natl - ln(c.v) as ptr from (select yr, ln(median(val)) as natl from part_panel group by 1) a
        left join (select year(l_shipdate) as yr, avg(l_quantity) as v from lineitem where month(l_shipdate) = 12 group by 1) c on c.yr = a.yr""",
    "macro_years": f"""
        select d.yr, r.value as rg_rate_level, r.value - s.value as rg_rate_change_1y, d.natl - p.natl as rg_natl_mom_1y, d.dev as rg_price_to_rent_dev
        from (select *, case when count(ptr) over w >= 6 then ptr - avg(ptr) over w end as dev from natl
              window w as (order by yr rows between 11 preceding and current row)) d
        left join {RATES} r on r.midx = d.yr * 12 + 11 left join {RATES} s on s.midx = d.yr * 12 - 1 left join natl p on p.yr = d.yr - 1""",
    "counts": """
        select entity, yr as vintage, ln(1000 * inventory) as log_pop, ln(val / 10) as log_income, ln(30 * rent) as log_attr_rent,
               ln(100 * inventory + entity % 50) as log_housing_units, cast(20 + entity % 40 as double) as median_age,
               case when entity % 9 > 0 then cast(1900 + entity * 7 % 120 as double) end as median_year_built,
               (2 * rent + inventory) / (1000 * inventory) as young_adult_share, rent / (2 * rent + inventory) as owner_share,
               new_listings / (100 * inventory + entity % 50) as vacancy_share, rent / (60 + inventory) as bachelors_share,
               (inventory + case when entity % 3 > 0 then rent else 0 end) / (100 * new_listings) as inflow_share,
               100 * cut_share / (100 + rent) as unemployment_rate, inventory / (inventory + rent) as transit_share
        from part_panel""",
    "counts_changed": "select v.*, " + ", ".join(f"v.{c} - o.{c} as d2_{c}" for c in _CHANGED)
    + " from counts v left join counts o on o.entity = v.entity and o.vintage = v.vintage - 2",
    "vintage_of": "select y.yr, max(v.vintage) as vintage from (select distinct yr from part_panel) y "
    "left join (select distinct vintage from counts) v on v.vintage <= y.yr - 2 group by 1",
    "joined": """
        select p.*, t.* exclude (entity, yr, listed), m.* exclude (yr), n.* exclude (entity, yr), c.vintage, a.* exclude (entity, vintage),
               p.log_value - a.log_income as price_to_income, a.log_attr_rent + ln(12) - p.log_value as attr_rent_to_price,
               1000 * t.listed / exp(a.log_housing_units) as inv_per_1k_units, sc.rho as rg_cheap_sign_1y, sm.rho as rg_mom_sign_1y,
               sc.m as rg_cheap_sign_3y, sm.m as rg_mom_sign_3y, gc.rho as rg_group_cheap_sign_1y, gm.rho as rg_group_mom_sign_1y
        from panel p join tempo t on t.entity = p.entity and t.yr = p.yr join macro_years m on m.yr = p.yr
        left join nbr_gaps n on n.entity = p.entity and n.yr = p.yr join vintage_of c on c.yr = p.yr
        left join counts_changed a on a.entity = p.entity and a.vintage = c.vintage
        left join rolled sc on sc.factor = 'cheap' and sc.yr = p.yr - 1 left join rolled sm on sm.factor = 'mom' and sm.yr = p.yr - 1
        left join gsigns gc on gc.factor = 'cheap' and gc.yr = p.yr - 1 and gc.grp = p.grp
        left join gsigns gm on gm.factor = 'mom' and gm.yr = p.yr - 1 and gm.grp = p.grp""",
    "whole": "select *, " + ", ".join(f"{c} - avg({c}) over g as {c}_rel" for c in _TWINS) + " from joined window g as (partition by yr, grp)",
}


def bootstrap_block(name: str, source: str, keys: str, value: str, draws: int = 200) -> dict[str, str]:
    """Blocks computing (keys, ci_low, ci_high) of the mean of `value` by test_year from `source`."""
    on = " and ".join(f"v.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    return {
        f"{name}_v": f"""select {keys}, {value} as v, horizon as block,
            row_number() over (partition by {keys} order by test_year) - 1 as i,
            count(*) over (partition by {keys}) as n from {source} where {value} is not null""",
        f"{name}_s": f"""select {keys}, any_value(n) as n, any_value(block) as block from {name}_v group by {keys}
            having any_value(n) >= 3 and any_value(block) <= any_value(n) // 2""",
        f"{name}_d": f"""select {", ".join("s." + k.strip() for k in keys.split(","))}, d.draw, avg(v.v) as m from {name}_s s
            cross join (select unnest(range({draws})) as draw) d
            cross join (select unnest(range(40)) as pos) p
            join {name}_v v on {on} and v.i = (cast('0x' || substr(md5('7|' || d.draw || '|' || (p.pos // s.block)), 1, 8) as bigint)
                 + p.pos % s.block) % s.n
            where p.pos < s.n group by all""",
        name: f"""select {keys}, quantile_cont(m, 0.05) as ci_low, quantile_cont(m, 0.95) as ci_high
            from {name}_d group by {keys}""",
    }


BLOCKS |= bootstrap_block("boot", "scores", "horizon, model", "spearman_focus")


def sql(final: str, **extra: str) -> str:
    """`final` with the blocks it needs, in dependency order."""
    blocks = BLOCKS | extra
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in blocks:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                needed.append(name)
                visit(blocks[name])
                needed.remove(name)
                needed.append(name)

    visit(final)
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for other in blocks:
            if other != name and re.search(rf"\b(from|join)\s+{other}\b", blocks[name]):
                place(other)
        ordered.append(name)

    for name in needed:
        place(name)
    head = ", ".join(f"{n} as ({blocks[n]})" for n in ordered)
    return f"with {head} {final}" if head else final
