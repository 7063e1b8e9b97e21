"""Sources, series, group features, joins, ranks and panel statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.sqltext import HORIZONS, LAGS, RATES, pct, r, spearman, sql
from panelwright.functions import calendar, scalar
from panelwright.operators import agreement, groups, history, macro, neighbours, positions, signs
from panelwright.operators import vintages as vint
from panelwright.plans import panel as plan
from panelwright.session import cut_lineage, settle
from panelwright.sources import attributes, wide

Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        Q[name] = fn
        if oracle is not None:
            O[name] = oracle
        return fn

    return register


DEC = "cast(yr * 12 + 11 as integer) as midx"
KEY = "case when length({0}) < 5 then lpad({0}, 5, '0') else {0} end"
PART_KEY = KEY.format("cast(p_partkey as varchar)")

# ---------------------------------------------------------------- sources


@query("s_wide_meta", f"select {PART_KEY} as entity, substr(p_brand, 1, 5) as state, 'Town ' || p_partkey as city, "
       "p_type as grp, p_brand as sub from part where p_partkey in (select l_partkey from lineitem)")
def _(spark, sf):
    return wide.wide_meta(V.wide(spark, sf))


@query("s_unpivot_months", sql(f"select {KEY.format('cast(entity as varchar)')} as entity, {DEC}, {r('val', 'value')} from part_panel"))
def _(spark, sf):
    return V.rounded(wide.wide_series(V.wide(spark, sf)))


@query("s_pad_key", f"select o_orderkey, {KEY.format('cast(o_orderkey as varchar)')} as key, "
       f"{KEY.format('cast(o_orderkey * 7919 as varchar)')} as long_key from orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(
        k, scalar.pad_key(k.cast("string")).alias("key"), scalar.pad_key((k * 7919).cast("string")).alias("long_key")
    )


@query("s_header_row_json", sql("select vintage, entity, cast(total as varchar) as total, cast(part_a as varchar) as part_a from vint"))
def _(spark, sf):
    rows = V.vintages(spark, sf)
    text = F.to_json(F.array(F.array(F.lit("total"), F.lit("place"), F.lit("part_a")),
                             F.array(F.col("total").cast("string"), "entity", F.col("part_a").cast("string"))))
    docs = rows.select("vintage", text.alias("text"))
    return attributes.header_row_table(docs, "text", ["place", "total", "part_a"], ["vintage"]).withColumnRenamed("place", "entity")


@query("s_number_and_missing_mark", "select p_partkey as entity, case when p_size in (7, 11) then null "
       "else cast(p_size as double) end as size from part")
def _(spark, sf):
    k = F.col("p_partkey")
    size = F.col("p_size")
    text = F.when(size == 11, "n/a").when(size == 7, "-666666666").otherwise(size.cast("string"))
    return V.table(spark, sf, "part").select(k.alias("entity"), attributes.number(text).alias("size"))


def _codes(spark, sf):
    """A table of published codes made from part keys, with missing marks."""
    k = F.col("p_partkey")
    base = {c: ((k * (i + 3)) % 97 + 1).cast("string") for i, c in enumerate(attributes.BASE_CODES.values())}
    base["B25035_001E"] = F.when(k % 5 == 0, F.lit("0")).otherwise((1900 + k % 100).cast("string"))
    base["B01001_011E"] = F.when(k % 4 == 0, F.lit("-666666666")).otherwise((k % 13).cast("string"))
    old = attributes.EDUCATION_CODES["B15002"]
    edu = {c: F.when(k % 3 == 0, F.lit("-666666666")).otherwise(((k + i) % 11).cast("string"))
           for i, c in enumerate((*old["edu_total"], *old["edu_bachelors_plus"]))}
    return V.table(spark, sf, "part").select(
        k.cast("string").alias(attributes.ENTITY_COLUMN), *[e.alias(c) for c, e in {**base, **edu}.items()]
    )


_code = {n: f"cast((p_partkey * {i + 3}) % 97 + 1 as double)" for i, n in enumerate(attributes.BASE_CODES)}
_code["median_year_built"] = "case when p_partkey % 5 = 0 then 0.0 else cast(1900 + p_partkey % 100 as double) end"
_code["male_25_29"] = "case when p_partkey % 4 = 0 then null else cast(p_partkey % 13 as double) end"
_code["edu_total"] = "case when p_partkey % 3 <> 0 then cast(p_partkey % 11 as double) end"
_code["edu_bachelors_plus"] = "case when p_partkey % 3 <> 0 then " + " + ".join(f"(p_partkey + {i}) % 11" for i in range(1, 9)) + " + 0.0 end"
_codes_sql = f"select {PART_KEY} as entity, 2011 as vintage, " + ", ".join(f"{e} as {n}" for n, e in _code.items()) + " from part"


@query("s_normalise_vintage", _codes_sql.replace(" + 0.0 end as edu", " + 0.0e0 end as edu"))
def _(spark, sf):
    return attributes.normalise_vintage(_codes(spark, sf), 2011)


@query("s_merge_parts", "select coalesce(a.entity, b.entity) as entity, a.size, b.price from "
       "(select p_partkey as entity, p_size as size from part where p_size <= 40) a full outer join "
       "(select p_partkey as entity, p_retailprice as price from part where p_type <> 'PROMO') b on a.entity = b.entity")
def _(spark, sf):
    part = V.table(spark, sf, "part").withColumnRenamed("p_partkey", "entity")
    left = part.where("p_size <= 40").select("entity", F.col("p_size").alias("size"))
    right = part.where("p_type <> 'PROMO'").select("entity", F.col("p_retailprice").alias("price"))
    return attributes.merge_parts(left, right, "entity")


@query("s_vintage_table", sql(f"select entity, vintage, total, part_a, {r('income', digits=4)} from vint"))
def _(spark, sf):
    return V.rounded(V.vintages(spark, sf), 4)


@query("s_observations", "select o_orderpriority as series, cast(o_orderdate as date) as date, o_totalprice as value from orders where o_orderpriority <> '5-LOW'")
def _(spark, sf):
    obs = V.order_observations(spark, sf)
    text = F.when(F.col("series") == "5-LOW", ".").otherwise(F.col("value").cast("string"))
    raw = obs.select("series", F.col("date").cast("string").alias("date"), text.alias("value"))
    return wide.observations(raw)


@query("s_last_observation", """select series, midx, value from (select o_orderpriority as series,
       year(o_orderdate) * 12 + month(o_orderdate) - 1 as midx, o_totalprice as value,
       row_number() over (partition by o_orderpriority, year(o_orderdate), month(o_orderdate)
                          order by cast(o_orderdate as date) desc, o_orderkey desc) as i from orders) where i = 1""")
def _(spark, sf):
    return macro.last_observation_per_month(V.order_observations(spark, sf), "id")


@query("s_nearest_forecast", sql(f"""select {KEY.format("cast(p.p_partkey as varchar)")} as entity, {r('a.val', 'forecast_1y_pct')}
       from part p left join part_panel a on a.entity = p.p_partkey and a.yr = 1999
       where p.p_partkey in (select l_partkey from lineitem)"""))
def _(spark, sf):
    import datetime as dt

    # 2000-... columns only are candidates in an outside forecast; here the base date picks 1999 by offset.
    rows = V.wide(spark, sf)
    column = wide.nearest_column(rows.columns, dt.date(1998, 12, 31))
    return V.rounded(rows.select(scalar.pad_key(F.col("RegionName")).alias("entity"), F.col(f"`{column}`").alias("forecast_1y_pct")))


# ---------------------------------------------------------------- series


@query("p_origins", """select distinct cast(m as integer) as midx, cast(last_day(make_date(cast(m // 12 as bigint), cast(m % 12 + 1 as bigint), 1)) as date) as origin,
       cast(m // 12 as integer) as origin_year
       from (select year(l_shipdate) * 12 + month(l_shipdate) - 1 as m from lineitem)
       where m % 12 = (select max(year(l_shipdate) * 12 + month(l_shipdate) - 1) % 12 from lineitem) and m // 12 >= 1996""")
def _(spark, sf):
    return history.origins(V.group_month(spark, sf).select("midx"), 1996)


@query("p_panel_base", sql(f"select entity, {DEC}, make_date(yr, 12, 31) as origin, cast(yr as integer) as origin_year, grp, sub, {r('log_value')} from hist"))
def _(spark, sf):
    i = V.inputs(spark, sf)
    rows = history.panel_base(history.value_history(i.series, (), ()), history.origins(i.series, 1990), i.meta)
    return V.rounded(rows.drop("value"))


@query("p_month_end", "select o_orderkey, " + ", ".join(
    f"cast(last_day(cast(o_orderdate as date) + interval '{k} years') as date) as {n}"
    for k, n in ((-1, "back_1"), (-5, "back_5"), (1, "ahead_1"), (3, "ahead_3"))) + " from orders")
def _(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return V.table(spark, sf, "orders").select(
        "o_orderkey",
        *[calendar.shift_month_end(d, k).alias(n) for k, n in ((-1, "back_1"), (-5, "back_5"), (1, "ahead_1"), (3, "ahead_3"))],
    )


@query("p_momentum", sql(f"select entity, {DEC}, {r('mom_1y')}, {r('mom_2y')}, {r('mom_3y')} from hist"))
def _(spark, sf):
    return V.rounded(history.value_history(V.inputs(spark, sf).series, (1, 2, 3), ()).drop("value", "log_value"))


@query("p_outcome", sql(f"select entity, {DEC}, {r('fwd_1y')}, {r('fwd_2y')}, {r('fwd_3y')}, {r('fwd_5y')} from hist"))
def _(spark, sf):
    return V.rounded(history.value_history(V.inputs(spark, sf).series, (), (1, 2, 3, 5)).drop("value", "log_value"))


@query("p_monthly_momentum", """with m as (select p_type as entity, year(l_shipdate) * 12 + month(l_shipdate) - 1 as midx, avg(l_extendedprice) as v
       from lineitem join part on l_partkey = p_partkey group by 1, 2)
       select a.entity, a.midx, round(ln(a.v) - ln(b.v), 6) + 0.0 as mom_1y, round(ln(c.v) - ln(a.v), 6) + 0.0 as fwd_1y
       from m a left join m b on b.entity = a.entity and b.midx = a.midx - 12 left join m c on c.entity = a.entity and c.midx = a.midx + 12""")
def _(spark, sf):
    months = V.group_month(spark, sf).groupBy(F.col("series").alias("entity"), "midx").agg(F.avg("price").alias("value"))
    return V.rounded(history.value_history(months, (1,), (1,)).drop("value", "log_value"))


PANEL_COLUMNS = ["log_value", "mom_1y", "mom_1y_rel", "target_1y", "target_5y"]


@query("p_demean", sql(f"select entity, {DEC}, " + ", ".join(r(c) for c in ("mom_1y_rel", "mom_2y_rel", "mom_3y_rel", "target_1y", "target_2y", "target_3y", "target_5y")) + " from panel"))
def _(spark, sf):
    return V.rounded(V.panel(spark, sf).select(
        "entity", "midx", "mom_1y_rel", "mom_2y_rel", "mom_3y_rel", "target_1y", "target_2y", "target_3y", "target_5y"))


GROUP_COLUMNS = ["group_level_median", "level_rel_group", "group_level_spread", "group_mom_3y", "group_mom_1y", "group_log_size"]
SUB_COLUMNS = ["level_rel_sub", "sub_level_rel_group", "mom_1y_rel_sub", "sub_mom_1y_rel", "sub_mom_3y_rel"]


@query("a_group_levels", sql(f"select entity, {DEC}, " + ", ".join(r(c) for c in GROUP_COLUMNS) + " from panel"))
def _(spark, sf):
    return V.rounded(V.panel(spark, sf).select("entity", "midx", *GROUP_COLUMNS))


@query("a_subgroup_levels", sql(f"select entity, {DEC}, " + ", ".join(r(c) for c in SUB_COLUMNS) + " from panel"))
def _(spark, sf):
    return V.rounded(V.panel(spark, sf).select("entity", "midx", *SUB_COLUMNS))


@query("p_group_flags", sql(f"select entity, {DEC}, group_ok, in_focus from panel"))
def _(spark, sf):
    rows = V.part_panel(spark, sf).select("entity", "midx", "grp")
    return groups.group_flags(rows, V.OPT.min_group, V.FOCUS).drop("grp")


@query("b_group_slope", sql(f"select entity, {DEC}, {r('beta')} from slopes"))
def _(spark, sf):
    return V.rounded(V.panel(spark, sf).select("entity", "midx", "beta"))


# ---------------------------------------------------------------- joined features

_prev = "left join part_panel q on q.entity = a.entity and q.yr = a.yr - {0}"


@query("x_tempo", sql(f"""select a.entity, cast(a.yr * 12 + 11 as integer) as midx,
       {r('ln(a.inventory) - ln(q.inventory)', 'inventory_yoy')}, {r('ln(a.new_listings) - ln(q.new_listings)', 'new_listings_yoy')},
       {r('a.inventory / a.new_listings', 'inv_to_new_listings')}, cast(null as double) as days_pending, cast(null as double) as days_pending_yoy,
       {r('a.cut_share', 'price_cut_share')}, {r('a.cut_share - q.cut_share', 'price_cut_share_yoy')}
       from part_panel a {_prev.format(1)}"""))
def _(spark, sf):
    return V.rounded(plan.tempo_features(V.inputs(spark, sf).tempo).drop("_inventory"))


@query("x_rent", sql(f"""select entity, {DEC}, {r('rent_yield')}, {r('rent_yield - avg(rent_yield) over g', 'rent_yield_rel')},
       {r('rent_mom_2y')}, {r('rent_mom_2y - avg(rent_mom_2y) over g', 'rent_mom_2y_rel')}
       from (select a.entity, a.yr, a.grp, 12 * a.rent / a.val as rent_yield, ln(a.rent) - ln(q.rent) as rent_mom_2y
             from part_panel a {_prev.format(2)}) window g as (partition by yr, grp)"""))
def _(spark, sf):
    i = V.inputs(spark, sf)
    rows = V.part_panel(spark, sf).select("entity", "midx", "grp", F.col("val").alias("value"))
    rows = rows.join(plan.rent_features(i.rent, V.OPT.rent_lag), ["entity", "midx"], "left").withColumn(
        "rent_yield", scalar.ratio(12 * F.col("_rent"), F.col("value"))).drop("_rent", "value")
    twins = {f"{c}_rel": c for c in ("rent_yield", "rent_mom_2y")}
    return V.rounded(groups.demean(rows, ["midx", "grp"], twins).drop("grp"))


_months_sql = """(select year(l_shipdate) * 12 + month(l_shipdate) - 1 as midx, ln(median(l_extendedprice)) as natl from lineitem group by 1)"""


@query("a_national_median", f"select cast(midx as integer) as midx, {r('natl')} from {_months_sql}")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("entity"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("midx"),
        F.col("l_extendedprice").alias("value"),
    )
    return V.rounded(macro.national_log_median(rows))


@query("a_rolling_deviation", """select series, midx, round(case when count(val) over w >= 6 then val - avg(val) over w end, 6) + 0.0 as dev
       from (select p_type as series, cast(year(l_shipdate) * 12 + month(l_shipdate) - 1 as integer) as midx, median(l_extendedprice) as val
             from lineitem join part on l_partkey = p_partkey group by 1, 2)
       window w as (partition by series order by midx rows between 11 preceding and current row)""")
def _(spark, sf):
    rows = V.group_month(spark, sf)
    months = positions.medians(rows, ["series", "midx"], "price", ["l_orderkey", "l_linenumber"], "val")
    return V.rounded(macro.rolling_deviation(months, "val", "dev", 12, 6, by=("series",)).drop("val"))


@query("x_regime", f"""with m as (select a.midx, a.natl, a.natl - ln(c.v) as ptr from {_months_sql} a
         left join (select year(l_shipdate) * 12 + month(l_shipdate) - 1 as midx, avg(l_quantity) as v from lineitem group by 1) c on c.midx = a.midx),
       d as (select *, case when count(ptr) over w >= 6 then ptr - avg(ptr) over w end as dev from m
             window w as (order by midx rows between 11 preceding and current row))
       select cast(d.midx as integer) as midx, {r('r.value', 'rg_rate_level')}, {r('r.value - s.value', 'rg_rate_change_1y')},
              {r('d.natl - p.natl', 'rg_natl_mom_1y')}, {r('d.dev', 'rg_price_to_rent_dev')}
       from d left join {RATES} r on r.midx = d.midx left join {RATES} s on s.midx = d.midx - 12 left join m p on p.midx = d.midx - 12""")
def _(spark, sf):
    items = V.table(spark, sf, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("entity"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("midx"),
        F.col("l_extendedprice").alias("value"),
        "l_quantity",
    )
    index = items.groupBy("midx").agg(F.avg("l_quantity").alias("value"))
    rate = macro.last_observation_per_month(V.order_observations(spark, sf).withColumn("series", F.lit("rate")), "id")
    return V.rounded(macro.regime(items.drop("l_quantity"), rate, index, 12, 6))


@query("j_macro_on_panel", f"""select p.p_partkey as entity, cast(y.yr * 12 + 11 as integer) as midx, {r('m.value', 'rate')}
       from part p join (select distinct l_partkey, year(l_shipdate) as yr from lineitem) y on y.l_partkey = p.p_partkey
       left join {RATES} m on m.midx = y.yr * 12 + 11""")
def _(spark, sf):
    rate = macro.last_observation_per_month(V.order_observations(spark, sf).withColumn("series", F.lit("rate")), "id")
    rows = V.part_panel(spark, sf).select("entity", "midx")
    return V.rounded(rows.join(rate.select("midx", F.col("value").alias("rate")), "midx", "left"))


@query("j_vintage_asof", sql("""select cast(y.yr as integer) as origin_year, cast(max(v.vintage) as integer) as vintage
       from (select distinct yr from part_panel) y left join (select distinct vintage from vint) v on v.vintage <= y.yr - 2 group by 1"""))
def _(spark, sf):
    years = V.yearly(spark, sf).select(F.col("yr").alias("origin_year")).distinct()
    return vint.vintage_asof(years, V.vintages(spark, sf).select("vintage").distinct(), V.OPT.publication_lag)


@query("j_asof_attributes", sql(f"""with c as (select y.yr, max(v.vintage) as vintage from (select distinct yr from part_panel) y
         left join (select distinct vintage from vint) v on v.vintage <= y.yr - 2 group by 1)
       select a.entity, cast(a.yr as integer) as origin_year, cast(c.vintage as integer) as vintage, {r('v.part_a / v.total', 'share')},
              {r('ln(v.income)', 'log_income')} from part_panel a join c on c.yr = a.yr
       left join vint v on v.entity = a.sub and v.vintage = c.vintage""").replace(", c as", ", c as").replace(") with c as", "), c as"))
def _(spark, sf):
    rows = V.part_panel(spark, sf).select("entity", "sub", F.col("yr").alias("origin_year"))
    table = V.vintages(spark, sf)
    chosen = vint.vintage_asof(rows.select("origin_year").distinct(), table.select("vintage").distinct(), V.OPT.publication_lag)
    features = table.select(
        F.col("entity").alias("sub"), F.col("vintage").cast("int").alias("vintage"),
        scalar.ratio(F.col("part_a"), F.col("total")).alias("share"), scalar.log_pos(F.col("income")).alias("log_income"),
    )
    out = rows.join(chosen, "origin_year", "left").join(features, ["sub", "vintage"], "left")
    return V.rounded(out.select("entity", "origin_year", "vintage", "share", "log_income"))


@query("x_vintage_change", sql(f"""select v.entity, v.vintage, {r('v.income - o.income', 'd5_income', 4)}, {r('v.part_a / v.total - o.part_a / o.total', 'd5_share', 4)}
       from vint v left join vint o on o.entity = v.entity and o.vintage = v.vintage - 5"""))
def _(spark, sf):
    table = V.vintages(spark, sf).withColumn("share", scalar.ratio(F.col("part_a"), F.col("total")))
    return V.rounded(vint.vintage_changes(table, ("income", "share"), 5).select("entity", "vintage", "d5_income", "d5_share"), 4)


_n = lambda c: f"n.{c}"
_parts4 = " + ".join(f"coalesce(n.{c}, 0)" for c in ("male_25_29", "male_30_34", "female_25_29", "female_30_34"))
_moved = " + ".join(f"coalesce(n.{c}, 0)" for c in ("moved_other_county", "moved_other_state", "moved_abroad"))


@query("x_attribute_features", f"""with n as ({_codes_sql}) select entity, vintage, {r('ln(pop)', 'log_pop')}, {r('ln(median_income)', 'log_income')},
       {r('ln(median_rent)', 'log_attr_rent')}, {r('ln(housing_units)', 'log_housing_units')}, {r('median_age')},
       {r('case when median_year_built > 1000 then median_year_built end', 'median_year_built')}, {r(f'({_parts4}) / pop', 'young_adult_share')},
       {r('owner_occupied / occupied_units', 'owner_share')}, {r('vacant_units / housing_units', 'vacancy_share')},
       {r('edu_bachelors_plus / nullif(edu_total, 0)', 'bachelors_share')}, {r(f'({_moved}) / mobility_total', 'inflow_share')},
       {r('unemployed / labor_force', 'unemployment_rate')}, {r('transit_commuters / commuters', 'transit_share')} from n""")
def _(spark, sf):
    return V.rounded(vint.attribute_features(attributes.normalise_vintage(_codes(spark, sf), 2011)))


@query("x_attribute_ratios", sql(f"""select entity, midx, {r('price_to_income')}, {r('price_to_income - avg(price_to_income) over g', 'price_to_income_rel')},
       {r('attr_rent_to_price')}, {r('inv_per_1k_units')} from (
         select p.entity, cast(p.yr * 12 + 11 as integer) as midx, p.yr, p.grp, case when p.yr >= 1997 then p.log_value - ln(cast((p.entity * 9) % 97 + 1 as double)) end as price_to_income,
                case when p.yr >= 1997 then ln(cast((p.entity * 11) % 97 + 1 as double)) + ln(12) - p.log_value end as attr_rent_to_price,
                case when p.yr >= 1997 then 1000 * p.inventory / exp(ln(cast((p.entity * 12) % 97 + 1 as double))) end as inv_per_1k_units from hist p)
       window g as (partition by yr, grp)""", wide="select 1"))
def _(spark, sf):
    # The code table has padded keys, so join back through the padded part key.
    table = attributes.normalise_vintage(_codes(spark, sf), 1995)
    keys = V.parts(spark, sf).select(F.col("entity").alias("_k"), scalar.pad_key(F.col("entity").cast("string")).alias("entity"))
    features = vint.attribute_features(table).join(keys, "entity").drop("entity").withColumnRenamed("_k", "entity")
    rows = V.part_panel(spark, sf).select(
        "entity", "midx", "grp", F.col("yr").alias("origin_year"), F.ln("val").alias("log_value"), F.col("inventory").alias("_inventory"))
    chosen, found = plan.asof_attributes(rows, features, V.OPT)
    out = rows.join(chosen, "origin_year", "left").join(found, ["entity", "vintage"], "left").select("*", *plan.attribute_ratios())
    out = groups.demean(out, ["midx", "grp"], {"price_to_income_rel": "price_to_income"})
    return V.rounded(out.select("entity", "midx", "price_to_income", "price_to_income_rel", "attr_rent_to_price", "inv_per_1k_units"))


# ---------------------------------------------------------------- neighbours


@query("n_nearest", sql("""select entity, cast(i as integer) as rank, nbr, d as dist_km from (
       select *, row_number() over (partition by entity order by d, nbr) as i from pairs) where i <= 10"""))
def _(spark, sf):
    found = neighbours.nearest(V.points(spark, sf).drop("grp").withColumn("all", F.lit(0)), V.OPT.neighbours, ["all"])
    return found.select("entity", F.posexplode("neighbours").alias("i", "n")).select(
        "entity", (F.col("i") + 1).alias("rank"), F.col("n.entity").alias("nbr"), F.col("n.dist_km").alias("dist_km"))


@query("n_neighbour_gaps", sql(f"select entity, {DEC}, {r('nbr_level_gap')}, {r('nbr_mom_3y_gap')}, {r('nbr_dist_km', digits=4)} from nbr_gaps"))
def _(spark, sf):
    i = V.inputs(spark, sf)
    rows = cut_lineage(history.value_history(i.series, (3,), ()))
    gaps = neighbours.neighbour_gaps(rows, i.coords, V.OPT.neighbours, "mom_3y")
    return V.rounded(gaps.withColumn("nbr_dist_km", F.round("nbr_dist_km", 4)))


# ---------------------------------------------------------------- ranks

RANKED = ["log_value", "mom_1y", "mom_2y", "mom_3y", "beta", "level_rel_group", "level_rel_sub", "sub_level_rel_group", "mom_1y_rel_sub"]


@query("w_percentiles", sql(f"select entity, {DEC}, " + ", ".join(r(pct(c, "yr, grp"), f"cs_{c}") for c in RANKED) + " from panel"))
def _(spark, sf):
    out = positions.add_percentiles(V.written_panel(spark, sf).select("entity", "midx", "grp", *RANKED), ["midx", "grp"], ["entity", "midx"],
                                    {f"cs_{c}": c for c in RANKED})
    return V.rounded(out.select("entity", "midx", *[f"cs_{c}" for c in RANKED]))


@query("w_percentiles_with_ties", sql(f"select entity, {DEC}, {r(pct('inventory', 'yr, grp'), 'cs_inventory')}, {r(pct('new_listings', 'yr, grp'), 'cs_new_listings')} from part_panel"))
def _(spark, sf):
    rows = cut_lineage(V.part_panel(spark, sf).select("entity", "midx", "grp", "inventory", "new_listings"))
    out = positions.add_percentiles(rows, ["midx", "grp"], ["entity", "midx"], {"cs_inventory": "inventory", "cs_new_listings": "new_listings"})
    return V.rounded(out.select("entity", "midx", "cs_inventory", "cs_new_listings"))


_tp = [(f"fwd_{h}y", f"target_{h}y") for h in (1, 2, 3, 5)]


@query("w_target_percentiles", sql(f"select entity, {DEC}, " + ", ".join(
    [r(pct(f, "yr, grp"), f"{t}_pct") for f, t in _tp] + [r(pct(f, "yr, grp, sub"), f"{t}_sub_pct") for f, t in _tp]) + " from panel"))
def _(spark, sf):
    rows = V.written_panel(spark, sf).select("entity", "midx", "grp", "sub", *[f for f, _ in _tp])
    out = plan.add_ranks(rows.withColumn("mom_1y", F.lit(0.0)), (1, 2, 3, 5))
    return V.rounded(out.select("entity", "midx", *[f"{t}_pct" for _, t in _tp], *[f"{t}_sub_pct" for _, t in _tp]))


@query("b_grouped_spearman", sql(f"select cast(yr as integer) as origin_year, grp, n, {r('rho')} from ({spearman('yr, grp', 'mom_1y', 'fwd_1y', 'panel')})"))
def _(spark, sf):
    keys = ["origin_year", "grp"]
    return V.rounded(agreement.grouped_spearman(V.written_panel(spark, sf), keys, ["entity"], "mom_1y", "fwd_1y"))


@query("b_average_ranks", sql(f"""select entity, {DEC}, rank() over (partition by yr, grp order by inventory) + (count(*) over (partition by yr, grp, inventory) - 1) / 2.0 as rank_a,
       rank() over (partition by yr, grp order by fwd_1y) + (count(*) over (partition by yr, grp, fwd_1y) - 1) / 2.0 as rank_b
       from hist where inventory is not null and fwd_1y is not null"""))
def _(spark, sf):
    rows = V.part_panel(spark, sf).select("entity", "midx", "grp", "inventory", F.col("val").alias("value"))
    fwd = cut_lineage(rows.withColumn("fwd_1y", history.forward_log_change("value", 1)))
    return agreement.paired_ranks(fwd, ["midx", "grp"], ["entity"], "inventory", "fwd_1y").select("entity", "midx", "rank_a", "rank_b")


@query("b_trailing_signs", sql(f"""select p.entity, cast(p.yr * 12 + 11 as integer) as midx, {r('c.rho', 'rg_cheap_sign_1y')}, {r('m.rho', 'rg_mom_sign_1y')},
       {r('c.m', 'rg_cheap_sign_3y')}, {r('m.m', 'rg_mom_sign_3y')}, {r('gc.rho', 'rg_group_cheap_sign_1y')}, {r('gm.rho', 'rg_group_mom_sign_1y')}
       from panel p left join rolled c on c.factor = 'cheap' and c.yr = p.yr - 1 left join rolled m on m.factor = 'mom' and m.yr = p.yr - 1
       left join gsigns gc on gc.factor = 'cheap' and gc.yr = p.yr - 1 and gc.grp = p.grp
       left join gsigns gm on gm.factor = 'mom' and gm.yr = p.yr - 1 and gm.grp = p.grp"""))
def _(spark, sf):
    out = signs.add_trailing_signs(V.written_panel(spark, sf))
    return V.rounded(out.select("entity", "midx", *[c for c in out.columns if c.startswith("rg_")]))


@query("x_recency_weight", sql(f"select entity, {DEC}, {r('pow(0.5, ((select max(yr) from part_panel) - yr) / 4.0)', 'weight')} from part_panel"))
def _(spark, sf):
    rows = V.yearly(spark, sf).select("entity", "midx", "yr")
    newest = rows.agg(F.max("yr")).scalar()
    return V.rounded(rows.select("entity", "midx", scalar.recency_weight(newest - F.col("yr"), 4.0).alias("weight")))


@query("x_bands_and_pct", sql(f"""select entity, {DEC}, cast(least(floor(p * 20), 19) as integer) as band, {r('(exp(mom_1y) - 1) * 100', 'growth_pct')}
       from (select *, {pct('log_value', 'yr, grp')} as p from hist)"""))
def _(spark, sf):
    i = V.inputs(spark, sf)
    rows = history.value_history(i.series, (1,), ()).join(i.meta, "entity")
    out = positions.add_percentiles(cut_lineage(rows), ["midx", "grp"], ["entity", "midx"], {"p": "log_value"})
    return V.rounded(out.select("entity", "midx", scalar.band_index(F.col("p")).alias("band"), scalar.pct_from_log(F.col("mom_1y")).alias("growth_pct")))


@query("x_sum_and_share", """select p_partkey as entity, case when a is null and b is null then null else coalesce(a, 0) + coalesce(b, 0) end as sum_known,
       (coalesce(a, 0) + coalesce(b, 0)) / p_retailprice as share from (select *, case when p_size > 10 then cast(p_size as double) end as a,
       case when p_size < 30 then cast(p_size as double) * 2 end as b from part)""")
def _(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    a, b = F.when(size > 10, size), F.when(size < 30, size * 2)
    return V.table(spark, sf, "part").select(
        k.alias("entity"), scalar.sum_or_null([a, b]).alias("sum_known"), scalar.share_of_parts([a, b], F.col("p_retailprice")).alias("share"))


# ---------------------------------------------------------------- the whole panel

_VINTAGE = ["log_pop", "log_income", "log_attr_rent", "log_housing_units", "median_age", "median_year_built", "young_adult_share",
            "owner_share", "vacancy_share", "bachelors_share", "inflow_share", "unemployment_rate", "transit_share"]
ENTITY_LEVEL = [
    "log_value", *[f"mom_{k}y" for k in LAGS], "level_rel_group", "beta", *SUB_COLUMNS, *plan.TEMPO_COLUMNS,
    "nbr_level_gap", "nbr_mom_3y_gap", "nbr_dist_km", "rent_mom_2y", "rent_yield", *_VINTAGE,
    *[f"d2_{c}" for c in vint.CHANGE_COLUMNS], "price_to_income", "attr_rent_to_price", "inv_per_1k_units",
]
TWINS = ["rent_yield", "rent_mom_2y", *plan.ATTRIBUTE_TWINS, *[f"d2_{c}" for c in vint.CHANGE_COLUMNS]]
SIGNS = [f"rg_{f}_sign_{k}y" for f in ("cheap", "mom") for k in (1, 3)] + [f"rg_group_{f}_sign_1y" for f in ("cheap", "mom")]
OTHERS = [*[f"mom_{k}y_rel" for k in LAGS], *[f"fwd_{h}y" for h in HORIZONS], *[f"target_{h}y" for h in HORIZONS],
          *[c for c in GROUP_COLUMNS if c != "level_rel_group"], *[f"{c}_rel" for c in TWINS], *plan.REGIME_COLUMNS, *SIGNS]


@query("p_whole_panel", sql(f"""select entity, {DEC}, cast(yr as integer) as origin_year, grp, sub, cast(vintage as integer) as vintage, group_ok, in_focus,
       """ + ", ".join(r(c, digits=8) for c in [*ENTITY_LEVEL, *OTHERS]) + " from whole"))
def _(spark, sf):
    """The whole plan with every source: all columns but the percentiles. Eight places, as means of a few short decimals end
    in a half at the seventh."""
    out = plan.build_panel(V.every_input(spark, sf), V.WHOLE)
    return V.rounded(out.select("entity", "midx", "origin_year", "grp", "sub", "vintage", "group_ok", "in_focus", *ENTITY_LEVEL, *OTHERS), 8)


# Columns that rank like another one (`_rel`) or hold one value for a group have no percentile.
RANKED_OF_ALL = [c for c in ENTITY_LEVEL if not c.endswith("_rel")]


@query("w_all_percentiles", sql(f"select entity, {DEC}, " + ", ".join(
    [r(pct(c, "yr, grp"), f"cs_{c}") for c in RANKED_OF_ALL] + [r(pct(f, "yr, grp"), f"{t}_pct") for f, t in _tp]
    + [r(pct(f, "yr, grp, sub"), f"{t}_sub_pct") for f, t in _tp]) + " from fixed",
    fixed="select entity, yr, grp, sub, " + ", ".join(r(c, digits=9) for c in [*RANKED_OF_ALL, *[f for f, _ in _tp]]) + " from whole"))
def _(spark, sf):
    """Every percentile column of the whole panel. Sums end differently in their last places from engine to engine, which
    would tell equal values apart, so both sides rank values of nine places."""

    def ranked():
        i = V.every_input(spark, sf)
        base = settle(lambda: plan.base_panel(i, V.WHOLE))
        # Only what is ranked: every other column would go through the shuffle of the ranking.
        wanted = {"entity", "midx", "grp", "sub", *RANKED_OF_ALL, *[f for f, _ in _tp]}
        whole = plan.add_sources(base, i, V.WHOLE)
        return V.rounded(whole.select(*[c for c in whole.columns if c in wanted]), 9)

    rows = settle(ranked)
    out = plan.add_ranks(rows, HORIZONS)
    found = [c for c in out.columns if c.startswith("cs_") or c.endswith("_pct")]
    return V.rounded(out.select("entity", "midx", *found))


@query("w_split_ranks_with_null_keys", """with t as (select o_orderkey, case when o_orderstatus <> 'F' then o_orderstatus end as status, floor(o_totalprice / 1000) as v from orders)
       select o_orderkey, status, cast(rank() over (partition by status order by v) - 1 as bigint) as before,
              cast(count(*) over (partition by status, v) as bigint) as ties, cast(count(*) over (partition by status) as bigint) as n from t""")
def _(spark, sf):
    """Positions with few rows per range, so that every key is cut; NULL is the largest of them."""
    status = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status")
    rows = V.table(spark, sf, "orders").select("o_orderkey", status, F.floor(F.col("o_totalprice") / 1000).alias("v"))
    out = positions.with_positions(rows, ["status"], "v", ["o_orderkey"], positions.SplitPlan(256, 64, 4))
    return out.select("o_orderkey", "status", F.col("_before").alias("before"), F.col("_ties").cast("long").alias("ties"), F.col("_n").alias("n"))
