"""Series, attributes and coordinates to one feature panel, as a single lazy plan.

There is no loop over origins: an origin is a column, and every step below is a join or an aggregate over all
origins at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalar import ratio, ratio_over_positive
from panelwright.operators.features import ranked_columns
from panelwright.operators.groups import demean, group_features, group_means
from panelwright.operators.history import difference, log_change, origins, panel_base, value_history
from panelwright.operators.macro import regime
from panelwright.operators.neighbours import neighbour_gaps
from panelwright.operators.positions import DEFAULT_PLAN, SplitPlan, add_percentiles
from panelwright.operators.signs import add_trailing_signs
from panelwright.operators.vintages import CHANGE_COLUMNS, vintage_asof, vintage_changes
from panelwright.options import PanelOptions
from panelwright.session import cut_lineage, settle

TEMPO_SERIES = ("inventory", "new_listings", "days_pending", "price_cut_share")
TEMPO_COLUMNS = (
    "inventory_yoy",
    "new_listings_yoy",
    "inv_to_new_listings",
    "days_pending",
    "days_pending_yoy",
    "price_cut_share",
    "price_cut_share_yoy",
)
REGIME_COLUMNS = ("rg_rate_level", "rg_rate_change_1y", "rg_natl_mom_1y", "rg_price_to_rent_dev")


@dataclass(frozen=True)
class PanelInputs:
    """Long monthly series (entity, midx, value), entity metadata (entity, grp, sub, ...) and optional sources."""

    series: DataFrame
    meta: DataFrame
    rent: DataFrame | None = None
    tempo: dict[str, DataFrame] = field(default_factory=dict)
    rate: DataFrame | None = None
    rent_index: DataFrame | None = None
    coords: DataFrame | None = None
    attributes: DataFrame | None = None  # entity, vintage and the columns of `attribute_features`


def base_panel(inputs: PanelInputs, opt: PanelOptions, plan: SplitPlan = DEFAULT_PLAN) -> DataFrame:
    """Entity-by-origin rows with momentum, outcomes, beta, group and subgroup features."""
    history = value_history(inputs.series, opt.lags, opt.horizons, opt.beta_window)
    rows = panel_base(history, origins(inputs.series, opt.min_origin_year), inputs.meta)
    return group_features(cut_lineage(rows), opt, plan)


def tempo_features(tempo: dict[str, DataFrame]) -> DataFrame | None:
    """(entity, midx, tempo columns, inventory). A series that is absent leaves its columns NULL."""
    if not tempo:
        return None
    parts = [tempo[n].select("entity", "midx", F.lit(n).alias("name"), "value") for n in TEMPO_SERIES if n in tempo]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    wide = long.groupBy("entity", "midx").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).cast("double").alias(n) for n in TEMPO_SERIES]
    )
    return wide.select(
        "entity",
        "midx",
        log_change("inventory", 1).alias("inventory_yoy"),
        log_change("new_listings", 1).alias("new_listings_yoy"),
        ratio_over_positive(F.col("inventory"), F.col("new_listings")).alias("inv_to_new_listings"),
        "days_pending",
        difference("days_pending", 1).alias("days_pending_yoy"),
        "price_cut_share",
        difference("price_cut_share", 1).alias("price_cut_share_yoy"),
        F.col("inventory").alias("_inventory"),
    )


def rent_features(rent: DataFrame, years: int) -> DataFrame:
    return rent.select(
        "entity", "midx", F.col("value").alias("_rent"), log_change("value", years).alias(f"rent_mom_{years}y")
    )


def asof_attributes(panel: DataFrame, attributes: DataFrame, opt: PanelOptions) -> tuple[DataFrame, DataFrame]:
    """The vintage each origin reads (one for all its entities) and the attributes with their changes."""
    features = vintage_changes(attributes, CHANGE_COLUMNS, opt.vintage_gap)
    chosen = vintage_asof(
        panel.select("origin_year").distinct(), features.select("vintage").distinct(), opt.publication_lag
    )
    return chosen, features


def add_sources(panel: DataFrame, inputs: PanelInputs, opt: PanelOptions, plan: SplitPlan = DEFAULT_PLAN) -> DataFrame:
    """Join every optional source onto the base rows, with the ratios' group-relative twins, which need one aggregate."""
    return demean(join_sources(panel, inputs, opt), GROUP, twins(inputs, opt))


def twins(inputs: PanelInputs, opt: PanelOptions) -> dict[str, str]:
    """Columns less their group's mean, and what they are made from."""
    sources = ["rent_yield", f"rent_mom_{opt.rent_lag}y"]
    if inputs.attributes is not None:
        sources += ATTRIBUTE_TWINS + [f"d{opt.vintage_gap}_{c}" for c in CHANGE_COLUMNS]
    return {f"{c}_rel": c for c in sources}


def join_sources(panel: DataFrame, inputs: PanelInputs, opt: PanelOptions) -> DataFrame:
    """Every optional source joined onto the base rows. A source that is absent leaves its columns NULL, so the
    schema never depends on which files were there."""
    missing = F.lit(None).cast("double")
    momentum = f"mom_{opt.long_lag}y"
    rent_mom = f"rent_mom_{opt.rent_lag}y"

    def joined(rows, found, keys, columns):
        if found is None:
            return rows.select("*", *[missing.alias(c) for c in columns])
        return rows.join(found, keys, "left")

    ids = ["entity", "midx"]
    months = None
    if inputs.rate is not None and inputs.rent_index is not None:
        months = regime(inputs.series, inputs.rate, inputs.rent_index, opt.macro_window, opt.macro_min)
    rent = None if inputs.rent is None else rent_features(inputs.rent, opt.rent_lag)
    near = None if inputs.coords is None else neighbour_gaps(panel, inputs.coords, opt.neighbours, momentum)

    rows = joined(panel, tempo_features(inputs.tempo), ids, (*TEMPO_COLUMNS, "_inventory"))
    rows = joined(rows, months, ["midx"], REGIME_COLUMNS)
    rows = joined(rows, rent, ids, ("_rent", rent_mom))
    rows = joined(rows, near, ids, ("nbr_level_gap", f"nbr_{momentum}_gap", "nbr_dist_km"))
    rows = rows.withColumn("rent_yield", ratio(12 * F.col("_rent"), F.col("value"))).drop("_rent")
    if inputs.attributes is not None:
        chosen, features = asof_attributes(panel, inputs.attributes, opt)
        rows = rows.join(chosen, "origin_year", "left").join(features, ["entity", "vintage"], "left")
        rows = rows.select("*", *attribute_ratios())
    return rows.drop("_inventory")


GROUP = ["midx", "grp"]
ATTRIBUTE_TWINS = ["price_to_income", "log_income", "bachelors_share", "young_adult_share"]


def attribute_ratios() -> list:
    """Attributes against the value, and listings per thousand housing units."""
    return [
        (F.col("log_value") - F.col("log_income")).alias("price_to_income"),
        (F.col("log_attr_rent") + F.ln(F.lit(12.0)) - F.col("log_value")).alias("attr_rent_to_price"),
        ratio(1000 * F.col("_inventory"), F.exp("log_housing_units")).alias("inv_per_1k_units"),
    ]


def add_ranks(panel: DataFrame, horizons: tuple[int, ...], plan: SplitPlan = DEFAULT_PLAN) -> DataFrame:
    """Percentiles inside (origin, group) of every entity-level feature and outcome, and of the outcome inside
    (origin, group, subgroup), all in one ranking pass: the group is one more part of the key."""
    features = ranked_columns(panel)
    keyed = panel.withColumn("_sub", F.coalesce("sub", F.lit("")))
    within_group = {**{f"cs_{c}": c for c in features}, **{f"target_{h}y_pct": f"fwd_{h}y" for h in horizons}}
    within_sub = {f"target_{h}y_sub_pct": f"fwd_{h}y" for h in horizons}
    return add_percentiles(
        keyed, ["midx", "grp"], ["entity", "midx"], within_group, plan, narrower={"_sub": within_sub}
    ).drop("_sub")


def build_panel(inputs: PanelInputs, opt: PanelOptions, plan: SplitPlan = DEFAULT_PLAN) -> DataFrame:
    """The whole panel. Several statistics read the base rows and the rows with every source, so both are written; base rows
    go when the second table stands. Twins are made from that table while it is read: nothing is joined twice for them."""

    def sources() -> DataFrame:
        base = settle(lambda: base_panel(inputs, opt, plan))
        rows = join_sources(base, inputs, opt)
        plain.extend(rows.columns)
        if 1 in opt.horizons and 1 in opt.lags:
            rows = add_trailing_signs(
                rows, base, window=opt.sign_window, minimum=opt.sign_min, min_pairs=opt.min_pairs, plan=plan
            )
        return rows

    plain: list[str] = []
    rows = settle(sources)
    relative = twins(inputs, opt)
    # Means are written: small, and the same whenever the rows are read.
    found = demean(rows, GROUP, relative, cut_lineage(group_means(rows, GROUP, relative)))
    signs = [c for c in rows.columns if c not in plain]
    return add_ranks(found.select(*plain, *relative, *signs), opt.horizons, plan)
