"""What keeps large runs small: rounding without text, values that travel with neighbours, tables that go when read."""

import functools
import os

import numpy as np
from pyspark.sql import functions as F

from checks.views import rounded
from panelwright.operators import chunks, positions
from panelwright.operators.neighbours import nearest, neighbour_gaps
from panelwright.operators.positions import SplitPlan, add_percentiles
from panelwright.options import PanelOptions
from panelwright.plans.panel import PanelInputs, build_panel


def tables(spark):
    """Folders of tables under the shared folder of this session."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return {n for n in os.listdir(shared) if n.startswith("panelwright-")}


def test_rounding_by_numbers_is_rounding_by_decimals(spark):
    rng = np.random.default_rng(5)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e300, -1e-300, 0.1234565, -0.1234565, 2.5e-6, 0.5e-6, 1.0000005, 123456789.0123455, 4.4e6, 4.5e12]
    values += [float(v) for v in rng.normal(0, 1, 300)] + [float(v) for v in rng.integers(-4000, 4000, 300) / 2e6] + [float(v) for v in 10.0 ** rng.uniform(-9, 17, 300)]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    for digits in (4, 6, 8, 9):
        got = [r[0] for r in rounded(df, digits).collect()]
        want = [r[0] for r in df.select(F.round("v", digits) + F.lit(0.0)).collect()]
        assert [repr(x) for x in got] == [repr(x) for x in want]


def test_rounding_of_many_columns_is_written_as_code_that_the_jvm_compiles(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def world(spark):
    rows = [(e, y * 12 + 11, 100.0 + 3 * e + (y - 1990) * (1 + e % 4) + (e * y) % 7) for e in range(24) for y in range(1990, 1998)]
    series = spark.createDataFrame(rows, "entity long, midx int, value double")
    meta = spark.createDataFrame([(e, f"g{e % 2}", f"s{e % 3}") for e in range(24)], "entity long, grp string, sub string")
    coords = spark.createDataFrame([(e, 40.0 + e // 2, 5.0 + e % 5) for e in range(24)], "entity long, lat double, lon double")
    return PanelInputs(series, meta, coords=coords)


OPT = PanelOptions(min_origin_year=1991, lags=(1, 3), horizons=(1,), rent_lag=2, beta_window=4, beta_min=3, min_group=2, focus_group="g0")


def test_no_row_per_neighbour_is_shuffled(spark):
    panel = spark.createDataFrame([(e, 0, float(e), e / 2) for e in range(30)], "entity long, midx int, log_value double, mom_3y double")
    coords = spark.createDataFrame([(e, float(e + 1), 10.0) for e in range(30)], "entity long, lat double, lon double")
    gaps = neighbour_gaps(panel, coords, 2, "mom_3y")
    found = {r["entity"]: r for r in gaps.collect()}
    assert len(found) == 30 and found[10]["nbr_level_gap"] == 0.0 and found[0]["nbr_level_gap"] == -1.5 and found[0]["nbr_mom_3y_gap"] == -0.75
    # Between the rows per neighbour and their means stands no join: in the plan, both aggregates lie above one generator.
    lines = gaps._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate explode(neighbours" in line or "Generate explode(slice" in line)
    above = [line.split("- ")[-1].split()[0] for line in lines[:at] if "- " in line]
    assert "Aggregate" in above and not any(x.startswith("Join") for x in above[above.index("Aggregate"):])


def test_a_built_panel_leaves_only_the_tables_it_reads(spark):
    before = tables(spark)
    panel = build_panel(world(spark), OPT)
    made = tables(spark) - before
    read = {p for p in made if any(p in f for f in panel.inputFiles())}
    assert panel.count() == 24 * 7 and made == read and len(made) == 2  # rows with every source, means of groups


def test_columns_sent_in_batches_get_the_same_positions(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 3), f"s{i % 5}" if i % 7 else None, *[None if rng.random() < 0.1 else float(rng.integers(40)) for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k int, s string, a double, b double, c double")
    plan = SplitPlan(rows_per_split=64, max_splits=8)
    cells = {"pa": "a", "pb": "b", "pc": "c"}
    want = {r["id"]: r for r in add_percentiles(df, ["k"], ["id"], cells, plan, {"s": {"sa": "a"}}).collect()}
    before = tables(spark)
    for n, per in ((2, 1 << 20), (4, 64)):
        monkeypatch.setattr(positions, "with_spots", functools.partial(chunks.with_spots, batch_cells=400 * 4 // n, chunk_rows=100))
        got = {r["id"]: r for r in add_percentiles(df, ["k"], ["id"], cells, SplitPlan(rows_per_split=per, max_splits=8), {"s": {"sa": "a"}}).collect()}
        assert got == want
    assert len(tables(spark) - before) == 2 + 4


def test_repeated_keys_weigh_as_often_as_they_stand_in_the_panel(spark):
    rows = [(e, 0, e + 0.5 * i, None if (e + i) % 4 == 0 else e / 2 + i) for e in range(12) for i in range(1 + (e % 3 == 0) + (e % 4 == 0))]
    panel = spark.createDataFrame(rows, "entity long, midx int, log_value double, mom_3y double")
    coords = spark.createDataFrame([(e, float(e * e + 1), 10.0) for e in range(8) for _ in range(1 + e % 2)], "entity long, lat double, lon double")
    points = panel.select("midx", "entity").join(coords, "entity")
    near = nearest(points, 3, ["midx"]).select("midx", "entity", F.explode("neighbours").alias("n")).select("midx", "entity", "n.dist_km", F.col("n.entity").alias("other"))
    values = panel.select("midx", F.col("entity").alias("other"), F.col("log_value").alias("v"), F.col("mom_3y").alias("m"))
    means = near.join(values, ["midx", "other"]).groupBy("entity").agg(F.avg("v").alias("v"), F.avg("m").alias("m"), F.avg("dist_km").alias("d"))
    want = panel.join(means, "entity").select("entity", F.col("log_value") - F.col("v"), F.col("mom_3y") - F.col("m"), "d").collect()
    got = neighbour_gaps(panel, coords, 3, "mom_3y").select("entity", "nbr_level_gap", "nbr_mom_3y_gap", "nbr_dist_km").collect()
    plain = lambda rows: sorted([-99.0 if x is None else round(x, 9) for x in r] for r in rows)
    assert len(want) == len(got) > 8 and plain(want) == plain(got)
