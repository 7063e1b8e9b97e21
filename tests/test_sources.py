import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelwright.functions.scalar import pad_key
from panelwright.operators.macro import last_observation_per_month
from panelwright.sources import attributes, panels, wide

WIDE = (
    "RegionID,SizeRank,RegionName,RegionType,StateName,State,City,Metro,CountyName,2019-12-31,2020-01-31\n"
    "31,5,412,area,QQ,QQ,Port,G1,S1,64.25,\n32,6,90311,area,RR,RR,Hill,G2,S2,,3\n33,7,412345,area,RR,RR,Dale,G2,S3,none,1e3\n"
)


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_wide_file_to_series_and_meta(spark, tmp_path):
    raw = wide.read_wide(spark, put(tmp_path, "w.csv", WIDE))
    got = {(r["entity"], r["midx"]): r["value"] for r in wide.wide_series(raw).collect()}
    assert got == {("00412", 2019 * 12 + 11): 64.25, ("90311", 2020 * 12): 3.0, ("412345", 2020 * 12): 1000.0}
    meta = {r["entity"]: tuple(r) for r in wide.wide_meta(raw).select("entity", "state", "city", "grp", "sub").collect()}
    assert meta["00412"] == ("00412", "QQ", "Port", "G1", "S1") and len(meta) == 3


def test_absent_files_give_empty_tables_of_the_same_shape(spark, tmp_path):
    path = str(tmp_path / "no.csv")
    assert wide.optional_series(spark, path).schema.simpleString() == "struct<entity:string,midx:int,value:double>"
    assert wide.optional_forecast(spark, path).count() == 0


def test_outside_forecast_reads_one_year_ahead(spark, tmp_path):
    dates = ["2031-05-31", "2032-01-31", "2032-02-29", "2032-05-31"]
    head = WIDE.split(",2019")[0] + ",BaseDate," + ",".join(dates)
    lines = [f"{i},{i},{60 + i},area,QQ,QQ,Port {i},G{i},S{i},2031-02-28," + ",".join(f"{i}.{k}" for k in range(4)) for i in range(1, 5)]
    lines.append("9,9,123456,area,QQ,QQ,Port,G,S,2031-02-28,5,5,unknown,5")
    path = put(tmp_path, "f.csv", "\n".join([head, *lines]) + "\n")
    got = {r["entity"]: r["forecast_1y_pct"] for r in wide.optional_forecast(spark, path).collect()}
    assert got == {**{f"{60 + i:05d}": i + 0.2 for i in range(1, 5)}, "123456": None}
    mixed = put(tmp_path, "g.csv", "\n".join([head, *lines[:2], lines[2].replace("2031-02-28", "2031-03-31")]) + "\n")
    with pytest.raises(ValueError):
        wide.optional_forecast(spark, mixed)


def test_nearest_column_takes_the_first_of_a_tie():
    base = dt.date(2030, 6, 10)
    near = [f"2031-06-{d:02d}" for d in (12, 8, 4)]
    assert wide.nearest_column(near, base) == near[0] and wide.nearest_column(near[::-1], base) == near[1]


def test_coordinates_with_padded_headers(spark, tmp_path):
    path = put(tmp_path, "g.txt", "GEOID\tALAND\tINTPTLAT\tINTPTLONG   \n601\t1\t18.18\t -66.75\n")
    assert wide.read_coordinates(spark, path).first().asDict() == {"entity": "00601", "lat": 18.18, "lon": -66.75}


def test_last_observation_of_each_month_by_hand(spark, tmp_path):
    days = [dt.date(1995, 11, 3) + dt.timedelta(days=9 * i) for i in range(40)]
    value = [None if i % 4 == 1 or d.month == 3 else 2 + (i * 7 % 11) / 8 for i, d in enumerate(days)]
    text = "\n".join(["day,x", *[f"{d},{'.' if v is None else v}" for d, v in zip(days[::-1], value[::-1])]]) + "\n"
    got = {r["midx"]: r["value"] for r in last_observation_per_month(wide.read_observations(spark, put(tmp_path, "o.csv", text), "x")).collect()}
    assert got == {d.year * 12 + d.month - 1: v for d, v in zip(days, value) if v is not None}  # later days overwrite


def test_pad_key_keeps_long_keys(spark):
    df = spark.createDataFrame([("1",), ("12345",), ("1234567",)], "k string")
    assert [r[0] for r in df.select(pad_key(F.col("k"))).collect()] == ["00001", "12345", "1234567"]


def codes_table(spark, table):
    row = {code: "10" for code in attributes.BASE_CODES.values()}
    row["B19013_001E"], row["B01002_001E"] = "-666666666", "n/a"
    codes = [c for group in attributes.EDUCATION_CODES[table].values() for c in group]
    row |= {c: ("-666666666" if i == 1 else "2") for i, c in enumerate(codes)}
    row[attributes.ENTITY_COLUMN] = "601"
    return spark.createDataFrame([row])


@pytest.mark.parametrize("table, degrees", [("B15003", 6.0), ("B15002", 14.0)])
def test_vintages_are_normalised(spark, table, degrees):
    r = attributes.normalise_vintage(codes_table(spark, table), 2012).first()
    assert r["entity"] == "00601" and r["vintage"] == 2012 and r["pop"] == 10.0
    assert r["median_income"] is None and r["median_age"] is None
    assert r["edu_bachelors_plus"] == degrees and r["edu_total"] == 2.0


def test_missing_codes_are_an_error(spark):
    full = codes_table(spark, "B15003")
    with pytest.raises(ValueError):
        attributes.normalise_vintage(full.drop("B15003_001E"), 2012)
    with pytest.raises(ValueError):
        attributes.normalise_vintage(full.drop("B01003_001E"), 2012)


def test_header_row_json_and_vintage_files(spark, tmp_path):
    text = json.dumps([["pop", "name", "zip code tabulation area"], ["5", "x", "00601"], ["6", None, "00602"]])
    got = attributes.read_header_row_json(spark, put(tmp_path, "a.json", text), ["zip code tabulation area", "pop"]).collect()
    assert [tuple(r) for r in got] == [("00601", "5"), ("00602", "6")]
    table = spark.createDataFrame([("a", 2011, 1.0), ("a", 2012, 2.0)], "entity string, vintage int, v double")
    attributes.write_vintages(table, str(tmp_path / "v"))
    assert attributes.read_vintages(spark, str(tmp_path / "v")).where("vintage = 2012").first()["v"] == 2.0
    (tmp_path / "files").mkdir()
    table.where("vintage = 2011").drop("vintage").toPandas().to_parquet(tmp_path / "files" / "attr_2011.parquet")
    assert attributes.read_vintage_files(spark, str(tmp_path / "files" / "*.parquet")).first()["vintage"] == 2011


def test_panel_round_trip_and_missing_targets(spark, tmp_path):
    panel = spark.createDataFrame([("a", 2000, 0.1), ("a", 2001, 0.2)], "entity string, origin_year int, target_1y double")
    panels.write_panel(panel, str(tmp_path / "p"))
    back = panels.read_panel(spark, str(tmp_path / "p"), (1,))
    assert back.where("origin_year = 2001").first()["target_1y"] == 0.2
    with pytest.raises(ValueError):
        panels.read_panel(spark, str(tmp_path / "p"), (1, 5))


def test_result_tables_drop_horizons_that_were_not_run(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "horizon int, model string")
    path = str(tmp_path / "r")
    panels.write_by_horizon(table, path)
    panels.write_by_horizon(table.where("horizon = 1"), path)
    assert [r["model"] for r in spark.read.csv(path, header=True).collect()] == ["a"]
    panels.write_table(table, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 2
