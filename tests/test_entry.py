import duckdb
import pytest

import __spark_entry__ as registry
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SOME = ["p_momentum", "a_group_levels", "e_rule_scores", "j_asof_attributes", "n_nearest", "t_banned_phrases", "x_regime"]


def test_entry_runs(spark):
    df = registry.entry(spark)
    assert df.columns == ["origin_year", "n", "rho"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", SOME)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = registry.queries()[name](spark, SF)
    result = con.execute(registry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())
