"""Every relational query against DuckDB on the supplied tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tarnlight import plans

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    ours = plans.queries()[name](spark, SF)
    theirs = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert Counter(map(tuple, ours.select(*columns).collect())) == Counter(theirs.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = plans.queries()["nation_revenue"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in plan
