"""Each query of the relational core against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quarryflow.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    answer = duck.execute(sql)
    place = [[x[0] for x in answer.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in answer.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_are_pruned(spark):
    plan = catalog.revenue_by_nation_priority(spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plan
    assert "o_orderstatus" not in plan.split("== Physical Plan ==")[1]
