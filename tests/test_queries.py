import glob
import os

import __spark_entry__
import duckdb
import pytest
from palimpsest.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE:
        assert got.count() >= 0
        return
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*(f"`{c}`" for c in columns)).collect()]
    assert sorted(rows, key=str) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "o_custkey", "o_orderstatus"]
