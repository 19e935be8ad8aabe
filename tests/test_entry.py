import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [df.columns.index(c) for c in want.columns]
    assert sorted([plain(r[i]) for i in order] for r in df.collect()) == sorted([plain(v) for v in r] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
