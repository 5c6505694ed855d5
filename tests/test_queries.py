"""Each query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def say(row):
    return repr(tuple(round(x, 9) if isinstance(x, float) else x for x in row))


ONE_ROW = {"build_statistics", "category_share", "facet_share"}  # one row meets one row, or many


def no_nested_loops(df, name):
    """Joins have an equal key, but for sides of one row."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    loops = plan.count("NestedLoopJoin") + plan.count("CartesianProduct")
    assert loops == 0 or name in ONE_ROW or ("_some" in plan and loops <= plan.count("_some"))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    no_nested_loops(df, name)
    cols = sorted(df.columns)
    sql = duck.sql(entry.oracle_sql()[name])
    assert sorted(sql.columns) == cols
    want = sql.select(*(f'"{c}"' for c in cols)).fetchall()
    assert sorted(map(say, df.select(*(f"`{c}`" for c in cols)).collect())) == sorted(map(say, want))


def test_entry(spark, duck):
    assert entry.entry(spark).count() > 0
