"""Every evidence query gives the rows of its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from lodesift import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(rows):
    return sorted((tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = _plain(map(tuple, df.select(*columns).collect()))
    theirs = _plain(duck.sql(f"SELECT {', '.join(columns)} FROM ({plans.SQL[name]})").fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0
