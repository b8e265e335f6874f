"""Every query against its SQL in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from shalecrest import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(float(v), 4)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.SQL:
        assert rows(got) == rows(con.execute(plans.SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() == 25  # the five nearest of each hundredth vector


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
