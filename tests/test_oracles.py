"""Every registered query of the main library against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillmesh.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def one(x):
    if x is None or x is pd.NA or isinstance(x, float) and x != x:
        return "~"
    if not isinstance(x, str) and float(x) == int(x):
        return str(int(x))
    return str(x)


def rows(df):
    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLES[name]).df())
