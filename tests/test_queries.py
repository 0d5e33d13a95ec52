"""Every registered query with an oracle equals DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from fringeworks.plans.observation_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(con.sql(ORACLES[name]).df())
    else:
        assert len(got)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
