"""Every registered query against its SQL on the smallest data set."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidebar import plans

SF = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, float):
        return "NaN" if v != v else repr(v + 0.0)
    return repr(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in found)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    relation = duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert got == rows(relation.columns, relation.fetchall())


def test_every_query_has_sql():
    assert plans.QUERIES.keys() == plans.ORACLES.keys()
    assert plans.QUERIES.keys() <= entry_module.queries().keys()
    assert plans.ORACLES.keys() <= entry_module.oracle_sql().keys()


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
