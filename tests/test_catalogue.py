"""Every query with an SQL equivalent against DuckDB, at two scales."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph.plans import catalogue

@pytest.fixture(scope="module", params=["0.001", "0.01"])
def tables(request):
    """At sf0.001 some nations don't trade with each other, and all are small."""
    d, c = f"/root/testdata/sf{request.param}", duckdb.connect()
    for f in os.listdir(d):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    return d, c


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([r[k] for k in order] for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, tables, name):
    d, con = tables
    df = catalogue.QUERIES[name](spark, d)
    sql = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in sql.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(map(tuple, df.collect()), df.columns) == rows(sql.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalogue.ORACLES.keys() <= entry.oracle_sql().keys()
