"""Every query with SQL agrees with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from vellum.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return repr(round(float(v), 6)) if not hasattr(v, "shape") or v.shape == () else str(list(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, sf, duck, name):
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    a, b = (sorted(tuple(plain(x) for x in r) for r in t[columns].astype(object).itertuples(index=False)) for t in (ours, theirs))
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 0
