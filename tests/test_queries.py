"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from folioscope import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if type(x).__name__.startswith(("float", "double")):
        return round(float(x), 9)
    if type(x).__name__.startswith("bool"):
        return bool(x)
    return int(x) if hasattr(x, "__index__") else x


def rows(frame):
    return sorted(repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_its_sql(spark, con, name):
    found, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    frame = plans.QUERIES[name](spark, SF)
    assert frame.count() > 0 and frame.columns
