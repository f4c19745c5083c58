"""Every registered spatial query against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from fieldstats.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else x
    return sorted(repr(tuple(clean(x) for x in row)) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, tables, name):
    found = plans.queries()[name](spark, DATA).toPandas()
    if name in plans.oracle_sql():
        wanted = tables.execute(plans.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert canonical(found) == canonical(wanted)
    else:
        assert len(found) > 0
