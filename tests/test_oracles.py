"""Every cadastre query against its SQL in DuckDB, over the smallest tables."""

import glob
import os

import pytest

from plumbline.plans.records import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(df):
    num = lambda v: repr(float(v)) if hasattr(v, "__float__") and not isinstance(v, (str, bool)) else str(v)
    cols = sorted(df.columns)
    return cols, sorted(tuple("None" if v is None or v != v else num(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in ORACLES:
        assert norm(got) == norm(duck.sql(ORACLES[name]).df())
