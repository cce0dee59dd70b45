"""Every query of the suite against its SQL."""

import glob
import os

import duckdb
import pytest

from nearvote.plans import suite

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, db, name):
    got = suite.QUERIES[name](spark, SF).toPandas()
    if name in suite.ORACLE_SQL:
        assert rows(got) == rows(db.execute(suite.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(suite.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
