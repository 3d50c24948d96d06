import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from revlake.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(found):
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.sql(catalog.ORACLE[name])
    assert sorted(want.columns) == columns
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
