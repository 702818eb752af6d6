"""Every registered query that has SQL against it on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _rows(names, rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else repr(v)
        return v if v is None or isinstance(v, bool | int) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    got = _rows(df.columns, df.collect())
    want = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert got == _rows(names, want.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
