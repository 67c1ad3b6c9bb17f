"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodestack.registry import ORACLES, QUERIES

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{PATH}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows_of(rows):
    return sorted(tuple("∅" if x is None else repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, PATH)
    names = sorted(df.columns)
    want = sql.sql(ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert rows_of([r[c] for c in names] for r in df.collect()) == rows_of([r[k] for k in at] for r in want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
