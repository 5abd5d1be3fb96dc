"""Each registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quarryframe.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    if name not in SQL:
        assert data
        return
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())
