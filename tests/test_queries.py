"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from vecgrove import catalog, catalog_io

D = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES | catalog_io.QUERIES, catalog.ORACLES | catalog_io.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(D)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{D}/{name}'")
    return con


def plain(v):
    return None if v is None or v != v else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    got = sorted(tuple(str(plain(r[c])) for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(str(plain(r[names.index(c)])) for c in sorted(names)) for r in cur.fetchall())
    assert got == want
