"""Every query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from strandloom.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == oracles.ORACLES.keys() and len(queries.QUERIES) == 69


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equal(spark, db, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = db.execute(oracles.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    right = sorted([tuple(plain(r[k]) for k in at) for r in want.fetchall()], key=repr)
    left = sorted([tuple(plain(r[c]) for c in columns) for r in found.collect()], key=repr)
    assert left == right
