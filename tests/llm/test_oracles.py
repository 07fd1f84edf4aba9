"""The queries that SQL can express against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strandloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    right = sorted([tuple(r[k] for k in at) for r in want.fetchall()], key=repr)
    assert sorted([tuple(r[c] for c in columns) for r in found.collect()], key=repr) == right
