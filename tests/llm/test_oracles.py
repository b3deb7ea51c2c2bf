"""Every SQL twin of this folder against its query, on the smallest tables."""

import os

import duckdb
import pytest

from topicloom.llm.oracles import ORACLES
from topicloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(found.fetchall(), key=key)
