"""Every registered query against its SQL twin on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from topicloom.registry.oracles import all_oracles

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_sql(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    result = duck.execute(contract.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    at = [order.index(c) for c in columns]
    expected = sorted(tuple(row[i] for i in at) for row in result.fetchall())
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == expected


def test_oracles_have_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 80
