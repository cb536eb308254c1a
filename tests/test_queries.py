"""Registered queries against their SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import TABLES, rows_of
from graphloom.plans import registry

FOLDER = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
SAMPLE = [
    "hotspots", "seams", "neighbors", "traverse_both", "what_if_affected", "co_changes_wide_commits", "load_edges",
    "include_closure", "semantic_seams", "search_features", "domain_name", "parse_java", "compile_commands", "property_sheets", "store_delta",
]
NAMES = sorted(registry.QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE


def test_every_query_with_sql_is_registered():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(registry.QUERIES) - set(registry.SQL) == {"kmeans", "feature_clusters"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = contract.queries()[name](spark, FOLDER)
    cur = con.execute(contract.oracle_sql()[name]) if name in contract.oracle_sql() else None
    got = rows_of(df.columns, df.collect())
    assert got
    if cur is not None:
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, cur.fetchall())
