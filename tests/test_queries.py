"""Every registered query against its SQL counterpart on the smallest tables."""

import math
import os

import duckdb
import pytest

from opslattice.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("OPSLATTICE_TEST_DATA", "/root/testdata/sf0.001")
SLOW = {"d14_triage_model"}


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def cell(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    result = database.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = [df.columns.index(c) for c in sorted(columns)]
    wanted = [columns.index(c) for c in sorted(columns)]
    assert sorted([cell(r[i]) for i in order] for r in rows) == sorted([cell(r[i]) for i in wanted] for r in expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
