"""Every registered query against its SQL on DuckDB."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare
from docloom.catalog import load_all

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    state, _, _, note = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), small)
    assert state == "ok", f"{state}: {note}"
    assert "types" not in note, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_every_query_is_exposed():
    assert set(QUERIES) <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).columns == ["entity_type", "count"]
