"""Bucketed snapshots: what a keyed table holds after upserts, and what the upserts shuffle."""

import pytest
from pyspark.sql import functions as F

from docloom.operators.snapshots import BucketedTable

SCHEMA = "a long, b string, v string, n long"


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, "xy"[i % 2], f"old{i}", i) for i in range(100)]
    return BucketedTable(str(tmp_path), ("a", "b"), buckets=4).write(spark.createDataFrame(rows, SCHEMA))


def new_rows(spark):
    return spark.createDataFrame([(i, "xy"[i % 2], f"new{i}", -i) for i in range(90, 120)], SCHEMA)


def values(df):
    return {r.a: (r.v, r.n) for r in df.collect()}


def test_upsert_insert_and_delete(spark, table):
    new = new_rows(spark)
    old = {i: (f"old{i}", i) for i in range(100)}
    added = {i: (f"new{i}", -i) for i in range(90, 120)}
    assert values(table.upsert(new)) == old | added
    assert values(table.insert(new)) == added | old
    summed = table.upsert(new, {"n": F.col("n") + F.col("_new_n")})
    assert values(summed) == added | old | {i: (f"old{i}", 0) for i in range(90, 100)}
    assert values(table.delete(new)) == {i: old[i] for i in range(90)}
    assert values(table.read(spark)) == old
    empty = BucketedTable(table.folder, table.keys, 4)
    assert empty.read(spark) is None and values(empty.upsert(new)) == added


def test_the_snapshot_is_not_shuffled(spark, table):
    for out in (table.upsert(new_rows(spark)), table.insert(new_rows(spark)), table.delete(new_rows(spark))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
        assert "Bucketed: true" in scan
        join = plan[plan.index("SortMergeJoin"):]
        snapshot = join[:join.index("FileScan parquet")]
        assert "Exchange" not in snapshot and plan.count("Exchange hashpartitioning") == 1


def test_snapshots_follow_each_other(spark, table):
    second = table.write(table.upsert(new_rows(spark)), dealt=True)
    assert len(values(second.read(spark))) == 120 and len(values(table.read(spark))) == 100
    third = second.write(second.delete(new_rows(spark)), dealt=True)
    assert len(values(third.read(spark))) == 90
    assert "Bucketed: true" in third.upsert(new_rows(spark))._jdf.queryExecution().executedPlan().toString()


def test_another_session_attaches_a_snapshot(spark, table):
    spark.sql(f"DROP TABLE {table.current}")  # forgets the table and leaves the files
    again = BucketedTable(table.folder, table.keys, 4).attach(spark, table.current)
    assert len(values(again.read(spark))) == 100
    assert "Bucketed: true" in again.insert(new_rows(spark))._jdf.queryExecution().executedPlan().toString()
