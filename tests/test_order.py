"""Order-dependent operators against plain models, with every row in one group."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.operators import ordering as O
from docloom.operators import stats as A


def series(spark, values, group="g"):
    start = datetime(2024, 1, 1)
    rows = [(group, start + timedelta(minutes=7 * i), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, ts timestamp, id long, v long")


def ewma_model(values):
    h = values[0] * 100
    for v in values[1:]:
        h = h * 4 // 5 + v * 20
    return h / 100


@pytest.mark.parametrize("values", [
    [5], [5, 9, 100, 3], [7] * 90, [random.Random(1).randrange(0, 400) for _ in range(300)],
    [1, 2] * 60, [50] + [51] * 120, [1000] + [1] * 40 + [3] * 40, list(range(100)),
])
@pytest.mark.parametrize("block", [32, 2048])
def test_ewma_is_exact_for_any_block_size(spark, values, block):
    rows = A.ewma(series(spark, values), ["g"], ["ts", "id"], "v", block, fan=3).collect()
    assert [(r.runs, r.ewma) for r in rows] == [(len(values), ewma_model(values))]


def test_ranks_match_a_window(spark):
    df = series(spark, list(range(200)))
    rows = O.with_ranks(df, ["g"], ["ts", "id"], "v").orderBy("id").collect()
    assert [r["rank"] for r in rows] == list(range(1, 201))
    assert all(r.group_size == 200 for r in rows)
    assert [r.running_sum for r in rows] == [sum(range(i + 1)) for i in range(200)]


@pytest.mark.parametrize(("n", "k"), [(10, 3), (100, 7), (49, 49), (5, 9), (1000, 37), (97, 13)])
def test_systematic_sample(spark, n, k):
    df = series(spark, list(range(n)))
    got = sorted(r.id for r in O.systematic_sample(df, ["g"], ["ts", "id"], k).collect())
    assert got == (list(range(n)) if n <= k else sorted({int(i * (n / k)) for i in range(k)}))


def test_equal_values_of_one_group_spread_over_all_ranges(spark):
    df = spark.range(100_000).selectExpr("'g' AS g", "TIMESTAMP '2024-01-01 10:00:00' AS ts", "5L AS v")
    rows = O.in_ranges(df, ["g"], ["ts"])
    sizes = [r["count"] for r in rows.groupBy(O.RANGE).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 100_000 / 4
    ranks = O.with_ranks(df, ["g"], ["ts"], "v")
    facts = ranks.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.min("group_size"), F.count_if(F.col("running_sum") != 5 * F.col("rank"))).first()
    assert tuple(facts) == (100_000, 1, 100_000, 100_000, 0)
    for out in (O.running_progress(df, ["g"], ["ts"]), O.remaining_time(df, ["g"], ["ts"], "v"), O.systematic_sample(df, ["g"], ["ts"], 37)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    assert O.systematic_sample(df, ["g"], ["ts"], 37).count() == 37


def test_null_groups_and_many_small_ones(spark):
    df = spark.range(300).selectExpr("CASE WHEN id % 3 > 0 THEN id % 50 END AS g", "id AS ts", "id AS v")
    rows = O.with_ranks(df, ["g"], ["ts"], "v").collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r.ts):
        groups.setdefault(r.g, []).append(r)
    assert sum(map(len, groups.values())) == 300
    for own in groups.values():
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and {r.group_size for r in own} == {len(own)}
        assert [r.running_sum for r in own] == [sum(x.v for x in own[:i + 1]) for i in range(len(own))]


def test_no_array_of_the_average_is_long(spark):
    values = [(i * 7919) % 100_000 for i in range(40_000)]
    df = spark.createDataFrame([("hot", i, v) for i, v in enumerate(values)] + [("one", 0, 7)], "g string, id long, v long")
    maps = A.ewma_maps(df, ["g"], ["id"], "v", block=128)
    blocks, cuts = maps.agg(F.count("*"), F.max(F.size("map.cuts"))).first()
    assert blocks == 313 + 1 and cuts <= 5
    level = A.ewma_level(maps, ["g"], 16)
    assert level.count() == 20 + 1 and level.agg(F.max(F.size("map.cuts"))).first()[0] <= 5
    got = {r.g: r.ewma for r in A.ewma(df, ["g"], ["id"], "v", block=128, fan=16).collect()}
    assert got == {"hot": ewma_model(values), "one": 7.0}


def test_lines_around_matches(spark):
    df = spark.createDataFrame([("f", i, "hit" if i in (3, 4, 9) else "-") for i in range(12)], "file string, n long, line string")
    got = [r.n for r in O.around_matches(df, F.col("line") == "hit").collect()]
    assert got == [2, 3, 4, 5, 8, 9, 10]
    assert [r.n for r in O.around_matches(df, F.col("line") == "hit", limit=2).collect()] == [2, 3]


@pytest.mark.parametrize(("events", "status", "rejected"), [
    (["created", "started", "completed"], "completed", 0),
    (["created", "canceled", "completed"], "canceled", 0),
    (["created", "failed", "canceled"], "failed", 1),
    (["started", "progress"], "processing", 0),
    (["canceled", "canceled"], "canceled", 1),
])
def test_job_status(spark, events, status, rejected):
    rows = [("j", e, i) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "job_id string, event string, ts long")
    row = O.latest_status(df, ["ts"]).first()
    assert (row.status, row.events, row.rejected_cancels) == (status, len(events), rejected)


def test_newest_versions(spark):
    df = series(spark, list(range(20)))
    assert sorted(r.id for r in O.keep_newest(df, ["g"], ["ts"], 5).collect()) == [15, 16, 17, 18, 19]


def test_pages_never_overlap(spark):
    df = spark.range(25).withColumn("x", F.lit(1))
    pages = [[r.id for r in O.page(df, "x", "id", "asc", 10, o).collect()] for o in (0, 10, 20)]
    assert sum(pages, []) == list(range(25))
    info = O.page_info(df, 10, 10).first()
    assert (info.total, info.next_offset, info.previous_offset) == (25, 20, 0)
    assert O.page_info(df, 10, 20).first().next_offset is None
    assert O.page(df, "x", "id", "asc", 500, 0, 20).count() == 20
    with pytest.raises(ValueError):
        O.sort_column("content", "size")


@pytest.mark.parametrize(("period", "start"), [
    ("day", datetime(2024, 3, 30)), ("week", datetime(2024, 3, 24)), ("month", datetime(2024, 3, 2)),
    ("year", datetime(2023, 3, 31)), ("else", datetime(2024, 3, 24)),
])
def test_timeframe(period, start):
    now = datetime(2024, 3, 31)
    assert A.timeframe(period, now) == (start, now)


def test_compare_benchmark(spark):
    report = spark.createDataFrame([("a", 151.0), ("b", 79.0), ("c", 100.0), ("d", 1.0)], "operation string, avg_ms double")
    base = spark.createDataFrame([(x, 100.0) for x in "abc"], "operation string, benchmark_ms double")
    rows = {r.operation: r.verdict for r in A.compare_benchmark(report, base).collect()}
    assert rows == {"a": "slower", "b": "faster", "c": "normal", "d": "N/A"}
