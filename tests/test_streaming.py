"""Streams over several micro-batches, replays, and agreement with the batch form."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.operators import consolidate as C
from docloom.operators.extraction import extract
from docloom.operators.ordering import latest_status
from docloom.operators.search import build_index, row_postings
from docloom.operators import stats as A
from docloom.streaming.ingest import AppendedRows, EntitySink, LatestRows, run_available, stream_files, stream_table
from docloom.streaming.jobs import RunningAverage, event_counts, job_status_stream, job_transitions, without_repeats
from docloom.streaming.tiers import TieredTable

TEXTS = ["Ann Lee met Bob Ray.", "Ann Lee in Paris on 1/2/2023", "Cy Orr and Ann Lee", "Bob Ray again"]


@pytest.fixture
def docs(spark, tmp_path):
    rows = [(i, "text/plain", t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "content_id long, content_type string, text string")
    for i in range(len(rows)):
        df.filter(F.col("content_id") == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    return df, str(tmp_path / "in" / "*"), tmp_path


def test_entity_sink_over_batches_equals_one_batch(spark, docs):
    df, source, base = docs
    sink = EntitySink(str(base / "out"))
    stream = stream_table(spark, source, df.schema, files_per_batch=1)
    run_available(stream, sink, str(base / "cp"))
    entities, links = C.store_entities(extract(df, ["content_id", "content_type"]))
    assert sorted(r.entity_id for r in sink.entities(spark).collect()) == sorted(r.entity_id for r in entities.collect())
    assert sorted(map(tuple, sink.links(spark).collect())) == sorted(map(tuple, links.collect()))
    want = build_index(df, "content_id", ["text"])
    got = sink.postings(spark).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_replayed_batch_changes_nothing(spark, docs):
    df, _, base = docs
    sink = EntitySink(str(base / "out"))
    sink(df.filter("content_id < 2"), 0)
    sink(df.filter("content_id >= 1"), 1)
    before = [sorted(map(tuple, t.collect())) for t in (sink.entities(spark), sink.links(spark), sink.postings(spark))]
    sink(df.filter("content_id >= 1"), 1)
    after = [sorted(map(tuple, t.collect())) for t in (sink.entities(spark), sink.links(spark), sink.postings(spark))]
    assert before == after


def events(spark, tmp_path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    for i in range(3):
        df.filter(F.col("n") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "ev" / f"b{i}"))
    return df, stream_table(spark, str(tmp_path / "ev" / "*"), df.schema, files_per_batch=1)


START = datetime(2024, 1, 1)
JOBS = [("a", "created"), ("b", "created"), ("a", "started"), ("b", "canceled"), ("a", "completed"), ("b", "completed"),
        ("a", "canceled"), ("c", "progress")]


def test_job_status_stream(spark, tmp_path):
    rows = [(j, e, START + timedelta(minutes=i), i) for i, (j, e) in enumerate(JOBS)]
    df, stream = events(spark, tmp_path, rows, "job_id string, event string, ts timestamp, n long")
    sink = LatestRows(str(tmp_path / "rows"), ("job_id",))
    run_available(job_status_stream(stream), sink, str(tmp_path / "cp"), "update")
    want = sorted(map(tuple, latest_status(df, ["ts", "event"]).collect()))
    assert sorted(map(tuple, sink.read(spark).select("job_id", "status", "events", "rejected_cancels").collect())) == want
    assert {r[0]: r[1] for r in want} == {"a": "completed", "b": "canceled", "c": "processing"}


WALK = [
    ("a", "created", "pending", True), ("b", "created", "pending", True), ("a", "started", "processing", True),
    ("b", "canceled", "canceled", True), ("a", "completed", "completed", True), ("b", "completed", "canceled", False),
    ("a", "canceled", "completed", False), ("c", "progress", "processing", True)]


def walk(spark, base, batches, **options):
    """Rows of the walk over event files taken one a batch; a row far ahead closes the stream."""
    schema = "job_id string, event string, ts timestamp"
    for i, rows in enumerate([*batches, [("end", None, START + timedelta(days=100))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(base / "ev" / f"b{i}"))
    sink = AppendedRows(str(base / "rows"))
    stream = stream_table(spark, str(base / "ev" / "*"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    query = run_available(job_transitions(stream, **options), sink, str(base / "cp"))
    rows = [(r.job_id, r.event, r.status, r.accepted) for r in sink.read(spark).orderBy("ts", "event").collect() if r.job_id != "end"]
    return rows, query.recentProgress


def test_transitions_are_the_same_whatever_the_batches(spark, tmp_path):
    rows = [(j, e, START + timedelta(minutes=i)) for i, (j, e) in enumerate(JOBS)]
    cuts = {"one": [rows], "late": [rows[3:6], rows[6:], rows[:3]], "mixed": [rows[::3], rows[1::3], rows[2::3]]}
    for name, batches in cuts.items():
        got, progress = walk(spark, tmp_path / name, batches)
        assert got == WALK, name
    # All jobs are far behind the watermark, so none is left in the store.
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 4  # the waiting row of the end, its timer and what indexes it


def test_ended_jobs_leave_the_store_and_stay_known_until_then(spark, tmp_path):
    at = [START + timedelta(minutes=m) for m in range(6)]
    day = timedelta(days=1)
    batches = [
        [("a", "created", at[0]), ("a", "completed", at[1])],
        [("x", "progress", at[2] + timedelta(hours=3))],
        [("a", "started", at[3] + timedelta(hours=3))],  # within a day of its end: illegal
        [("x", "progress", at[4] + 3 * day)],
        [("x", "progress", at[5] + 4 * day), ("a", "created", at[5] + 4 * day)],  # forgotten by now: a new job
    ]
    rows, progress = walk(spark, tmp_path, batches, lateness="1 minute")
    assert [r[1:] for r in rows if r[0] == "a"] == [
        ("created", "pending", True), ("completed", "completed", True), ("started", "completed", False), ("created", "pending", True)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert held[-1] <= 3 < max(held)


def hot_series(n, seed=0):
    values = [(i * 7919 + seed) % 400 for i in range(n)]
    h = values[0] * 100
    for v in values[1:]:
        h = h * 4 // 5 + v * 20
    return [("op", START + timedelta(seconds=i), v, i * 10 // n) for i, v in enumerate(values)], h / 100


def test_one_hot_operation_over_ten_batches(spark, tmp_path):
    rows, want = hot_series(20_000)
    df = spark.createDataFrame(rows, "operation string, ts timestamp, duration_ms long, n long")
    for i in range(10):
        df.filter(F.col("n") == i).coalesce(1).write.parquet(str(tmp_path / "ev" / f"b{i}"))
    stream = stream_table(spark, str(tmp_path / "ev" / "*"), df.schema, files_per_batch=1)
    sink = RunningAverage(str(tmp_path / "rows"), buckets=2)
    run_available(stream, sink, str(tmp_path / "cp"))
    row = sink.averages(spark).first()
    assert (row.operation, row.runs, row.ewma) == ("op", 20_000, want)
    batch = A.ewma(df, ["operation"], ["ts"]).first()
    assert (batch.runs, batch.ewma) == (20_000, want)
    # The last batch again, as after a crash.
    sink(df.filter("n = 9"), 9)
    again = sink.averages(spark).first()
    assert (again.runs, again.ewma) == (20_000, want)


def test_average_of_few_rows_a_batch(spark, tmp_path):
    values = [10, 20, 5, 100, 7, 3, 50, 60, 1]
    schema = "operation string, ts timestamp, duration_ms long"
    sink, h = RunningAverage(str(tmp_path / "rows"), buckets=1), None
    for i, v in enumerate(values):
        sink(spark.createDataFrame([("op", START + timedelta(minutes=i), v), (f"o{i}", START, i)], schema), i)
        h = v * 100 if h is None else h * 4 // 5 + v * 20
    got = {r.operation: (r.runs, r.ewma) for r in sink.averages(spark).collect()}
    assert got == {"op": (9, h / 100)} | {f"o{i}": (1, float(i)) for i in range(9)}


def test_files_stay_few_over_fifty_batches(spark, tmp_path):
    base, table, want = tmp_path / "t", TieredTable(str(tmp_path / "t"), ("id",), buckets=2), {}
    first = TieredTable(str(tmp_path / "f"), ("id",), keep="first", buckets=1)
    for i in range(50):
        rows = [(k, f"{i}/{k}") for k in (i, i // 2, 0)]
        rows = list(dict(rows).items())
        want |= dict(rows)
        table(spark.createDataFrame(rows, "id long, v string").coalesce(1), i)
        if i < 9:
            first(spark.createDataFrame(rows, "id long, v string").coalesce(1), i)
    assert {r.id: r.v for r in table.read(spark).collect()} == want
    assert {r.id: r.v for r in first.read(spark).collect()}[0] == "0/0"
    files = [f for f in base.rglob("part-*") if f.is_file()]
    assert len(files) <= 2 * 3 * 4 + 2 * 5  # buckets, runs a level, levels; what the last manifest names beside
    # A crash ahead of the manifest, and one after it: the batch is repeated.
    table._store(spark.createDataFrame([(0, "torn", 50)], "id long, v string, _batch long"), "run-50-0")
    assert {r.id: r.v for r in table.read(spark).collect()} == want
    for _ in range(2):
        table(spark.createDataFrame([(0, "50/0")], "id long, v string"), 50)
        assert {r.id: r.v for r in table.read(spark).collect()} == want | {0: "50/0"}
    assert {r.id: r.v for r in table.lookup(spark.createDataFrame([(0,), (777,)], "id long")).collect()} == {0: "50/0"}


def test_counts_and_repeats(spark, tmp_path):
    rows = [(i % 20, "ab"[i % 2], START + timedelta(hours=i % 20), i) for i in range(60)]
    df, stream = events(spark, tmp_path, rows, "event_id long, event_type string, ts timestamp, n long")
    sink = LatestRows(str(tmp_path / "counts"), ("window_start", "event_type"))
    run_available(event_counts(stream, lateness="2 days"), sink, str(tmp_path / "cp"), "update")
    assert sum(r.events for r in sink.read(spark).collect()) == 60
    once = LatestRows(str(tmp_path / "once"), ("event_id",))
    run_available(without_repeats(stream, lateness="2 days"), once, str(tmp_path / "cp2"))
    assert once.read(spark).count() == 20


def test_file_stream(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("hello")
    sink = LatestRows(str(tmp_path / "rows"), ("path",))
    run_available(stream_files(spark, str(tmp_path / "docs"), "*.txt"), sink, str(tmp_path / "cp"))
    assert [r.text for r in sink.read(spark).collect()] == ["hello"]


def test_postings_of_an_emptied_document(spark, tmp_path):
    sink = EntitySink(str(tmp_path / "tables"))
    for number, text in enumerate(("hello Ann Lee", "...")):
        sink(spark.createDataFrame([(1, "text/plain", text)], "content_id long, content_type string, text string"), number)
    assert sink.postings(spark).count() == 0


def test_tables_that_are_folders_of_files(spark, small, tmp_path):
    from docloom.catalog import load_all
    from docloom.sources.tables import load

    docs = load(spark, small, "documents").limit(30).localCheckpoint()
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    queries = load_all()[0]
    assert queries["t01_streamed_content"](spark, str(tmp_path / "many")).count() == 30
    assert queries["t01_streamed_content"](spark, small).count() == load(spark, small, "documents").count()
    assert queries["t02_streamed_links"](spark, str(tmp_path / "many")).count() > 0
    assert queries["t02_streamed_postings"](spark, str(tmp_path / "many")).count() > 0


def test_jobs_of_one_slice_share_its_timers(spark, tmp_path):
    """Two thousand jobs in three slices: what is asked of the store goes by slices, so this takes seconds, and each job walks alone."""
    jobs = [[(f"j{i}", e, START + timedelta(seconds=i % 50, minutes=m)) for i in range(2000)] for m, e in enumerate(("completed", "created", "canceled"))]
    rows, progress = walk(spark, tmp_path, [jobs[2] + jobs[0], jobs[1]], slices=3)
    assert len(rows) == 6000
    assert {(e, s, ok) for _, e, s, ok in rows} == {("completed", "completed", True), ("created", "completed", False), ("canceled", "completed", False)}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) < 100  # lists and timers of three slices, not of two thousand jobs


def exchanges(df):
    """Shuffles of a plan, as adaptive execution begins with it."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_run_is_shuffled_once_and_read_as_it_is(spark, tmp_path):
    table = TieredTable(str(tmp_path / "t"), ("id",), buckets=2)
    plans = []
    table(spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string"), 0, lambda rows, dealt: plans.append(rows) or
          rows.groupBy(*dealt, "id").agg(F.max("v").alias("v"), F.count("v").alias("n")), beside=("n",),
          then=lambda own: plans.append(sorted(map(tuple, own.select("id", "v", "n").collect()))))
    assert plans[1] == [(1, "a", 1), (2, "b", 2)]
    assert exchanges(plans[0].groupBy("_bucket", "_slice", "id").agg(F.max("v"))) == 1
    assert table.read(spark).columns == ["id", "v"] and exchanges(table.read(spark)) == 0
    assert sorted(map(tuple, table.read(spark).collect())) == [(1, "a"), (2, "b")]
    table(spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, v string"), 1)
    assert sorted(map(tuple, table.read(spark).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_entities_of_the_sink_have_the_first_description(spark, docs):
    df, _, base = docs
    sink = EntitySink(str(base / "out"))
    sink(df, 0)
    entities, links = C.store_entities(extract(df, ["content_id", "content_type"]))
    assert sorted(map(str, sink.entities(spark).select(*entities.columns).collect())) == sorted(map(str, entities.collect()))
    assert sorted(map(str, sink.links(spark).select(*links.columns).collect())) == sorted(map(str, links.collect()))
    assert exchanges(sink.links(spark)) == 0


def test_postings_are_counted_within_a_row(spark, tmp_path):
    """The same as the index over rows, without its shuffle; also for texts of one document in one batch, and without an id."""
    texts = [(1, "Ann lee, ANN x1"), (1, "x1 b"), (1, "..."), (2, None), (3, ""), (4, "Ä ä 12 12 ٣"), (None, "no id"), (None, "id id"), (5, "a " * 3000 + "b")]
    df = spark.createDataFrame([(i, "text/plain", t) for i, t in texts], "content_id long, content_type string, text string").repartition(3)
    rows = row_postings(df, "content_id", ["text"])
    assert exchanges(rows) == exchanges(df)
    want = build_index(df, "content_id", ["text"])
    sink = EntitySink(str(tmp_path / "out"))
    sink(df, 0)
    got = sink.postings(spark).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.schema["tf"].dataType == want.schema["tf"].dataType
    assert exchanges(got) == 0
