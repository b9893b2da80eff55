"""Streams run to the end of what is there; results equal those of the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog.content import sniff_sql
from docloom.catalog.entities import CONTENT_TYPE, LINKS_SQL, content
from docloom.catalog.registered import query
from docloom.catalog.reports import JOB_EVENT, JOBS_SQL, STATUS_SQL, _EWMA
from docloom.catalog.search import POSTINGS_SQL
from docloom.catalog.views import NOTE, PROFILES_SQL
from docloom.functions.mime import mime_by_text
from docloom.functions.text import md5_hash
from docloom.session import scratch
from docloom.sources.tables import load
from docloom.streaming.ingest import AppendedRows, EntitySink, LatestRows, run_available, stream_table
from docloom.streaming.jobs import RunningAverage, event_counts, job_status_stream, job_transitions, without_repeats


def _stream(spark, folder, name):
    # A pattern, as it fits both a table that is one file and one that is a folder of files.
    return stream_table(spark, f"{folder}/{name}.parque[t]", load(spark, folder, name).schema, "*")


def _as_instant(name: str):
    """A time without a zone taken as UTC, whatever the session's zone."""
    return F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone()).alias(name)


def _run(spark, stream, name: str, keys: tuple[str, ...], mode: str = "append"):
    base = scratch(spark, name)
    rows = LatestRows(f"{base}/rows", keys)
    run_available(stream, rows, f"{base}/checkpoint", mode)
    return rows.read(spark)


@query("t01_streamed_content", f"SELECT doc_id, md5(text) AS hash, {sniff_sql('text')} AS content_type FROM documents")
def t01(spark, folder):
    docs = _stream(spark, folder, "documents").select(
        "doc_id", md5_hash(F.col("text")).alias("hash"), mime_by_text(F.col("text")).alias("content_type"))
    return _run(spark, docs, "content", ("doc_id",))


def _sink(spark, folder):
    base = scratch(spark, "entities")
    sink = EntitySink(f"{base}/tables")
    docs = _stream(spark, folder, "documents").select(
        F.col("doc_id").alias("content_id"), F.expr(CONTENT_TYPE).alias("content_type"), F.expr(NOTE).alias("text"))
    run_available(docs, sink, f"{base}/checkpoint")
    return sink


@query("t02_streamed_links", LINKS_SQL)
def t02_links(spark, folder):
    return _sink(spark, folder).links(spark).select("content_id", "entity_id", "relevance")


@query("t02_streamed_postings", POSTINGS_SQL.replace("FROM documents", f"FROM (SELECT doc_id, {NOTE} AS text FROM documents)"))
def t02_postings(spark, folder):
    return _sink(spark, folder).postings(spark).select("token", F.col("content_id").alias("doc_id"), "tf")


def _job_stream(spark, folder):
    day = F.date_format("ts", "yyyy-MM-dd")
    return _stream(spark, folder, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), day).alias("job_id"), F.expr(JOB_EVENT).alias("event"), "ts")


@query("t03_streamed_job_status", STATUS_SQL.replace("event_id)", "event)"))
def t03(spark, folder):
    return _run(spark, job_status_stream(_job_stream(spark, folder)), "jobs", ("job_id",), "update")


@query(
    "t03_streamed_transitions",
    f"""WITH s AS ({STATUS_SQL.replace("event_id)", "event)")}) SELECT job_id, status, events AS seen, rejected_cancels FROM s""",
)
def t03_transitions(spark, folder):
    base = scratch(spark, "transitions")
    # A last row, far ahead in time, moves the watermark past all events, so that none waits on.
    end = "job_id string, event string, ts timestamp"
    spark.sql("SELECT CAST(NULL AS STRING) AS job_id, CAST(NULL AS STRING) AS event, TIMESTAMP '2100-01-01' AS ts").write.parquet(f"{base}/end")
    rows = _job_stream(spark, folder).withColumn("ts", _as_instant("ts"))
    closed = rows.unionByName(spark.readStream.schema(end).parquet(f"{base}/end"))
    walked = AppendedRows(f"{base}/rows")
    run_available(job_transitions(closed), walked, f"{base}/checkpoint", "append")
    return walked.read(spark).filter("job_id IS NOT NULL").groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "event")).alias("status"), F.count(F.lit(1)).alias("seen"),
        F.count_if((F.col("event") == "canceled") & ~F.col("accepted")).alias("rejected_cancels"))


@query("t04_streamed_ewma", _EWMA.format(source=PROFILES_SQL).replace("floor(acc * 4 / 5)", "(acc * 4) // 5"))
def t04(spark, folder):
    rows = _stream(spark, folder, "events").select(
        F.col("event_type").alias("operation"), "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("duration_ms"))
    base = scratch(spark, "ewma")
    sink = RunningAverage(f"{base}/rows", ("ts", "event_id"))
    run_available(rows, sink, f"{base}/checkpoint")
    return sink.averages(spark)


@query("t05_streamed_event_counts",
       "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def t05(spark, folder):
    events = _stream(spark, folder, "events").select(_as_instant("ts"), "event_type")
    rows = _run(spark, event_counts(events), "counts", ("window_start", "event_type"), "update")
    day = F.date_from_unix_date((F.unix_seconds("window_start") / 86400).cast("int"))
    return rows.select(day.cast("string").alias("day"), "event_type", "events")


@query("t06_streamed_without_repeats", "SELECT event_id, event_type FROM events")
def t06(spark, folder):
    events = _stream(spark, folder, "events").select("event_id", "event_type", _as_instant("ts"))
    twice = events.unionByName(events)
    return _run(spark, without_repeats(twice).drop("ts"), "repeats", ("event_id",))
