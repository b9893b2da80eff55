"""Statistics, profiles, logs and order-dependent reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from docloom.catalog.entities import CONTENT_SQL, ENTITIES_SQL, content, stored
from docloom.catalog.registered import query
from docloom.catalog.views import ITEMS_SQL, LOG_SQL, PROFILES_SQL, batch_items, log_lines, profiles
from docloom.functions.text import moment
from docloom.operators import lists as P
from docloom.operators import ordering as O
from docloom.operators import stats as A
from docloom.sources.logs import parse_log, split_operation
from docloom.sources.tables import load, run_select

NOW = datetime(2024, 1, 31)


# ------------------------------------------------------------------ statistics
@query(
    "a04_content_statistics",
    """SELECT lang AS content_type, count(*) AS total, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_size FROM documents GROUP BY ROLLUP (lang)""",
)
def a04(spark, folder):
    rows = load(spark, folder, "documents").select(
        F.col("lang").alias("content_type"), F.octet_length("text").cast("long").alias("size"))
    return A.content_stats(rows)


@query(
    "a04_order_statistics_in_period",
    """SELECT o_orderpriority AS content_type, count(*) AS total, CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS total_size FROM orders
       WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31' GROUP BY ROLLUP (o_orderpriority)""".replace(
        "CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice) AS BIGINT)"),
)
def a04_period(spark, folder):
    rows = load(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("content_type"), F.floor("o_totalprice").alias("size"),
        F.col("o_orderdate").alias("created_at"))
    return A.content_stats(rows, datetime(1997, 1, 1), datetime(1997, 12, 31))


@query("a05_entity_statistics", f"SELECT entity_type, count(*) AS total FROM ({ENTITIES_SQL}) GROUP BY ROLLUP (entity_type)")
def a05(spark, folder):
    return A.entity_stats(stored(spark, folder)[0])


@query(
    "a06_processing_statistics",
    f"""SELECT round(sum(duration_ms) / 1000.0, 3) AS total_processing_time, round(avg(duration_ms) / 1000.0, 6) AS average_processing_time,
        round(100.0 * count(*) FILTER (status = 'completed') / count(*), 6) AS success_rate FROM ({ITEMS_SQL})
        WHERE started_at >= TIMESTAMP '1998-01-01' AND started_at <= TIMESTAMP '1999-01-01'""",
)
def a06(spark, folder):
    rows = A.processing_stats(batch_items(spark, folder), datetime(1998, 1, 1), datetime(1999, 1, 1))
    return rows.select(F.round("total_processing_time", 3).alias("total_processing_time"),
                       F.round("average_processing_time", 6).alias("average_processing_time"),
                       F.round("success_rate", 6).alias("success_rate"))


@query(
    "a07_events_per_timeframe",
    """SELECT period, count(*) AS events FROM events JOIN (VALUES ('day', TIMESTAMP '2024-01-30'), ('week', TIMESTAMP '2024-01-24'),
         ('month', TIMESTAMP '2023-12-31'), ('year', TIMESTAMP '2023-01-31')) t(period, start) ON ts >= start AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1""",
)
def a07(spark, folder):
    ts = load(spark, folder, "events").select("ts")
    kind = ts.schema["ts"].dataType
    counts = [
        F.count_if((F.col("ts") >= moment(start, kind)) & (F.col("ts") <= moment(end, kind))).alias(period)
        for period, (start, end) in ((p, A.timeframe(p, NOW)) for p in ("day", "week", "month", "year"))
    ]
    wide = ts.agg(*counts)
    return wide.unpivot([], ["day", "week", "month", "year"], "period", "events")


@query(
    "a08_batch_progress",
    f"""SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
        count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
        round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 2) AS percentage FROM ({ITEMS_SQL}) GROUP BY 1""",
)
def a08(spark, folder):
    rows = A.batch_progress(batch_items(spark, folder))
    return rows.withColumn("percentage", F.col("percentage").cast("double"))


@query(
    "a09_batch_summary",
    f"""SELECT batch_id, count(*) FILTER (status IN ('completed', 'failed')) AS processed, count(*) FILTER (status = 'completed') AS successful,
        count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, date_diff('millisecond', min(CAST(started_at AS TIMESTAMP)), max(completed_at)) AS processing_ms,
        count(*) FILTER (status = 'failed') = 0 AS success FROM ({ITEMS_SQL}) GROUP BY 1""",
)
def a09(spark, folder):
    return A.batch_summary(batch_items(spark, folder))


_REPORT = f"""SELECT operation, count(*) AS runs, avg(duration_ms) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
 CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM ({PROFILES_SQL}) GROUP BY 1"""


@query("a10_profile_report", _REPORT)
def a10(spark, folder):
    return A.profile_report(profiles(spark, folder))


@query("a10_slowest_operations", f"SELECT * FROM ({_REPORT}) ORDER BY avg_ms DESC, operation LIMIT 5")
def a10_top(spark, folder):
    return A.slowest_operations(profiles(spark, folder))


@query(
    "a11_profile_report_with_resources",
    _REPORT.replace(" FROM (", ", avg(mem_diff) AS avg_memory, avg(cpu) AS avg_cpu FROM (", 1),
)
def a11(spark, folder):
    return A.profile_report(profiles(spark, folder), resources=True)


@query(
    "a12_compare_with_benchmark",
    f"""WITH base AS (SELECT operation, avg(duration_ms) * CASE operation WHEN 'click' THEN 0.5 WHEN 'view' THEN 2.0 ELSE 1.01 END AS benchmark_ms
   FROM ({PROFILES_SQL}) WHERE ts < TIMESTAMP '2024-01-10' AND operation <> 'signup' GROUP BY operation)
SELECT r.operation, CASE WHEN benchmark_ms IS NULL THEN 'N/A' WHEN floor(avg_ms / benchmark_ms * 100) / 100 > 1.5 THEN 'slower'
  WHEN floor(avg_ms / benchmark_ms * 100) / 100 < 0.8 THEN 'faster' ELSE 'normal' END AS verdict FROM ({_REPORT}) r LEFT JOIN base USING (operation)""",
)
def a12(spark, folder):
    rows = profiles(spark, folder)
    cut = F.lit("2024-01-10").cast(rows.schema["ts"].dataType)
    factor = F.when(F.col("operation") == "click", 0.5).when(F.col("operation") == "view", 2.0).otherwise(1.01)
    base = rows.filter((F.col("ts") < cut) & (F.col("operation") != "signup")).groupBy("operation").agg(
        F.avg("duration_ms").alias("m")).select("operation", (F.col("m") * factor).alias("benchmark_ms"))
    return A.compare_benchmark(A.profile_report(rows), base).select("operation", "verdict")


_EWMA = """WITH src AS ({source}), series AS (SELECT operation, list(duration_ms ORDER BY ts, event_id) AS vs FROM src GROUP BY 1),
 folded AS (SELECT operation, len(vs) AS runs,
   list_reduce(list_prepend(vs[1] * 100, vs[2:]), lambda acc, v: CAST(floor(acc * 4 / 5) AS BIGINT) + v * 20) AS h FROM series)
SELECT operation, runs, h / 100 AS ewma FROM folded"""


@query("a13_ewma", _EWMA.format(source=PROFILES_SQL).replace("floor(acc * 4 / 5)", "(acc * 4) // 5"))
def a13(spark, folder):
    return A.ewma(profiles(spark, folder), ["operation"], ["ts", "event_id"])


@query("a13_ewma_by_user", _EWMA.format(source=PROFILES_SQL.replace("event_type AS operation", "CAST(user_id AS STRING) AS operation"))
       .replace("floor(acc * 4 / 5)", "(acc * 4) // 5"))
def a13_users(spark, folder):
    rows = profiles(spark, folder).withColumn("operation", F.col("mem_diff").cast("string"))
    return A.ewma(rows, ["operation"], ["ts", "event_id"])


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
)
_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in TABLES)


@query("a14_s08_u02_table_counts", _COUNTS)
def a14(spark, folder):
    return A.table_counts({n: load(spark, folder, n) for n in TABLES})


@query(
    "s08_table_inventory",
    f"""WITH counts AS ({_COUNTS})
SELECT c.table_name, CAST(column_index AS INTEGER) AS ordinal, column_name, rows,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float'
    WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>'
    WHEN 'SMALLINT' THEN 'smallint' WHEN 'TINYINT' THEN 'tinyint' WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(data_type) END AS data_type
FROM duckdb_columns() c JOIN counts ON c.table_name = counts.table_name""",
)
def s08(spark, folder):
    return A.table_inventory({n: load(spark, folder, n) for n in TABLES})


@query(
    "a15_search_term_statistics",
    """SELECT lower(split_part(p_name, ' ', 1)) AS term, count(*) AS searches, max(l_shipdate) AS last_searched FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def a15(spark, folder):
    parts = load(spark, folder, "part").select("p_partkey", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("term"))
    log = load(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_shipdate").alias("searched_at"))
    return A.search_term_stats(log.join(parts, "p_partkey"))


@query(
    "a17_fields_to_columns",
    """SELECT p_partkey AS content_id, p_brand AS brand, p_type AS kind, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END AS size FROM part""",
)
def a17(spark, folder):
    fields = load(spark, folder, "part").withColumn(
        "size", F.when(F.col("p_size") > 10, F.col("p_size").cast("string"))
    ).select(
        F.col("p_partkey").alias("content_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), "size",
    ).unpivot(["content_id"], ["brand", "kind", "size"], "field_name", "field_value").filter("field_value IS NOT NULL")
    return A.pivot_fields(fields, ["brand", "kind", "size"])


@query("s09_guarded_select", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1")
def s09(spark, folder):
    path = f"{folder}/orders.parquet"
    sql = f"SELECT o_orderstatus, count(*) AS n FROM parquet.`{path}` WHERE o_totalprice > :least GROUP BY 1"
    return run_select(spark, sql, {"least": 200000})


# ------------------------------------------------------------------ logs and profiles
_LOGS = f"SELECT event_type AS file, event_id AS n, {LOG_SQL} AS line FROM events"


@query(
    "s10_parsed_logs",
    f"""SELECT n, line ->> '$.timestamp' AS "timestamp", line ->> '$.level' AS level, line ->> '$.message' AS message,
        line ->> '$.context.module' AS module, line ->> '$.context.function' AS "function", CAST(line ->> '$.context.line' AS INTEGER) AS line_number FROM ({_LOGS})""",
)
def s10(spark, folder):
    rows = log_lines(spark, folder).select("n", parse_log(F.col("line")).alias("r"))
    return rows.select("n", "r.timestamp", "r.level", "r.message", "r.context.module", "r.context.function",
                       F.col("r.context.line").alias("line_number"))


@query(
    "s11_split_operations",
    "SELECT event_id, event_type AS operation, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id || ':x' END AS info FROM events",
)
def s11(spark, folder):
    name = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit(":u"), F.col("user_id").cast("string"), F.lit(":x")))
    rows = load(spark, folder, "events").select("event_id", F.coalesce(name, "event_type").alias("operation"))
    return split_operation(rows)


@query("p18_logs_by_field", f"SELECT n, line FROM ({_LOGS}) WHERE line ->> '$.context.function' = 'f3'")
def p18(spark, folder):
    return P.logs_where(log_lines(spark, folder), "context.function", "f3").select("n", "line")


@query("p19_logs_by_severity", f"SELECT n, line ->> '$.level' AS level FROM ({_LOGS}) WHERE line ->> '$.level' IN ('warning', 'error')")
def p19(spark, folder):
    rows = log_lines(spark, folder).select("n", parse_log(F.col("line"))["level"].alias("level"))
    return P.logs_at_least(rows, "warning")


@query("p20_retention", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAYS")
def p20(spark, folder):
    return P.retain(load(spark, folder, "events").select("event_id", "ts"), "ts", datetime(2024, 2, 10), 30)


@query(
    "w03_log_lines_around_matches",
    f"""WITH logs AS (SELECT 'all' AS file, n, line FROM ({_LOGS})), hits AS (SELECT n FROM logs WHERE contains(line, 'by 7"'))
SELECT file, n, line FROM logs WHERE n IN (SELECT unnest([n - 1, n, n + 1]) FROM hits) ORDER BY file, n LIMIT 100""",
)
def w03(spark, folder):
    lines = log_lines(spark, folder).withColumn("file", F.lit("all"))
    return O.around_matches(lines, F.col("line").contains('by 7"')).select("file", "n", "line")


# ------------------------------------------------------------------ order within groups
@query(
    "w04_systematic_sample",
    """WITH ranked AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events),
 wanted AS (SELECT DISTINCT event_type, CAST(floor(i * (CAST(n AS DOUBLE) / 37)) AS BIGINT) AS p FROM ranked, range(0, 37) t(i))
SELECT event_id, event_type FROM ranked WHERE n <= 37 OR (event_type, p) IN (SELECT event_type, p FROM wanted)""",
)
def w04(spark, folder):
    rows = load(spark, folder, "events").select("event_id", "event_type", "ts")
    sample = O.systematic_sample(rows, ["event_type"], ["ts", "event_id"], 37)
    return sample.select("event_id", "event_type")


@query(
    "w05_newest_versions",
    """SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5""",
)
def w05(spark, folder):
    rows = load(spark, folder, "events").select("event_id", "user_id", "ts")
    return O.keep_newest(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id")


JOB_EVENT = (
    "CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'started' WHEN 'view' THEN 'progress' "
    "WHEN 'purchase' THEN (CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'progress' END) "
    "ELSE (CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'canceled' END) END"
)
# One job per user and day.
JOBS_SQL = f"SELECT user_id || '/' || CAST(ts AS DATE) AS job_id, {JOB_EVENT} AS event, ts, event_id FROM events"


def job_events(spark, folder):
    day = F.date_format("ts", "yyyy-MM-dd")
    return load(spark, folder, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), day).alias("job_id"),
        F.expr(JOB_EVENT).alias("event"), "ts", "event_id")


STATUS_SQL = f"""WITH e AS (SELECT job_id, ts, event_id, event, CASE event WHEN 'created' THEN 'pending' WHEN 'started' THEN 'processing' WHEN 'progress' THEN 'processing' ELSE event END AS status FROM ({JOBS_SQL})),
 ends AS (SELECT job_id, arg_min(status, (ts, event_id)) AS final FROM e WHERE status IN ('completed', 'failed', 'canceled') GROUP BY 1),
 latest AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, count(*) AS events, count(*) FILTER (status = 'canceled') AS cancels FROM e GROUP BY 1)
SELECT job_id, coalesce(final, status) AS status, events, cancels - CASE WHEN final = 'canceled' THEN 1 ELSE 0 END AS rejected_cancels FROM latest LEFT JOIN ends USING (job_id)"""


@query("w06_latest_job_status", STATUS_SQL)
def w06(spark, folder):
    return O.latest_status(job_events(spark, folder), ["ts", "event_id"])


_RUNNING = f"""SELECT event_id, operation, row_number() OVER w AS r, count(*) OVER (PARTITION BY operation) AS n, CAST(sum(duration_ms) OVER w AS BIGINT) AS so_far
 FROM ({PROFILES_SQL}) WINDOW w AS (PARTITION BY operation ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""


@query("w07_remaining_time", f"SELECT event_id, operation, round(so_far / r * (n - r), 3) AS eta_ms FROM ({_RUNNING})")
def w07(spark, folder):
    rows = O.remaining_time(profiles(spark, folder), ["operation"], ["ts", "event_id"])
    return rows.select("event_id", "operation", F.round("eta_ms", 3).alias("eta_ms"))


@query("w08_running_progress", f"SELECT event_id, operation, round(CAST(r AS DOUBLE) * 100 / n, 6) AS progress FROM ({_RUNNING})")
def w08(spark, folder):
    rows = O.running_progress(profiles(spark, folder), ["operation"], ["ts", "event_id"])
    return rows.select("event_id", "operation", F.round(F.col("progress").cast("double"), 6).alias("progress"))
