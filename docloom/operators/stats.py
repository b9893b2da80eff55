"""Statistics and reports."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import moment
from docloom.operators.ordering import in_ranges, ranked, totals_ahead
from docloom.options import PROFILE_TOP
from docloom.session import cut_lineage


def entity_type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("count"))


def with_content_count(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Add the number of content items that mention each entity.

    Links are reduced to distinct pairs first, so a frequent entity is counted in two steps.
    """
    counts = (
        links.select("entity_id", "content_id").distinct()
        .groupBy("entity_id").agg(F.count(F.lit(1)).alias("content_count"))
    )
    return entities.join(counts, "entity_id", "left").fillna(0, ["content_count"])


def links_per_content(links: DataFrame) -> DataFrame:
    return links.groupBy("content_id").agg(F.count(F.lit(1)).alias("entities"))


def _between(df: DataFrame, ts: str, start: object, end: object) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(ts) >= moment(start, df.schema[ts].dataType))
    if end is not None:
        df = df.filter(F.col(ts) <= moment(end, df.schema[ts].dataType))
    return df


def content_stats(content: DataFrame, start: object = None, end: object = None,
                  ts: str = "created_at", by: str = "content_type") -> DataFrame:
    """Items and bytes per type in a period; the row without a type is the total."""
    return _between(content, ts, start, end).rollup(by).agg(
        F.count(F.lit(1)).alias("total"), F.sum("size").alias("total_size")
    )


def entity_stats(entities: DataFrame, start: object = None, end: object = None,
                 ts: str = "created_at") -> DataFrame:
    return _between(entities, ts, start, end).rollup("entity_type").agg(F.count(F.lit(1)).alias("total"))


def processing_stats(results: DataFrame, start: object = None, end: object = None,
                     ts: str = "started_at", duration: str = "duration_ms") -> DataFrame:
    """Total and mean processing time in seconds and the success rate in percent."""
    seconds = F.col(duration) / 1000
    success = F.when(F.col("status") == "completed", 100.0).otherwise(0.0)
    return _between(results, ts, start, end).agg(
        F.sum(seconds).alias("total_processing_time"),
        F.avg(seconds).alias("average_processing_time"),
        F.avg(success).alias("success_rate"),
    )


def timeframe(period: str, now: datetime) -> tuple[datetime, datetime]:
    """Start and end of the period that ends now; a week unless told otherwise."""
    if period == "day":
        return now - timedelta(days=1), now
    if period == "month":
        year, month = (now.year, now.month - 1) if now.month > 1 else (now.year - 1, 12)
        return _roll_over(now, year, month), now
    if period == "year":
        return _roll_over(now, now.year - 1, now.month), now
    return now - timedelta(days=7), now


def _roll_over(now: datetime, year: int, month: int) -> datetime:
    """The same day of another month; days that month lacks run on into the next one."""
    return now.replace(year=year, month=month, day=1) + timedelta(days=now.day - 1)


# Item states of a batch.
ITEM_STATES = ("pending", "processing", "completed", "failed", "skipped")


def batch_progress(items: DataFrame) -> DataFrame:
    """Items per state and batch with the finished share in percent."""
    table = items.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ITEM_STATES],
    )
    return table.withColumn("percentage", F.round(F.col("completed") * 100.0 / F.col("total"), 2))


def batch_summary(items: DataFrame) -> DataFrame:
    """Processed, successful, failed and skipped items, time from first start to last end, and overall success per batch."""
    failed = F.count_if(F.col("status") == "failed")
    return items.groupBy("batch_id").agg(
        F.count_if(F.col("status").isin("completed", "failed")).alias("processed"),
        F.count_if(F.col("status") == "completed").alias("successful"),
        failed.alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.timestamp_diff("MILLISECOND", F.min("started_at"), F.max("completed_at")).alias("processing_ms"),
        (failed == 0).alias("success"),
    )


def profile_report(profiles: DataFrame, resources: bool = False) -> DataFrame:
    """Runs and durations per operation; with resources also mean memory and CPU."""
    extra = []
    if resources:
        extra = [F.avg("mem_diff").alias("avg_memory"), F.avg("cpu").alias("avg_cpu")]
    return profiles.groupBy("operation").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("duration_ms").alias("avg_ms"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.sum("duration_ms").alias("total_ms"),
        *extra,
    )


def slowest_operations(profiles: DataFrame, k: int = PROFILE_TOP) -> DataFrame:
    return profile_report(profiles).orderBy(F.desc("avg_ms"), "operation").limit(k)


def truncated(value: Column, digits: int = 2) -> Column:
    factor = 10 ** digits
    return F.floor(value * factor) / factor


def compare_benchmark(report: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Mean time against the benchmark of the operation: slower, faster, normal or not known."""
    joined = report.join(benchmark.select("operation", "benchmark_ms"), "operation", "left")
    ratio = truncated(F.col("avg_ms") / F.col("benchmark_ms"))
    return joined.withColumn("ratio", ratio).withColumn(
        "verdict",
        F.when(F.col("benchmark_ms").isNull(), "N/A")
        .when(F.col("ratio") > 1.5, "slower")
        .when(F.col("ratio") < 0.8, "faster")
        .otherwise("normal"),
    )


# Rows of one block, and maps that are composed at once.
EWMA_BLOCK, EWMA_FAN = 512, 64


def _floor_div(x: Column, n: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n)).cast("long")


def _fold(values: Column, start: Column) -> Column:
    """The average, in hundredths, carried through values in order and cut at every step."""
    return F.aggregate(values, start.cast("long"), lambda h, v: _floor_div(h * 4, 5) + v * 20)


def _unfold(values: Column, end: Column) -> Column:
    """The least average ahead of the values from which at least ``end`` comes out."""
    return F.aggregate(F.reverse(values), end, lambda y, v: _floor_div((y - v * 20) * 5 + 3, 4))


def _compose(older: Column, newer: Column) -> Column:
    """One map after another; each is what the least average becomes, and where one more comes out."""
    base = newer["base"] + F.size(F.filter(newer["cuts"], lambda x: x <= older["base"]))
    cuts = F.filter(older["cuts"], lambda x, i: F.array_contains(newer["cuts"], older["base"] + i + 1))
    return F.struct(base.cast("long").alias("base"), cuts.alias("cuts"))


def ewma_maps(df: DataFrame, groups: list[str], order: list[str], value: str = "duration_ms",
              block: int = EWMA_BLOCK, start: DataFrame | None = None) -> DataFrame:
    """(groups, block, runs, map) of every ``block`` rows of a group, counted from its newest row.

    A map says what a block makes of every average that can come into it.  One more in gives one more out or none, so a
    map is the least outcome (``base``) and the averages at which one more comes out (``cuts``).  Only the oldest block can be
    short; its start is known, so its map is a constant.  The others shrink what comes in to few outcomes: after 128 rows at most
    five for any values below a billion.
    """
    slim = df.select(*groups, *order, F.col(value).cast("long").alias("v"))
    rows = in_ranges(slim, groups, order)
    heads = totals_ahead(rows, groups, "v").withColumn("group_start", F.lit(None).cast("long"))
    if start is not None:
        known = start.select(*[F.col(g).alias(f"_own_{g}") for g in groups], F.col("hundredths").alias("_start"), F.col("runs").alias("_before"))
        same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_own_{g}")) for g in groups])
        heads = heads.join(known, same, "left").withColumn("group_start", F.col("_start")).withColumn("group_before", F.col("_before"))
        heads = heads.drop("_start", "_before", *[f"_own_{g}" for g in groups])
    else:
        heads = heads.withColumn("group_before", F.lit(0).cast("long"))
    facts = ["group_size", "group_low", "group_high", "group_start", "group_before"]
    at = F.floor((F.col("group_size") - F.col("rank")) / block).alias("block")
    blocks = ranked(rows, heads, groups, order).groupBy(*groups, at).agg(
        F.array_sort(F.collect_list(F.struct("rank", "v")))["v"].alias("vs"), *[F.first(c).alias(c) for c in facts])
    oldest = F.col("block") == F.floor((F.col("group_size") - 1) / block)
    seed = F.element_at("vs", 1) * 100
    known_start = F.coalesce("group_start", seed)
    fed = F.when(F.col("group_start").isNull(), F.slice("vs", 2, block)).otherwise(F.col("vs"))
    low = F.least(F.col("group_low") * 100, "group_start")
    high = F.greatest(F.col("group_high") * 100, "group_start")
    ends = blocks.withColumns({
        "base": F.when(oldest, _fold(fed, known_start)).otherwise(_fold(F.col("vs"), low)),
        "top": F.when(oldest, None).otherwise(_fold(F.col("vs"), high)),
    })
    outcomes = F.when(F.col("top") > F.col("base"), F.sequence(F.col("base") + 1, F.col("top"))).otherwise(F.array().cast("array<bigint>"))
    cuts = F.transform(outcomes, lambda y: _unfold(F.col("vs"), y))
    runs = (F.col("group_size") + F.coalesce("group_before", F.lit(0))).alias("runs")
    return ends.select(*groups, "block", runs, F.struct("base", cuts.alias("cuts")).alias("map"))


def ewma_level(maps: DataFrame, groups: list[str], fan: int = EWMA_FAN) -> DataFrame:
    """``maps`` with up to ``fan`` neighbours composed to one."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("block")).alias("at"), "map")))["map"]
    joined = maps.groupBy(*groups, "runs", F.floor(F.col("block") / fan).alias("block")).agg(listed.alias("_maps"))
    whole = F.aggregate(F.slice("_maps", 2, fan), F.element_at("_maps", 1), _compose)
    return joined.select(*groups, "block", "runs", whole.alias("map"))


def ewma(df: DataFrame, groups: list[str], order: list[str], value: str = "duration_ms", block: int = EWMA_BLOCK,
         start: DataFrame | None = None, fan: int = EWMA_FAN) -> DataFrame:
    """Running benchmark 0.8 * old + 0.2 * new per group, cut to two decimals at every step.

    ``value`` is a whole number.  Steps that cut can't be reordered, but they can be composed: every ``block`` rows become a map in a
    task of their own, and maps are composed ``fan`` at a time, level by level.  No array is longer than ``block`` or ``fan``, and a
    group of any length is spread over all tasks.  ``start`` (groups, hundredths, runs) carries on earlier averages.
    """
    maps = cut_lineage(ewma_maps(df, groups, order, value, block, start))
    longest = maps.agg(F.max("block")).first()[0]
    while longest:
        maps, longest = ewma_level(maps, groups, fan), longest // fan
    return maps.select(*groups, "runs", (F.col("map.base") / 100).alias("ewma"))


def search_term_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("term").agg(
        F.count(F.lit(1)).alias("searches"), F.max("searched_at").alias("last_searched")
    )


def pivot_fields(fields: DataFrame, names: list[str], key: str = "content_id") -> DataFrame:
    """Field rows to one column per named field, in one aggregation."""
    return fields.groupBy(key).pivot("field_name", names).agg(F.max("field_value"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, one row each."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    total = counts[0]
    for one in counts[1:]:
        total = total.unionByName(one)
    return total


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of every table in order, with their types and the table's row count.

    Counts need no column, so a Parquet table answers from its footers; names and types come from its schema.
    """
    counts = table_counts(tables)
    shape = "struct<ordinal: int, column_name: string, data_type: string>"
    columns = F.lit(None).cast(f"array<{shape}>")
    for name, df in tables.items():
        listed = [{"ordinal": at, "column_name": c, "data_type": kind} for at, (c, kind) in enumerate(df.dtypes, 1)]
        columns = F.when(F.col("table_name") == name, F.from_json(F.lit(json.dumps(listed)), f"array<{shape}>")).otherwise(columns)
    return counts.select("table_name", "rows", F.explode(columns).alias("_c")).select("table_name", "_c.*", "rows")


def session_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Tables and views of the session's current database by name."""
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables()}
