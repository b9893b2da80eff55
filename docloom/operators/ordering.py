"""Order-dependent operators that never pull a whole group into one task.

A plain window over a group needs all its rows in one task.  Here rows are dealt to ranges of (group, order) and
written; the rows of each group are counted in each range; running totals of these counts, one row for each group and
range, say how many rows of its group are ahead of a range; and rows are ranked only within their range.  Rows that
are equal in all order columns are dealt by a hash of the row and then by their place in the input, so a single value that
all rows share is cut into as many ranges as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.options import KEPT_VERSIONS, LOG_RESULT_LIMIT
from docloom.session import cut_lineage

RANGE, TIES = "_range", ("_tie", "_at")


def in_ranges(df: DataFrame, groups: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` dealt to ranges of (groups, order) and written, with the number of each row's range and what breaks ties.

    Rows that are equal in everything are in an order of their own; it changes no result, as nothing tells them apart.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    rows = df.withColumns({TIES[0]: F.xxhash64(*hashed), TIES[1]: F.monotonically_increasing_id()})
    return cut_lineage(rows.repartitionByRange(parts, *groups, *order, *TIES).withColumn(RANGE, F.spark_partition_id()))


def totals_ahead(rows: DataFrame, groups: list[str], value: str | None = None) -> DataFrame:
    """For each group and range: ``_rows_ahead`` and ``group_size``; with ``value`` also its sum ahead, least and greatest."""
    ahead = Window.partitionBy(*groups).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)  # a group has at most one row for each range here
    facts = {"_rows": F.count(F.lit(1))}
    if value:
        facts |= {"_sum": F.sum(value), "_low": F.min(value), "_high": F.max(value)}
    parts = rows.groupBy(*groups, RANGE).agg(*[how.alias(name) for name, how in facts.items()])
    out = {"_rows_ahead": F.coalesce(F.sum("_rows").over(ahead), F.lit(0)), "group_size": F.sum("_rows").over(whole)}
    if value:
        out |= {"_sum_ahead": F.coalesce(F.sum("_sum").over(ahead), F.lit(0)),
                "group_low": F.min("_low").over(whole), "group_high": F.max("_high").over(whole)}
    return parts.select(*groups, RANGE, *[how.alias(name) for name, how in out.items()])


def ranked(rows: DataFrame, heads: DataFrame, groups: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """Rows of ``in_ranges`` with ``rank``, ``running_sum`` of ``value``, and the other columns of ``heads``.

    ``heads`` has one row for each group and range, which goes first in its range; so totals come along with the one
    shuffle that ranking needs, without a join.
    """
    carried = [c for c in heads.columns if c not in (*groups, RANGE)]
    both = rows.withColumn("_head", F.lit(0)).unionByName(heads.withColumn("_head", F.lit(1)), allowMissingColumns=True)
    inner = Window.partitionBy(*groups, RANGE).orderBy(F.desc("_head"), *order, *TIES)
    so_far = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    facts = {c: F.first(c).over(so_far) for c in carried}
    out = {"rank": F.row_number().over(inner) - 1 + facts["_rows_ahead"]}
    if value:
        out["running_sum"] = F.sum(value).over(so_far) + facts["_sum_ahead"]
    out |= {c: how for c, how in facts.items() if not c.startswith("_")}
    plain = [c for c in rows.columns if c not in (RANGE, *TIES)]
    return both.select(*plain, "_head", *[how.alias(c) for c, how in out.items()]).filter("_head = 0").drop("_head")


def with_ranks(df: DataFrame, groups: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """Add ``rank`` (1-based), ``group_size`` and, with ``value``, ``running_sum`` within each group."""
    rows = in_ranges(df, groups, order)
    out = ranked(rows, totals_ahead(rows, groups, value), groups, order, value)
    return out.drop("group_low", "group_high")


def systematic_sample(df: DataFrame, groups: list[str], order: list[str], k: int) -> DataFrame:
    """k of n rows per group at the places floor(i * n / k); all of them if there are no more than k."""
    rows = with_ranks(df, groups, order)
    place, size = F.col("rank") - 1, F.col("group_size")
    near = F.floor(place * k / size)
    taken = size <= k
    for shift in (0, 1, 2):
        i = near + shift
        taken = taken | ((i < k) & (F.floor(i * (size / k)) == place))
    return rows.filter(taken).drop("rank", "group_size")


def running_progress(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Share of the group that is done once each row is done, in percent."""
    rows = with_ranks(df, groups, order)
    return rows.withColumn("progress", F.col("rank") * 100.0 / F.col("group_size"))


def remaining_time(df: DataFrame, groups: list[str], order: list[str], duration: str = "duration_ms") -> DataFrame:
    """Mean item time so far times the items that remain."""
    rows = with_ranks(df, groups, order, duration)
    mean = F.col("running_sum") / F.col("rank")
    return rows.withColumn("eta_ms", mean * (F.col("group_size") - F.col("rank")))


def around_matches(lines: DataFrame, hit: Column, file: str = "file", number: str = "n",
                   limit: int | None = LOG_RESULT_LIMIT) -> DataFrame:
    """Matching lines with one line before and one after, in file order.

    Neighbours are found by their number with a semi join on (file, number), so one huge file spreads
    over all tasks.
    """
    wanted = (
        lines.filter(hit)
        .select(file, F.explode(F.sequence(F.col(number) - 1, F.col(number) + 1)).alias(number))
        .distinct()
    )
    found = lines.join(wanted, [file, number], "left_semi")
    return found.orderBy(file, number).limit(limit) if limit is not None else found


def keep_newest(df: DataFrame, groups: list[str], order: list[str], keep: int = KEPT_VERSIONS) -> DataFrame:
    """The newest versions per group; each task drops all but ``keep`` rows before the shuffle."""
    newest = Window.partitionBy(*groups).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= keep).drop("_rank")


# Job status per event kind, and the states a job can be canceled from.
JOB_STATUS = {
    "created": "pending", "started": "processing", "progress": "processing",
    "completed": "completed", "failed": "failed", "canceled": "canceled",
}
CANCELABLE = ("pending", "processing")


def job_status(event: Column) -> Column:
    status = F.lit(None).cast("string")
    for kind, state in JOB_STATUS.items():
        status = F.when(event == kind, state).otherwise(status)
    return status


TERMINAL = ("completed", "failed", "canceled")


def latest_status(events: DataFrame, order: list[str], job: str = "job_id") -> DataFrame:
    """Status of every job and how many cancels were rejected.

    A job ends with its first terminal event; a cancel counts only ahead of that.  So one aggregate
    over minima and maxima replaces a walk through the events.
    """
    at = F.struct(*order)
    rows = events.withColumn("_status", job_status(F.col("event"))).filter(F.col("_status").isNotNull())
    ends = F.col("_status").isin(*TERMINAL)
    facts = rows.groupBy(job).agg(
        F.max_by("_status", at).alias("_last"),
        F.min_by("_status", F.when(ends, at)).alias("_end"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("_status") == "canceled").alias("_cancels"),
    )
    canceled = F.coalesce(F.col("_end") == "canceled", F.lit(False))
    return facts.select(
        job,
        F.coalesce("_end", "_last").alias("status"),
        "events",
        (F.col("_cancels") - canceled.cast("int")).alias("rejected_cancels"),
    )


# Page size caps and the fields lists can be sorted by.
PAGE_CAPS = {"content": 100, "entity": 200, "batch": 100}
SORT_FIELDS = {
    "content": {"createdAt": "created_at", "updatedAt": "updated_at", "title": "title",
                "type": "content_type"},
    "entity": {"createdAt": "created_at", "name": "name", "type": "entity_type",
               "confidence": "confidence"},
    "batch": {"createdAt": "created_at", "status": "status", "priority": "priority"},
}


def sort_column(kind: str, field: str) -> str:
    try:
        return SORT_FIELDS[kind][field]
    except KeyError:
        raise ValueError(f"cannot sort {kind} by {field}") from None


def page(df: DataFrame, sort: str, key: str, order: str = "desc", limit: int = 20, offset: int = 0,
         cap: int | None = None) -> DataFrame:
    """One page of rows; the key breaks ties, so pages never overlap.  A limit above ``cap`` counts as ``cap``."""
    if order not in ("asc", "desc"):
        raise ValueError(f"unknown order: {order}")
    size = limit if cap is None else min(limit, cap)
    first = F.col(sort).asc() if order == "asc" else F.col(sort).desc()
    return df.orderBy(first, F.col(key)).offset(offset).limit(size)


def page_info(df: DataFrame, limit: int = 20, offset: int = 0, cap: int | None = None) -> DataFrame:
    """Total under the filter with the offsets of the next and the previous page."""
    size = limit if cap is None else min(limit, cap)
    total = F.col("total")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(size).alias("limit"), F.lit(offset).alias("offset"), total,
        F.when(total > offset + size, F.lit(offset + size)).alias("next_offset"),
        F.when(F.lit(offset > 0), F.lit(max(0, offset - size))).alias("previous_offset"),
    )


def by_priority(df: DataFrame, key: str = "item_id") -> DataFrame:
    """Highest priority first."""
    return df.orderBy(F.desc("priority"), key)
