"""Filtered lists: content, entities, batches, logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import contains_folded, moment
from docloom.options import CONFIDENCE_THRESHOLD, RETENTION_DAYS

# Log levels by severity.
LOG_LEVELS = {"debug": 0, "info": 1, "warning": 2, "error": 3}


def list_content(df: DataFrame, content_type: str | None = None, query: str | None = None,
                 columns: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """Content of a type whose title or text contains the query, case ignored."""
    if content_type is not None:
        df = df.filter(F.col("content_type") == content_type)
    if query is not None:
        hit = F.lit(False)
        for name in columns:
            hit = hit | F.coalesce(contains_folded(F.col(name), query), F.lit(False))
        df = df.filter(hit)
    return df


def list_entities(df: DataFrame, entity_type: str | None = None, query: str | None = None,
                  min_confidence: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Entities of a type, by name part and least confidence."""
    df = df.filter(F.col("confidence") >= min_confidence)
    if entity_type is not None:
        df = df.filter(F.col("entity_type") == entity_type)
    if query is not None:
        df = df.filter(contains_folded(F.col("name"), query))
    return df


def batch_filter(df: DataFrame, content_types: list[str] | None = None,
                 created_after: datetime | str | None = None,
                 created_before: datetime | str | None = None, created: str = "created_at") -> DataFrame:
    """Batch input by type and creation time; plain comparisons, so they reach the file scan."""
    if content_types:
        df = df.filter(F.col("content_type").isin(*content_types))
    if created_after is not None:
        df = df.filter(F.col(created) > moment(created_after, df.schema[created].dataType))
    if created_before is not None:
        df = df.filter(F.col(created) < moment(created_before, df.schema[created].dataType))
    return df


def list_batches(batches: DataFrame, status: str | None = None) -> DataFrame:
    return batches if status is None else batches.filter(F.col("status") == status)


def list_items(items: DataFrame, batch: object, status: str | None = None) -> DataFrame:
    items = items.filter(F.col("batch_id") == F.lit(batch))
    return items if status is None else items.filter(F.col("status") == status)


def select_items(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Items named by an id table, each once however often it is named."""
    return df.join(ids.select(key), key, "left_semi")


def logs_where(df: DataFrame, field: str, value: str, line: str = "line") -> DataFrame:
    """Log lines whose JSON field has the value."""
    return df.filter(F.get_json_object(F.col(line), f"$.{field}") == value)


def level_number(level: Column) -> Column:
    number = F.lit(None).cast("int")
    for name, rank in LOG_LEVELS.items():
        number = F.when(F.lower(level) == name, rank).otherwise(number)
    return number


def logs_at_least(df: DataFrame, level: str, column: str = "level") -> DataFrame:
    """Log records of the level or a more severe one."""
    return df.filter(level_number(F.col(column)) >= LOG_LEVELS[level])


def retain(df: DataFrame, ts: str, now: datetime | str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of the last days.  The bound is a constant, so old files and partitions are skipped."""
    bound = moment(now, df.schema[ts].dataType) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter(F.col(ts) >= bound)
