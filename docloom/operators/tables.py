"""Writes as table transformations.

Each operator returns the new full table; the caller writes it as a new snapshot and never over the
path it reads.  Updates with many rows shuffle on the key once; deletes are anti joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.json_columns import merge_json
from docloom.functions.names import entity_key
from docloom.functions.text import moment
from docloom.operators.joins import check_edges


def insert_unique(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add rows whose key is not there yet; of several new rows the first in order is taken.

    The choice is an aggregate, so repeats are folded ahead of the shuffle.
    """
    columns = [c for c in existing.columns if c not in keys]
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")
    fresh = new.groupBy(*keys).agg(first).select(*keys, "_row.*")
    fresh = fresh.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def last_per_key(patch: DataFrame, key: str, columns: list[str], order: list[str] | None) -> DataFrame:
    """The last patch of every key; without an order the keys must be unique."""
    if order is None:
        return patch.select(key, *columns)
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return patch.groupBy(key).agg(last).select(key, "_row.*")


def patch_metadata(content: DataFrame, patch: DataFrame, now: object, key: str = "content_id",
                   order: list[str] | None = None) -> DataFrame:
    """Merge JSON patches into the metadata, right side wins, and move updated_at."""
    changes = last_per_key(patch, key, ["metadata"], order).withColumnRenamed("metadata", "_patch")
    joined = content.join(changes, key, "left")
    changed = F.col("_patch").isNotNull()
    return joined.withColumns(
        {
            "metadata": F.when(changed, merge_json(F.col("metadata"), F.col("_patch")))
            .otherwise(F.col("metadata")),
            "updated_at": F.when(changed, moment(now, content.schema["updated_at"].dataType))
            .otherwise(F.col("updated_at")),
        }
    ).select(*content.columns)


def without(df: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose column is not among the removed keys."""
    return df.join(gone.select(F.col(key).alias(column)), column, "left_anti").select(*df.columns)


def delete_content(tables: dict[str, DataFrame], gone: DataFrame, key: str = "content_id") -> dict[str, DataFrame]:
    """Remove content and every row of the other tables that refers to it."""
    return {name: without(df, gone, key, key) for name, df in tables.items()}


def delete_entities(entities: DataFrame, links: DataFrame, relations: DataFrame, aliases: DataFrame,
                    gone: DataFrame) -> dict[str, DataFrame]:
    """Remove entities with their links, relations in both directions, and aliases."""
    kept = without(relations, gone, "source_id", "entity_id")
    return {
        "entities": without(entities, gone, "entity_id", "entity_id"),
        "links": without(links, gone, "entity_id", "entity_id"),
        "relations": without(kept, gone, "target_id", "entity_id"),
        "aliases": without(aliases, gone, "entity_id", "entity_id"),
    }


def manual_entities(df: DataFrame, content_ids: str = "content_ids") -> tuple[DataFrame, DataFrame]:
    """Entities entered by hand and their links: source ``manual``, confidence 1."""
    rows = df.withColumns(
        {
            "entity_id": entity_key(F.col("entity_type"), F.col("name")),
            "source": F.lit("manual"),
            "confidence": F.lit(1.0),
        }
    )
    entities = rows.drop(content_ids)
    links = rows.select(
        F.explode(content_ids).alias("content_id"), "entity_id", F.lit(1.0).alias("relevance"),
        F.lit("manual").alias("source"),
    ).distinct()
    return entities, links


def patch_rows(table: DataFrame, patch: DataFrame, key: str, columns: list[str],
               order: list[str] | None = None) -> DataFrame:
    """Overwrite columns with the values of the patch that are not null."""
    renamed = last_per_key(patch, key, columns, order).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*table.columns)


RELATION = ["source_id", "target_id", "relationship_type"]


def add_relations(relations: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """Add relations whose ends exist and that are not there yet."""
    valid, _ = check_edges(new, entities)
    fresh = valid.groupBy(*RELATION).agg(F.max("strength").alias("strength"))
    fresh = fresh.join(relations.select(*RELATION), RELATION, "left_anti")
    return relations.select(*RELATION, "strength").unionByName(fresh)


def delete_relation(relations: DataFrame, relation_id: object) -> DataFrame:
    return relations.filter(F.col("relation_id") != F.lit(relation_id))


def record_results(items: DataFrame) -> DataFrame:
    """Processing results of items with ``success`` and ``error``: failed ones carry a JSON error."""
    failed = ~F.col("success")
    return items.select(
        "content_id",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, F.to_json(F.struct(F.col("error").alias("message")))).alias("error"),
        F.when(~failed, F.to_json(F.struct("entity_count"))).alias("results"),
    )


def union_of(frames: dict[str, DataFrame], label: str = "database") -> DataFrame:
    """Rows of several databases or tables under one label column."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
