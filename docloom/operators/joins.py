"""Queries over content, entities, links and edges.

Joins are left to the optimizer: filters sit below them, and a side is broadcast only where its
measured size allows it.  Nothing here pairs the members of a group with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import contains_folded
from docloom.options import RELATED_ENTITY_CAP, RELATED_LIMIT


def entities_of(links: DataFrame, entities: DataFrame, content_id: object,
                content_type: str | None = None) -> DataFrame:
    """Entities of a content item, most relevant first."""
    mine = links.filter(F.col("content_id") == F.lit(content_id))
    if content_type is not None:
        mine = mine.filter(F.col("content_type") == content_type)
    return (
        mine.join(entities, "entity_id")
        .select("entity_id", "name", "entity_type", "description", "relevance", "context")
        .orderBy(F.desc("relevance"), "entity_type", "name")
    )


def entities_with_mentions(links: DataFrame, entities: DataFrame, content_id: object,
                           content_type: str | None = None) -> DataFrame:
    """Entities of a content item, each with its mentions as a list, most relevant first.

    The lists are of one item; a mention's place in the text is not stored, so its position is 0.
    """
    mine = links.filter(F.col("content_id") == F.lit(content_id))
    if content_type is not None:
        mine = mine.filter(F.col("content_type") == content_type)
    mention = F.struct((-F.col("relevance")).alias("_order"), "context", F.lit(0).alias("position"), "relevance")
    listed = mine.groupBy("entity_id").agg(F.array_sort(F.collect_list(mention)).alias("_m"))
    plain = F.transform("_m", lambda m: m.dropFields("_order")).alias("mentions")
    rows = listed.select("entity_id", plain).join(entities, "entity_id")
    return rows.select("entity_id", "name", F.col("entity_type").alias("type"), "description", "mentions").orderBy(
        F.desc(F.col("mentions")[0]["relevance"]), "type", "name")


def content_mentioning(content: DataFrame, links: DataFrame, entities: DataFrame, name: str,
                       entity_type: str | None = None) -> DataFrame:
    """Content linked to an entity whose name contains the given text."""
    wanted = entities.filter(contains_folded(F.col("name"), name))
    if entity_type is not None:
        wanted = wanted.filter(F.col("entity_type") == entity_type)
    hits = links.join(wanted.select("entity_id", "name"), "entity_id")
    return hits.select("content_id", "name", "context", "relevance").join(
        content.select("content_id", "title"), "content_id"
    )


def related_content(links: DataFrame, content: DataFrame, content_id: object,
                    k: int = RELATED_LIMIT) -> DataFrame:
    """Other content that shares entities with an item, most shared entities first.

    The probe side is the entity set of one item; adaptive execution knows its size and broadcasts it
    where it is small.  The link table is filtered by it where it lies and is never paired with itself row by row.
    """
    mine = links.filter(F.col("content_id") == F.lit(content_id)).select("entity_id").distinct()
    shared = (
        links.filter(F.col("content_id") != F.lit(content_id))
        .join(mine, "entity_id", "left_semi")
        .groupBy("content_id")
        .agg(F.count_distinct("entity_id").alias("matching_entities"))
    )
    return (
        shared.join(content, "content_id")
        .orderBy(F.desc("matching_entities"), "content_id")
        .limit(k)
    )


def search_entities(entities: DataFrame, mentions: DataFrame, query: str, types: list[str] | None = None,
                    limit: int = 20, key: str = "entity_id") -> DataFrame:
    """Entities by name part and types with their mentions; the limit counts entities."""
    hits = entities.filter(contains_folded(F.col("name"), query))
    if types:
        hits = hits.filter(F.col("entity_type").isin(*types))
    hits = hits.orderBy("name", key).limit(limit)
    return hits.join(mentions, key, "left")


def get_entity(entities: DataFrame, mentions: DataFrame, entity_id: str | None = None,
               name: str | None = None, entity_type: str | None = None) -> DataFrame:
    """One entity by id or by (name, type) with its mentions, most relevant first."""
    if entity_id is not None:
        one = entities.filter(F.col("entity_id") == entity_id)
    else:
        one = entities.filter((F.col("name") == name) & (F.col("entity_type") == entity_type))
    return one.join(mentions, "entity_id", "left").orderBy(F.desc("relevance"), "context")


def related_entities(edges: DataFrame, entities: DataFrame, entity_id: object,
                     relationship_type: str | None = None, limit: int = 20, cap: int | None = RELATED_ENTITY_CAP) -> DataFrame:
    """Entities on the other end of the edges of one entity, with the direction; a limit above ``cap`` counts as ``cap``."""
    if relationship_type is not None:
        edges = edges.filter(F.col("relationship_type") == relationship_type)
    me = F.lit(entity_id)
    outgoing = edges.filter(F.col("source_id") == me).select(
        F.col("target_id").alias("entity_id"), "relationship_type", F.lit("outgoing").alias("direction")
    )
    incoming = edges.filter((F.col("target_id") == me) & (F.col("source_id") != me)).select(
        F.col("source_id").alias("entity_id"), "relationship_type", F.lit("incoming").alias("direction")
    )
    both = outgoing.unionByName(incoming).join(entities, "entity_id")
    return both.orderBy("direction", "relationship_type", "entity_id").limit(limit if cap is None else min(limit, cap))


def top_mentions(entities: DataFrame, links: DataFrame, entity_type: str, content_type: str,
                 min_relevance: float, k: int = 10) -> DataFrame:
    """The most relevant links of a type of entity in a type of content."""
    strong = links.filter((F.col("content_type") == content_type) & (F.col("relevance") > min_relevance))
    return (
        strong.join(entities.filter(F.col("entity_type") == entity_type), "entity_id")
        .select("content_id", "name", "entity_type", "relevance")
        .orderBy(F.desc("relevance"), "name", "content_id")
        .limit(k)
    )


def judge_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with ``valid``: whether both ends exist.  One scan of the edges, whichever side is asked for."""
    ids = entities.select("entity_id").distinct()
    source = ids.select(F.col("entity_id").alias("source_id"), F.lit(True).alias("_source"))
    target = ids.select(F.col("entity_id").alias("target_id"), F.lit(True).alias("_target"))
    joined = edges.join(source, "source_id", "left").join(target, "target_id", "left")
    valid = F.col("_source").isNotNull() & F.col("_target").isNotNull()
    return joined.select(*edges.columns, valid.alias("valid"))


def check_edges(edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose two ends exist, and the rejected others."""
    judged = judge_edges(edges, entities)
    return judged.filter("valid").drop("valid"), judged.filter("NOT valid").drop("valid")


def with_tag(content: DataFrame, content_tags: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Content that carries a tag."""
    marked = content_tags.join(tags.filter(F.col("name") == tag), "tag_id").select("content_id")
    return content.join(marked.distinct(), "content_id")


def key_lookup_join(data: DataFrame, index: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Rows of a two-table join under one index key, highest id first."""
    return (
        data.join(index.filter(F.col("key") == key), data["id"] == index["data_id"])
        .select("id", "content", "key", "value")
        .orderBy(F.desc("id"), "value")
        .limit(k)
    )


def in_search_result(df: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a search result."""
    return df.join(hits.select(key), key, "left_semi")


def union_of_matches(matches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that any of the lists of matches has, once each; repeats of a list are folded ahead of the shuffle."""
    return reduce(lambda a, b: a.unionByName(b), [m.select(*keys) for m in matches]).distinct()
