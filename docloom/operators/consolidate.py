"""Entity consolidation: merge, filter, resolve, link.

Mentions stay rows.  An entity that occurs in a third of all documents is one entity row and many
mention rows, never one row with an array of all its mentions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docloom.functions.names import entity_key, normalize_name, validate_type
from docloom.operators.chunking import chunk
from docloom.operators.extraction import extract
from docloom.operators.rules import PROSE_RULES, Rule
from docloom.options import CONFIDENCE_THRESHOLD, DEFAULT_LINK_RELEVANCE, MAX_ENTITIES, ExtractOptions

ENTITY = ["entity_type", "name"]


def _order(order: list[str]) -> Column:
    return F.struct(*order)


def merge_entities(mentions: DataFrame, keys: list[str], description: str = "longest",
                   order: list[str] | None = None) -> DataFrame:
    """One row per entity within the keys.

    ``description`` picks the longest one (the first of equal length) or the first non-empty one.
    ``ordinal`` is the position of the first mention; the mention rows keep the full list.
    """
    order = order or ["ordinal"]
    text = F.col("description")
    if description == "longest":
        longest = F.max_by(text, F.when(text.isNotNull(), F.struct(F.length(text), *[-F.col(c) for c in order])))
        chosen = longest
    elif description == "first":
        chosen = F.min_by(text, F.when(F.coalesce(text, F.lit("")) != "", _order(order)))
    else:
        raise ValueError(f"unknown description choice: {description}")
    return mentions.groupBy(*keys, *ENTITY).agg(
        F.min(_order(order)).alias("first_seen"),
        chosen.alias("description"),
        F.max("relevance").alias("relevance"),
        F.count(F.lit(1)).alias("mention_count"),
    )


def collect_mentions(mentions: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Nested mentions per entity of one content item; the keys must name the content item."""
    if not keys:
        raise ValueError("nested mentions need the key of a content item")
    order = order or ["ordinal"]
    rows = F.collect_list(F.struct(*order, "context", "position", "relevance"))
    return mentions.groupBy(*keys, *ENTITY).agg(
        F.transform(
            F.array_sort(rows),
            lambda m: F.struct(m["context"].alias("context"), m["position"].alias("position"),
                               m["relevance"].alias("relevance")),
        ).alias("mentions")
    )


def normalize_entities(mentions: DataFrame) -> DataFrame:
    """Valid types and canonical names."""
    return mentions.withColumn("entity_type", validate_type(F.col("entity_type"))).withColumn(
        "name", normalize_name(F.col("name"), F.col("entity_type"))
    )


def any_mention_reaches(mentions: Column, threshold: float) -> Column:
    """Confidence test on nested mentions."""
    return F.exists(mentions, lambda m: m["relevance"] >= threshold)


def filter_confidence(entities: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Entities with a mention at or above the threshold (``relevance`` is the best of an entity)."""
    return entities.filter(F.col("relevance") >= threshold)


def filter_types(entities: DataFrame, types: list[str]) -> DataFrame:
    return entities.filter(F.col("entity_type").isin(*types)) if types else entities


def filter_entities(mentions: DataFrame, keys: list[str], threshold: float | None = CONFIDENCE_THRESHOLD,
                    types: list[str] | None = None, limit: int | None = MAX_ENTITIES,
                    order: list[str] | None = None) -> DataFrame:
    """Entities per key after confidence, then type, then the first N in order of appearance."""
    entities = merge_entities(mentions, keys, order=order)
    if threshold is not None:
        entities = filter_confidence(entities, threshold)
    if types:
        entities = filter_types(entities, types)
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("first_seen", *ENTITY))
        entities = entities.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return entities


def extract_chunked(df: DataFrame, keys: list[str], strategy: str = "paragraph",
                    max_size: int | None = None, overlap: int | None = None, text: str = "text",
                    rules: tuple[Rule, ...] = PROSE_RULES,
                    options: ExtractOptions | None = None) -> DataFrame:
    """Extraction per chunk, then one entity per type and name with the first non-empty description."""
    chunks = chunk(df, keys, strategy, max_size, overlap, text)
    mentions = extract(chunks, [*keys, "chunk_index"], "chunk_text", rules, None, options)
    return merge_entities(mentions, keys, "first", ["chunk_index", "ordinal"])


def with_entity_id(df: DataFrame) -> DataFrame:
    return df.withColumn("entity_id", entity_key(F.col("entity_type"), F.col("name")))


def upsert_entities(existing: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Full entity table: known (type, name) keep id and description, the others are added."""
    order = order or ["description"]
    added = with_entity_id(
        new.groupBy(*ENTITY).agg(F.min_by("description", _order(order)).alias("description"))
    )
    added = added.join(existing.select(*ENTITY), ENTITY, "left_anti")
    columns = ["entity_id", *ENTITY, "description"]
    return existing.select(*columns).unionByName(added.select(*columns))


LINK = ["content_id", "content_type", "entity_id"]


def upsert_links(existing: DataFrame | None, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Full link table, one row per link key; the last new mention overwrites relevance and context.

    A partial aggregate keeps one row per key before the shuffle, however often a link repeats.
    """
    order = order or ["ordinal"]
    tagged = new.select(*LINK, "relevance", "context", F.lit(1).alias("_version"), *order)
    if existing is not None:
        zero = [F.lit(None).cast(new.schema[c].dataType).alias(c) for c in order]
        old = existing.select(*LINK, "relevance", "context", F.lit(0).alias("_version"), *zero)
        tagged = tagged.unionByName(old)
    latest = F.max_by(F.struct("relevance", "context"), F.struct("_version", *order)).alias("_latest")
    return tagged.groupBy(*LINK).agg(latest).select(*LINK, "_latest.relevance", "_latest.context")


def store_entities(mentions: DataFrame, entities: DataFrame | None = None, links: DataFrame | None = None,
                   order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """New entity and link tables from mention rows with content_id and content_type.

    An entity without mentions (no relevance) is linked with the default relevance and no context.
    """
    order = order or ["ordinal"]
    rows = with_entity_id(normalize_entities(mentions))
    seen = F.struct("content_id", *order)
    # Spellings are far fewer than mentions: the first mention of each is found ahead of names and ids.
    spelled = mentions.groupBy(*ENTITY).agg(F.min_by("description", seen).alias("description"), F.min(seen).alias("_seen"))
    fresh = with_entity_id(normalize_entities(spelled)).groupBy("entity_id", *ENTITY).agg(
        F.min_by("description", "_seen").alias("description")
    )
    columns = ["entity_id", *ENTITY, "description"]
    table = fresh.select(*columns)
    if entities is not None:
        known = entities.select(*columns)
        table = known.unionByName(table.join(known.select("entity_id"), "entity_id", "left_anti"))
    rows = rows.withColumns(
        {
            "relevance": F.coalesce("relevance", F.lit(DEFAULT_LINK_RELEVANCE)),
            "context": F.coalesce("context", F.lit("")),
        }
    )
    return table, upsert_links(links, rows, order)


#: Columns that ``newest_links`` adds to a link for ``first_spellings``.
SPELLING = ("entity_type", "name", "description", "ordinal")


def link_mentions(mentions: DataFrame) -> DataFrame:
    """What a link and the entity it leads to need of each mention; links without relevance or context get the defaults."""
    rows = with_entity_id(normalize_entities(mentions))
    return rows.select(*LINK, *SPELLING, F.coalesce("relevance", F.lit(DEFAULT_LINK_RELEVANCE)).alias("relevance"),
                       F.coalesce("context", F.lit("")).alias("context"))


def newest_links(rows: DataFrame, dealt: list[str]) -> DataFrame:
    """One row a link: the last mention's relevance and context, the first one's description and ordinal.

    Rows are grouped by type and name, so that the id, which is longer than both, need not move with them.
    """
    by = [*dealt, "content_id", "content_type", *ENTITY]
    latest = F.max_by(F.struct("relevance", "context"), "ordinal").alias("_latest")
    first = F.min_by(F.struct("description", "ordinal"), "ordinal").alias("_first")
    return with_entity_id(rows.groupBy(*by).agg(latest, first)).select(*dealt, *LINK, *ENTITY, "_latest.*", "_first.*")


def first_spellings(links: DataFrame) -> DataFrame:
    """The entity table of links that have the columns ``SPELLING``; the first mention's description counts."""
    first = F.min_by("description", F.struct("content_id", "ordinal")).alias("description")
    return with_entity_id(links.groupBy(*ENTITY).agg(first)).select("entity_id", *ENTITY, "description")


def with_source(mentions: DataFrame, source: str) -> DataFrame:
    """Origin of the mentions (an audio track, a frame) before lists are merged."""
    return mentions.withColumn("source", F.lit(source))


# The origin of a frame's mentions, and how its place is named.
FRAME_SOURCE, FRAME_NAME = "video_frame", "Frame "


def with_frame(mentions: DataFrame, index: Column) -> DataFrame:
    """Mentions of a frame with their origin and the frame's name; ``index`` counts from 0, names from 1."""
    named = F.concat(F.lit(FRAME_NAME), (index + 1).cast("string"))
    return with_source(mentions, FRAME_SOURCE).withColumn("timestamp", named)


def tag_mentions(mentions: Column, source: str) -> Column:
    """The same on nested mentions."""
    return F.transform(mentions, lambda m: m.withField("source", F.lit(source)))


def resolve_alias(df: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Add ``entity_id`` of the best alias equal to the name, the own key where there is none."""
    best = aliases.groupBy("alias").agg(
        F.max_by("entity_id", F.struct("confidence", "entity_id")).alias("_aliased")
    )
    joined = df.join(best, F.col(name) == F.col("alias"), "left")
    own = entity_key(F.col("entity_type"), F.col(name))
    return joined.withColumn("entity_id", F.coalesce("_aliased", own)).drop("alias", "_aliased")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
