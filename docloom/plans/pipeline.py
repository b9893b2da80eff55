"""The ingest chain: documents in, typed content, chunks, mentions, entities and links out.

Each stage is a plain function of DataFrames, so the same chain serves tables, files and streams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.mime import detect_content_type, mime_by_text
from docloom.functions.text import md5_hash, token_estimate
from docloom.operators.chunking import chunk_where_needed
from docloom.operators.consolidate import store_entities
from docloom.operators.extraction import extract
from docloom.operators.metadata import extract_metadata
from docloom.operators.routing import content_kind, should_chunk
from docloom.operators.rules import PROSE_RULES, Rule
from docloom.options import ChunkOptions, ExtractOptions
from docloom.sources.tables import spread, write_table

#: The chain keeps every entity; a caller who wants the best few of each chunk passes ``max_entities``.
WHOLE = ExtractOptions(max_entities=None)


def as_content(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """Content rows: type by path and text, kind, hash, size, token estimate and metadata."""
    body = F.col(text)
    mime = detect_content_type(F.col(path), body) if path else mime_by_text(body)
    rows = df.withColumn("content_type", mime).withColumns(
        {
            "content_id": F.col(key).cast("string"),
            "kind": content_kind(F.col("content_type")),
            "hash": md5_hash(body),
            "size": F.octet_length(body).cast("long"),
            "tokens": token_estimate(body),
        }
    )
    where = path or "content_id"
    return extract_metadata(rows, text, "content_type", where)


def as_chunks(content: DataFrame, options: ChunkOptions = ChunkOptions(), text: str = "text") -> DataFrame:
    """Chunks of the texts that are too long, whole texts as single chunks."""
    return chunk_where_needed(
        content, ["content_id", "content_type"],
        should_chunk(F.col(text), F.col("content_type"), options),
        options.strategy, options.max_size, options.overlap, text,
    )


def as_mentions(chunks: DataFrame, rules: tuple[Rule, ...] = PROSE_RULES,
                options: ExtractOptions | None = WHOLE) -> DataFrame:
    return extract(
        chunks, ["content_id", "content_type", "chunk_index"], "chunk_text", rules, None, options, one_pass=True
    )


@dataclass(frozen=True)
class Ingested:
    """The tables of one ingest."""

    content: DataFrame
    chunks: DataFrame
    mentions: DataFrame
    entities: DataFrame
    links: DataFrame


def ingest(df: DataFrame, key: str, text: str = "text", path: str | None = None,
           rules: tuple[Rule, ...] = PROSE_RULES, chunking: ChunkOptions = ChunkOptions(),
           extraction: ExtractOptions | None = WHOLE) -> Ingested:
    """The whole chain as lazy tables; only entities and links need a shuffle."""
    content = as_content(df, key, text, path)
    chunks = as_chunks(content, chunking, text)
    mentions = as_mentions(chunks, rules, extraction)
    entities, links = store_entities(mentions, order=["chunk_index", "ordinal"])
    return Ingested(content, chunks, mentions, entities, links)


def ingest_to(folder: str, df: DataFrame, key: str, text: str = "text", path: str | None = None,
              rules: tuple[Rule, ...] = PROSE_RULES, chunking: ChunkOptions = ChunkOptions(),
              extraction: ExtractOptions | None = WHOLE, searched: bool = True) -> Ingested:
    """The same chain written as a snapshot folder.

    Texts are read and searched once: entities and links are made from the written mentions, which are
    a small part of the text.  The folder must be shared by the cluster and must not exist.  A caller who
    reads content and chunks only passes ``searched=False``: these two are written, the other tables stay lazy.
    """
    spark = df.sparkSession
    lazy = ingest(df, key, text, path, rules, chunking, extraction)

    def written(name: str, table: DataFrame, partition_by: str | None = None) -> DataFrame:
        write_table(table, f"{folder}/{name}", partition_by)
        return spark.read.parquet(f"{folder}/{name}")

    content = written("content", lazy.content, "kind")
    chunks = written("chunks", as_chunks(content, chunking, text))
    mentions = as_mentions(spread(chunks), rules, extraction)
    if not searched:
        return Ingested(content, chunks, mentions, *store_entities(mentions, order=["chunk_index", "ordinal"]))
    mentions = written("mentions", mentions)
    entities, links = store_entities(mentions, order=["chunk_index", "ordinal"])
    return Ingested(content, chunks, mentions, written("entities", entities), written("links", links))
