"""Routing of content: kinds, extractor choice, admission and chunking strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.mime import is_text_type, lookup
from docloom.functions.text import strip
from docloom.operators.extraction import explode_once
from docloom.options import MIN_TEXT_LENGTH, SHELL_CHUNK_SIZE, ChunkOptions
from docloom.schemas import CONTENT_TYPE_ROWS

# MIME types handled as source code by the router.
CODE_MIMES = (
    "text/x-python", "text/x-c", "text/x-java", "application/json", "application/xml",
    "text/x-javascript", "text/x-typescript",
)
# Code types that prefer paragraph chunks.
PARAGRAPH_CODE_MIMES = (
    "text/x-python", "text/x-c", "text/x-java", "text/x-javascript", "text/x-typescript",
)
# Types the size-based admission accepts besides text.
CHUNKABLE_MIMES = ("application/json", "application/xml", "application/pdf", "application/javascript")

# Extractor names per MIME pattern, in the order they are tried.
DEFAULT_EXTRACTORS = {
    "text/plain": "text", "text/markdown": "text", "text/html": "text",
    "application/json": "json", "application/xml": "xml", "application/pdf": "document",
    "text/csv": "text", "text/x-python": "code", "text/javascript": "code", "text/x-c": "code",
    "application/x-sh": "code",
    "image/jpeg": "image", "image/png": "image", "video/mp4": "video",
    "text/*": "text", "image/*": "image", "video/*": "video", "application/*": "fallback",
    "text/x-*": "code",
}


def content_kind(mime: Column) -> Column:
    """The content kind a MIME type is stored as."""
    return (
        F.when(mime.startswith("image/"), "image")
        .when(mime.startswith("video/"), "video")
        .when(mime == "application/pdf", "document")
        .when(mime == "text/plain", "text")
        .when(mime.isin(*CODE_MIMES), "code")
        .otherwise("generic")
    )


def matching_content_types(df: DataFrame, keys: list[str], mime: str = "content_type") -> DataFrame:
    """Every content type whose LIKE pattern fits, one row each.

    The patterns are eight constants, so the theta join is a filter over a constant array in the row.
    """
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern"))
                     for n, _, p in CONTENT_TYPE_ROWS])
    fits = F.filter(rows, lambda r: F.like(F.col(mime), r["pattern"]))
    hits = explode_once(df, dict.fromkeys([*keys, mime]), fits, "_t")
    return hits.select(*dict.fromkeys([*keys, mime]), F.col("_t.name").alias("type_name"))


def resolve(mime: Column, registry: dict[str, str]) -> Column:
    """Registered value for a MIME type: exact, then ``major/*``, then the first fitting prefix."""
    # Bound to a lambda variable, a costly type expression is evaluated once and not per test.
    return F.get(F.transform(F.array(mime), lambda m: _resolved(m, registry)), F.lit(0))


def _resolved(mime: Column, registry: dict[str, str]) -> Column:
    by_prefix = F.lit(None).cast("string")
    for pattern, value in reversed(list(registry.items())):
        if pattern.endswith("*"):
            prefix = pattern.replace("*", "", 1)
            by_prefix = F.when(mime.startswith(prefix), value).otherwise(by_prefix)
    category = F.concat(F.substring_index(mime, "/", 1), F.lit("/*"))
    return F.coalesce(lookup(registry, mime), lookup(registry, category), by_prefix)


def resolve_extractor(df: DataFrame, mime: str = "content_type",
                      registry: dict[str, str] | None = None) -> DataFrame:
    """Add ``extractor``, ``success`` and ``error``; a type without an extractor is a failed row."""
    found = resolve(F.col(mime), DEFAULT_EXTRACTORS if registry is None else registry)
    return df.withColumn("extractor", found).withColumns(
        {
            "success": F.col("extractor").isNotNull(),
            "error": F.when(
                F.col("extractor").isNull(),
                F.concat(F.lit("No entity extractor found for content type: "), F.col(mime)),
            ),
        }
    )


def should_chunk(text: Column, mime: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """Text content longer than the chunk size, in characters."""
    size, _ = options.resolved()
    return is_text_type(mime) & (F.length(text) > size)


def should_chunk_bytes(size: Column, mime: Column, limit: int = SHELL_CHUNK_SIZE,
                       enabled: bool = True) -> Column:
    """Chunkable content larger than the limit, in bytes."""
    fits = mime.startswith("text/") | mime.isin(*CHUNKABLE_MIMES)
    return F.lit(enabled) & (size > limit) & fits


def effective_strategy(mime: Column, strategy: Column, is_code: Column | None = None) -> Column:
    """Chunking strategy after the overrides: other types by size, code by paragraph."""
    chunkable_text = (
        mime.startswith("text/")
        | mime.isin("application/json", "application/xml", "application/pdf")
        | mime.contains("script")
    )
    code = mime.isin(*PARAGRAPH_CODE_MIMES) if is_code is None else is_code
    return (
        F.when(~chunkable_text, "size")
        .when(code & (strategy == "size"), "paragraph")
        .otherwise(strategy)
    )


def reject_short(df: DataFrame, text: str = "text", minimum: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Only texts with enough characters once trimmed."""
    return df.filter(F.length(strip(F.col(text))) >= minimum)
