"""File sources: directory scans, admission, whole-file text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import basename
from docloom.options import MAX_FILE_SIZE


def scan_files(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """Files below a folder: path, modificationTime, length, content.

    The content is read only where a query asks for it.  Empty files are not listed by the source.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def scan_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The named files."""
    return spark.read.format("binaryFile").load(paths)


def extension_suffixes(extensions: str) -> list[str]:
    """Suffixes of a comma list; ``*x`` and ``x`` both mean the suffix x."""
    parts = [part.strip() for part in extensions.split(",")]
    return [part.replace("*", "", 1) if part.startswith("*") else part for part in parts if part]


def filter_extensions(df: DataFrame, extensions: str, path: str = "path") -> DataFrame:
    """Files whose name ends with one of the suffixes; an empty list keeps all."""
    suffixes = extension_suffixes(extensions)
    if not suffixes:
        return df
    hit = F.lit(False)
    for suffix in suffixes:
        hit = hit | basename(F.col(path)).endswith(suffix)
    return df.filter(hit)


def filter_max_size(df: DataFrame, limit: int = MAX_FILE_SIZE, size: str = "length") -> DataFrame:
    return df.filter(F.col(size) <= limit)


def filter_files(df: DataFrame, predicate: Column) -> DataFrame:
    """A filter of the user's own."""
    return df.filter(predicate)


def cap_files(df: DataFrame, count: int, path: str = "path") -> DataFrame:
    """The first files by path; 0 means no cap."""
    return df.orderBy(path).limit(count) if count else df


def text_of(content: Column) -> Column:
    """Text of file bytes, empty where there is none; broken UTF-8 is replaced, not fatal."""
    return F.coalesce(F.make_valid_utf8(content.cast("string")), F.lit(""))


def read_text(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Path and whole text of every file."""
    files = scan_files(spark, path, recursive)
    return files.select("path", "length", text_of(F.col("content")).alias("text"))


def from_items(df: DataFrame) -> DataFrame:
    """Inline items: a missing id is generated, a missing priority is 0."""
    columns = set(df.columns)
    item_id = F.col("id") if "id" in columns else F.lit(None).cast("string")
    priority = F.col("priority") if "priority" in columns else F.lit(None).cast("int")
    return df.select(
        F.coalesce(item_id, F.uuid()).alias("item_id"), "content", "content_type",
        F.coalesce(priority, F.lit(0)).alias("priority"),
    )
