"""Continuous ingest and upserts by micro-batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.consolidate import LINK, SPELLING, first_spellings, link_mentions, newest_links
from docloom.operators.extraction import extract
from docloom.operators.rules import PROSE_RULES, Rule
from docloom.operators.search import exploded_postings, joined_postings, row_postings
from docloom.streaming.tiers import TieredTable


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
                 files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """New files of a folder as rows of path, length and text."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(schema)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
    )
    return files.select("path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


class EntitySink:
    """Entities, links and postings over micro-batches, as tables that are merged by size (``TieredTable``).

    A batch reads and writes only its own rows; it need not know which entities are known, as of an entity's rows the first
    counts when runs are merged or read.  Of a link the newest row counts.  Postings are one row a document, counted before they
    move, so the newest version replaces all of an older one, even where it has no token.  A batch's mentions and postings are
    shuffled once each, on the way to their run, and its entities come from its stored links.  Repeating a batch or restarting between its tables changes no result.
    ``input`` rows carry content_id, content_type and the text.
    """

    def __init__(self, folder: str, text: str = "text", rules: tuple[Rule, ...] = PROSE_RULES, buckets: int = 8):
        self.text, self.rules = text, rules
        self.tables = {
            "entities": TieredTable(f"{folder}/entities", ("entity_id",), "first", buckets),
            "links": TieredTable(f"{folder}/links", tuple(LINK), "last", buckets),
            "postings": TieredTable(f"{folder}/postings", ("content_id",), "last", buckets),
        }

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        mentions = extract(batch, ["content_id", "content_type"], self.text, self.rules, one_pass=True)
        self.tables["links"].write(
            link_mentions(mentions), batch_id, newest_links, SPELLING,
            then=lambda links: self.tables["entities"].write(first_spellings(links), batch_id))
        postings = row_postings(batch, "content_id", [self.text])
        self.tables["postings"].write(postings, batch_id, lambda rows, dealt: joined_postings(rows, [*dealt, "content_id"]))

    def entities(self, spark: SparkSession) -> DataFrame:
        return self.tables["entities"].read(spark)

    def links(self, spark: SparkSession) -> DataFrame:
        """The newest link per key."""
        return self.tables["links"].read(spark)

    def postings(self, spark: SparkSession) -> DataFrame:
        """Postings of the newest version of every document; a version without tokens has none."""
        return exploded_postings(self.tables["postings"].read(spark), "content_id")


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there through a batch function and stop."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


class LatestRows(TieredTable):
    """Keyed rows of an updating stream; readers take the newest row per key."""


@dataclass
class AppendedRows:
    """Rows of a stream that only adds: each batch is a folder, and a repeated batch replaces its own."""

    folder: str

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch_id={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.folder).drop("batch_id")
