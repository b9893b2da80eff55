"""Keyed tables in buckets, whose upserts shuffle the new rows only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class BucketedTable:
    """A table of one row a key, as snapshots that are bucketed and sorted by the key.

    An upsert joins the snapshot with the new rows bucket by bucket: the snapshot is read where it lies, as its buckets are
    the join's partitions already, and only the new rows are shuffled.  Each write is a new snapshot folder; ``current`` says which one
    counts, so a job that fails leaves the table as it was.
    """

    folder: str
    keys: tuple[str, ...]
    buckets: int = 16
    current: str | None = None

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The snapshot, or none before the first write."""
        return spark.table(self.current) if self.current else None

    def write(self, df: DataFrame, dealt: bool = False) -> BucketedTable:
        """A new snapshot, and the table that points to it.

        ``dealt`` says that ``df`` comes out of a method of a table with these buckets, so its rows lie in their tasks already.
        """
        name = f"docloom_{uuid.uuid4().hex}"
        rows = df if dealt else df.repartition(self.buckets, *self.keys)
        writer = rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.folder}/{name}")
        writer.saveAsTable(name)
        return BucketedTable(self.folder, self.keys, self.buckets, name)

    def attach(self, spark: SparkSession, name: str) -> BucketedTable:
        """The table of an earlier snapshot by its folder's name, for a session whose catalog doesn't know it."""
        schema = spark.read.parquet(f"{self.folder}/{name}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'"
        )
        return BucketedTable(self.folder, self.keys, self.buckets, name)

    def _joined(self, new: DataFrame, how: str) -> tuple[DataFrame, dict[str, str]]:
        """The snapshot beside the new rows, whose columns get names of their own; both sides are named by the keys."""
        names = {c: f"_new_{c}" for c in new.columns if c not in self.keys}
        added = new.withColumnsRenamed(names).withColumn("_fresh", F.lit(True))
        old = self.read(new.sparkSession).withColumn("_known", F.lit(True))
        return old.hint("merge").join(added, list(self.keys), how), names

    def upsert(self, new: DataFrame, change: dict[str, Column] | None = None) -> DataFrame:
        """All rows after ``new``, at most one a key, is added; ``change`` says what becomes of columns of known keys.

        ``change`` may name a column of the new row as ``_new_…``; without it the new row takes the old one's place.  A column it
        doesn't name keeps its value where the key was known.
        """
        if self.current is None:
            return new
        joined, names = self._joined(new, "full")
        both = F.col("_known").isNotNull() & F.col("_fresh").isNotNull()
        out = []
        for c in self.read(new.sparkSession).columns:
            if c in self.keys:
                out.append(F.col(c))
                continue
            fresh = F.col(names[c]) if c in names else F.lit(None)
            merged = (change[c] if c in change else F.col(c)) if change is not None else fresh
            out.append(F.when(both, merged).when(F.col("_known").isNotNull(), F.col(c)).otherwise(fresh).alias(c))
        return joined.select(*out)

    def insert(self, new: DataFrame) -> DataFrame:
        """All rows after those of ``new`` whose key is not known are added; known rows stay as they are."""
        return self.upsert(new, {})

    def delete(self, gone: DataFrame) -> DataFrame:
        """All rows but those whose key is in ``gone``."""
        return self.read(gone.sparkSession).hint("merge").join(gone.select(*self.keys).distinct(), list(self.keys), "left_anti")
