"""Keyed tables that grow by micro-batch and stay few files."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.tables import estimated_bytes

_MANIFEST = "runs array<struct<name: string, level: int>>, shape string, batch_id long"
_BATCH, _BUCKET, _SLICE = "_batch", "_bucket", "_slice"

#: Slices of a bucket at least, so that a large bucket is no task of its own; estimated bytes for each further one; and the most.
SLICES, SLICE_BYTES, MOST_SLICES = 4, 64 << 20, 4096

#: Makes one row a key of dealt rows: groups by the given columns and the key's, and returns all of these with the values.
Reduce = Callable[[DataFrame, list[str]], DataFrame]


@dataclass
class TieredTable:
    """Rows per key over many batches: a batch adds a run, and ``fan`` runs of one size become one of the next.

    A run is a folder of ``buckets`` parts, by a hash of the key.  Rows are dealt once, by bucket and slice of the key, and made one
    a key where they then are; so a run needs one shuffle, and a single run is read as it is.  Each batch writes its own rows only and reads none of the
    earlier ones; a row is merged again once a level, so ``n`` batches cost ``n log n`` and leave at most ``fan - 1`` runs a level.
    Which runs count is written last, as the batch's manifest.  A batch that is repeated starts from the manifest before it,
    and what that one names is kept until the next batch is through; so a restart at any point changes no result.  Of the
    rows of one key the one of the last batch counts, or that of the first with ``keep="first"``.
    """

    folder: str
    keys: tuple[str, ...]
    keep: str = "last"
    buckets: int = 8
    fan: int = 4

    def _runs(self, spark: SparkSession, before: int | None = None) -> tuple[list[tuple[str, int]], str | None]:
        """Names and levels of the runs that count, and the schema of their rows."""
        try:
            listed = spark.read.schema(_MANIFEST).json(f"{self.folder}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return [], None
        if before is not None:
            listed = listed.filter(F.col("batch_id") < before)
        newest = listed.orderBy(F.desc("batch_id")).head(1)
        return ([(r["name"], r["level"]) for r in newest[0]["runs"]], newest[0]["shape"]) if newest else ([], None)

    def _load(self, spark: SparkSession, runs: list[tuple[str, int]], shape: str) -> DataFrame:
        """Rows of the runs as they are; the buckets are a column that filters can prune by.  A run of no rows has no file."""
        schema = T.StructType.fromJson(json.loads(shape))
        parts = [spark.read.schema(schema).parquet(f"{self.folder}/{name}") for name, _ in runs]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _store(self, rows: DataFrame, name: str, reduce: Reduce | None = None) -> DataFrame:
        """Write a run; returns what was written, as a table that has not been read yet.

        Adaptive execution joins the slices of small runs, so these have one file a bucket.
        """
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        slices = min(SLICES + estimated_bytes(rows) // SLICE_BYTES, MOST_SLICES)
        dealt = rows.withColumns({_BUCKET: bucket, _SLICE: F.pmod(F.hash(*self.keys), F.lit(slices))}).repartition(_BUCKET, _SLICE)
        run = (reduce or self._reduced)(dealt, [_BUCKET, _SLICE]).drop(_SLICE)
        path = f"{self.folder}/{name}"
        run.write.mode("overwrite").option("compression", "zstd").partitionBy(_BUCKET).parquet(path)
        return rows.sparkSession.read.schema(run.schema).parquet(path)

    def _reduced(self, rows: DataFrame, dealt: list[str] | None = None) -> DataFrame:
        pick = F.max_by if self.keep == "last" else F.min_by
        values = [c for c in rows.columns if c not in (*self.keys, _BATCH, _BUCKET, _SLICE)]
        row = pick(F.struct(_BATCH, *values), _BATCH).alias("_row")
        by = [*(dealt or []), *self.keys]
        return rows.groupBy(*by).agg(row).select(*by, "_row.*")

    def write(self, batch: DataFrame, batch_id: int, reduce: Reduce | None = None, beside: tuple[str, ...] = (),
              then: Callable[[DataFrame], None] | None = None) -> None:
        """Add the rows of a batch and merge what has become too many.

        ``reduce`` makes one row a key of the batch's rows, else any of a key's rows counts.  ``then`` gets the batch's own rows as
        they were stored, with the columns ``beside``, which readers and merges don't take along.
        """
        spark = batch.sparkSession
        earlier, shape = self._runs(spark, batch_id)
        runs, level, name = list(earlier), 0, f"run-{batch_id}-0"
        number = F.lit(batch_id).cast("long")
        if reduce:
            own = self._store(batch, name, lambda rows, dealt: reduce(rows, dealt).withColumn(_BATCH, number))
        else:
            own = self._store(batch.withColumn(_BATCH, number), name)
        kept = [f for f in own.schema.fields if f.name not in (_BUCKET, *beside)]
        shape = shape or T.StructType([*kept, T.StructField(_BUCKET, T.IntegerType())]).json()
        if then:
            then(own.drop(_BUCKET, _BATCH))
        runs.append((name, 0))
        while len(full := [r for r in runs if r[1] == level]) >= self.fan:
            level, name = level + 1, f"run-{batch_id}-{level + 1}"
            self._store(self._load(spark, full, shape), name)
            runs = [r for r in runs if r not in full] + [(name, level)]
        row = ([{"name": n, "level": k} for n, k in runs], shape)
        manifest = spark.createDataFrame([row], "runs array<struct<name: string, level: int>>, shape string")
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/batch_id={batch_id}")
        self._clean(spark, {n for n, _ in (*earlier, *runs)}, batch_id)

    __call__ = write

    def _clean(self, spark: SparkSession, named: set[str], batch_id: int) -> None:
        """Remove runs and manifests that neither this batch nor the one before it names."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for entry in system.listStatus(path(self.folder)):
            if entry.getPath().getName().startswith("run-") and entry.getPath().getName() not in named:
                system.delete(entry.getPath(), True)
        manifests = {int(e.getPath().getName().split("=")[1]): e.getPath() for e in system.listStatus(path(f"{self.folder}/manifest")) if "=" in e.getPath().getName()}
        for number in sorted(n for n in manifests if n < batch_id)[:-1]:
            system.delete(manifests[number], True)

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """One row a key; none before the first batch."""
        runs, shape = self._runs(spark, before)
        if not runs:
            return None
        rows = self._load(spark, runs, shape)
        if len(runs) > 1:
            return self._reduced(rows).drop(_BATCH)
        return rows.select(*self.keys, *[c for c in rows.columns if c not in (*self.keys, _BATCH, _BUCKET)])

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame | None:
        """The rows of the keys in ``wanted``, from the buckets that hold them."""
        runs, shape = self._runs(wanted.sparkSession, before)
        if not runs:
            return None
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("b")
        held = [r.b for r in wanted.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        rows = self._load(wanted.sparkSession, runs, shape).filter(F.col(_BUCKET).isin(held))
        return self._reduced(rows.join(wanted.select(*self.keys).distinct(), list(self.keys), "left_semi")).drop(_BATCH)
