"""Search on stored indexes: a query reads the files of its own tokens, not the index.

Both indexes are folders of buckets, with rows sorted within and cut into ranges or slices, so that a frequent token spans several files.
The bucket is a partition column that the optimizer prunes by, as a constant of the query; within a bucket, row groups are skipped
by the least and greatest token.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import contains_folded
from docloom.operators.search import build_index, query_terms, search_index
from docloom.sources.tables import estimated_bytes

#: Characters of a token that name its bucket, and of one gram.
PREFIX, GRAM = 2, 3

#: Slices of a bucket at least, so that a large bucket is no task of its own, and estimated bytes of a table for each further one.
SLICES, SLICE_BYTES = 4, 256 << 20


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _store(rows: DataFrame, path: str, order: list[str], parts: int | None) -> None:
    """Rows by bucket, sorted, dealt to ``parts`` ranges, or else to slices of each bucket by the key (the last of ``order``).

    Ranges need a look at all rows ahead of the shuffle, which would make them twice; slices don't, and their number follows the
    planner's estimate of the rows' size.
    """
    if parts:
        dealt = rows.repartitionByRange(parts, "bucket", *order)
    else:
        slices = SLICES + estimated_bytes(rows) // SLICE_BYTES
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64(order[-1]), F.lit(slices)))
    dealt.sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class TokenIndex:
    """Postings (token, key, tf) by a bucket of the token's first characters, so that prefixes have a bucket too."""

    folder: str
    key: str
    buckets: int = 64

    def write(self, postings: DataFrame, parts: int | None = None) -> None:
        rows = postings.withColumn("bucket", _bucket(F.left("token", F.lit(PREFIX)), self.buckets))
        _store(rows, self.folder, ["token", self.key], parts)

    def build(self, df: DataFrame, columns: list[str], parts: int | None = None) -> None:
        self.write(build_index(df, self.key, columns), parts)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.folder).drop("bucket")

    def search(self, spark: SparkSession, query: str) -> DataFrame:
        """Keys that have every term, the last one as a prefix, with the hits summed.

        A last term of one character has tokens in any bucket; there only row groups are skipped.
        """
        terms = query_terms(query)
        rows = spark.read.parquet(self.folder)
        if terms and len(terms[-1]) >= PREFIX:
            held = [_bucket(F.left(F.lit(t), F.lit(PREFIX)), self.buckets) for t in dict.fromkeys(terms)]
            rows = rows.filter(F.col("bucket").isin(*held))
        return search_index(rows.drop("bucket"), query, self.key)


def grams(c: Column) -> Column:
    """Distinct runs of three characters, lower case; linear in the text.  None begins with the second half of a character."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"), F.lit(1)))


@dataclass(frozen=True)
class SubstringIndex:
    """Rows by a bucket of their key, and for each gram of three characters the rows and columns that have it.

    A substring has all its grams in one column.  Rows that have them are candidates; only the buckets of candidates are
    read, and the text decides.  A substring of fewer than three characters has no gram, so all rows are read for it.
    """

    folder: str
    key: str
    columns: tuple[str, ...]
    buckets: int = 64

    def build(self, df: DataFrame, parts: int | None = None) -> None:
        rows = df.withColumn("bucket", _bucket(F.col(self.key), self.buckets))
        _store(rows, f"{self.folder}/rows", [self.key], parts)
        found = [df.select(F.explode(grams(F.col(c))).alias("gram"), F.lit(at).alias("at"), self.key) for at, c in enumerate(self.columns)]
        postings = reduce(DataFrame.unionAll, found).withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        _store(postings, f"{self.folder}/grams", ["gram", self.key], parts)

    def candidates(self, spark: SparkSession, query: str) -> DataFrame | None:
        """(key) of the rows with all grams of the query in one column; none where the query has no gram."""
        text = query.lower()
        asked = sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})
        if not asked:
            return None
        held = [_bucket(F.lit(g), self.buckets) for g in asked]
        rows = spark.read.parquet(f"{self.folder}/grams").filter(F.col("bucket").isin(*held) & F.col("gram").isin(*asked))
        return rows.groupBy(self.key, "at").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(asked)).select(self.key).distinct()

    def search(self, spark: SparkSession, query: str) -> DataFrame:
        """Rows with the query as a substring of any of the columns, case ignored."""
        rows, found = spark.read.parquet(f"{self.folder}/rows"), self.candidates(spark, query)
        if found is not None:
            held = [r.b for r in found.select(_bucket(F.col(self.key), self.buckets).alias("b")).distinct().collect()]  # ``buckets`` numbers at most
            rows = rows.filter(F.col("bucket").isin(held)).join(found, self.key, "left_semi")
        hit = F.lit(False)
        for name in self.columns:
            hit = hit | F.coalesce(contains_folded(F.col(name), query), F.lit(False))
        return rows.filter(hit).drop("bucket")
