"""Table sources, guarded SQL and snapshot sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size; no row is read for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on an input that fewer tasks than cores would read.

    The planner's estimate of the input decides, so no file is listed for it; the rows are the same either way.  An input of more
    than one scan task a core stays where it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    task = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores * 2) if estimated_bytes(df) < cores * task else df


def run_select(spark: SparkSession, sql: str, args: dict | list | None = None) -> DataFrame:
    """A parameterised SELECT; any other statement is refused."""
    if not sql.lstrip().lower().startswith("select"):
        raise ValueError("only SELECT statements are allowed")
    return spark.sql(sql, args=args)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a table as a new snapshot; the target must not exist.

    Each task writes its own rows, sorted by kind: a dominant kind spreads over all tasks, and tasks follow the size of the input.
    """
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
