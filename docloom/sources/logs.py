"""Log and profile sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.schemas import LOG_RECORD

PROFILE_LINE = "operation string, duration_ms long, epoch long, mem_diff long, cpu double"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log records."""
    return spark.read.schema(LOG_RECORD).json(path)


def parse_log(line: Column) -> Column:
    return F.from_json(line, LOG_RECORD)


def split_operation(df: DataFrame) -> DataFrame:
    """Separate ``op:info`` into the operation and its info."""
    parts = F.split("operation", ":", 2)
    return df.withColumn("info", F.get(parts, F.lit(1))).withColumn("operation", F.get(parts, F.lit(0)))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile records of CSV files without a header."""
    return split_operation(spark.read.schema(PROFILE_LINE).csv(path))
