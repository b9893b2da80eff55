"""Tables written to the shared folder, so that no step is computed twice and a lost executor costs nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the one that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/docloom-{label}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """A name like the given one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def shared_table(df: DataFrame, label: str, options: dict[str, object] | None = None) -> DataFrame:
    """Write a table to the shared folder and return the written one, which has no lineage; ``options`` go to the writer."""
    path = shared_path(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` looks at it from within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)
