"""Lineage cuts that every executor can read, free column names and bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import shared_folder, written

__all__ = ["free_name", "materialize", "shared_folder", "small_batches"]
ARROW_ROWS, ARROW_BYTES = "1024", str(16 << 20)
#: Parquet in the folder that spark.checkpoint.dir names; an empty table keeps its columns.
materialize = written


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of long texts holds, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
