"""Tables written once where several branches of a query read the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Used only where the session names no shared folder and runs on one machine (tests).
LOCAL_FOLDER = "file:///tmp/checkpoints/loomline"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; unset: a local one in local mode, else under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return LOCAL_FOLDER if spark.sparkContext.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loomline"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, computed once however often it is read; the copy survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with place, 1 for the first row by order, and so on.

    Rows are dealt by ranges, sorted and written once, as ranges may differ if they are computed again;
    a count of each part then gives its offset, so no window holds all rows. With ties left by order, places among equals are arbitrary.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), name)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    offsets = sizes.select("part", (before - F.col("first") + 1).alias("shift"))
    return rows.join(F.broadcast(offsets), "part").withColumn("place", F.col("nth") + F.col("shift")).drop("part", "nth", "shift")
