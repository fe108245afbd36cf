"""Tables that are written in between: a plan that grows by steps is cut, and what a step made isn't made again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a local session without it takes a folder below its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with the place (from 0, without gaps) of each in an order; equal ones in either order.

    Sorted ranges are written with their numbers; what stands before a range comes from the ranges' counts,
    of which there are as many as partitions. No task sorts more than a range.
    """
    ranges = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts, before, total = sorted(ranges.groupBy("_range").agg(F.count("*").alias("n")).collect()), [], 0
    for r in counts:
        before.append((r["_range"], total))
        total += r["n"]
    starts = rows.sparkSession.createDataFrame(before, "_of int, _before long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = ranges.withColumn("_inside", inside).join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    return placed.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))
