"""Scans as streams: running totals and the arrival of new media."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def running_totals(files: DataFrame, group: str, size: str = "length") -> DataFrame:
    """Running count and size per group of a stream of files (complete mode)."""
    return files.groupBy(group).agg(F.count("*").alias("file_count"), F.sum(size).alias("file_size"))


def windowed_totals(files: DataFrame, time: str, width: str, late: str, group: str, size: str = "length") -> DataFrame:
    """Counts and sizes per time window and group; rows that are later than the watermark are dropped, so the state stays bounded."""
    return files.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("file_count"), F.sum(size).alias("file_size"))


def arrivals(spark: SparkSession, folder: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each lot of new scan files in a drop folder to handle, once each; a stopped stream goes on where it was."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ScanListener(StreamingQueryListener):
    """Calls back when a scan has moved on or has ended."""

    def __init__(self, progress: Callable[[int], None], ended: Callable[[str | None], None]):
        self.progress, self.ended = progress, ended

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.progress(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended(event.exception)
