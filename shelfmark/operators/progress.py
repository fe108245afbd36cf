"""Totals and progress of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from shelfmark.functions.scalars import progress_percent, used_percent

#: Rows of one sorted block, the most blocks, and how many of their marks are looked at together.
BLOCK_ROWS, BLOCKS, MARKS = 1_000_000, 4096, 64


def scan_totals(items: DataFrame) -> DataFrame:
    """One row: file_count, file_size."""
    return items.where("kind = 'File'").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("file_size"))


def ordered_blocks(rows: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> Column | None:
    """The number of the block of rows that each row's order value lies in; blocks ascend with it. None if one is enough.

    They are cut at approximate quantiles, so that a group with a third of all rows is sorted by many tasks.
    Orders that have no quantiles (texts) make one block.
    """
    kind = rows.schema[order].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return None
    n = min(BLOCKS, -(-rows.agg(F.count(order)).first()[0] // block_rows))
    if n < 2:
        return None
    marks = sorted(set(rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n)).first()[0]))
    array = lambda found: F.array(*(F.lit(m).cast(kind) for m in found))
    below = lambda found: F.size(F.filter(found, lambda m: m < F.col(order)))
    lots = [marks[i : i + MARKS] for i in range(0, len(marks), MARKS)]
    lot = below(array([x[-1] for x in lots[:-1]]))
    return F.when(F.col(order).isNull(), 0).otherwise(lot * MARKS + below(F.get(F.array(*map(array, lots)), lot)))


def running(files: DataFrame, order: str, group: str, by_size: bool = False, size: str = "length", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds running_count, running_size and percent in order within each group (a scan). The percent is of sizes, or of counts.

    Each block of a group is summed up by itself; what stands before it comes from the sums of blocks, of
    which there are at most BLOCKS for each group. Rows without an order value come first.
    """
    block = ordered_blocks(files, order, block_rows)
    if block is None:
        upto, whole = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(group)
        out = files.withColumn("running_count", F.count("*").over(upto)).withColumn("running_size", F.sum(size).over(upto))
        total = F.sum(size).over(whole) if by_size else F.count("*").over(whole)
        return out.withColumn("percent", progress_percent(F.col("running_size" if by_size else "running_count"), total))
    rows = files.withColumn("_block", block)
    sums = rows.groupBy(F.col(group).alias("_group"), F.col("_block").alias("_number")).agg(F.count("*").alias("_n"), F.sum(size).alias("_s"))
    before = Window.partitionBy("_group").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.select("_group", "_number", earlier("_n").alias("_n"), earlier("_s").alias("_s"), F.sum("_n").over(whole).alias("_all_n"), F.sum("_s").over(whole).alias("_all_s"))
    upto = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("running_count", F.count("*").over(upto)).withColumn("running_size", F.sum(size).over(upto))
    out = out.join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_number")))
    out = out.withColumn("running_count", F.col("running_count") + F.col("_n")).withColumn("running_size", F.col("running_size") + F.col("_s"))
    percent = progress_percent(F.col("running_size"), F.col("_all_s")) if by_size else progress_percent(F.col("running_count"), F.col("_all_n"))
    return out.select(*files.columns, "running_count", "running_size", percent.alias("percent"))


def capacity(sizes: DataFrame, used: str, maximum: str) -> DataFrame:
    """Adds free_size and used_percent."""
    return sizes.withColumn("free_size", F.col(maximum) - F.col(used)).withColumn("used_percent", used_percent(F.col(used), F.col(maximum)))
