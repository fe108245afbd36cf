"""What the operators of this subpackage share: tables, staging in the shared folder, gapless ranks."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: White space of the word contracts: the blank and code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that one sorted block of a gapless rank holds on average.
BLOCK_ROWS = 200_000
#: Bytes of a batch that Spark hands to Python: long texts come in batches of fewer rows.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; in its session, long texts are handed to Python in batches of fewer rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) takes one below the warehouse; a cluster is refused,
    as a folder of one machine would be lost to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


#: Where staged tables lie.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Empties staged tables that nothing will read any more."""
    for df in tables:
        df.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(_PATHS.pop(df))


def first_of(rows: DataFrame, order: list[str], size: str, most: int) -> DataFrame:
    """The first rows in order (one at least) whose sizes add up to at most so much. Order and sizes of all rows come to the driver: only for samples of bounded number."""
    total, last = 0, None
    for r in rows.select(*order, size).orderBy(*order).collect():
        total += r[size]
        if last is not None and total > most:
            return rows.where(F.struct(*order) <= F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, last, strict=True))))
        last = [r[c] for c in order]
    return rows


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text leaves 2 modulo 4. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def blocks(n_rows: int) -> int:
    return max(4, -(-n_rows // BLOCK_ROWS))


def gapless(df: DataFrame, key: str, order: list[str], name: str, n_rows: int) -> DataFrame:
    """Adds the rank (from 0, without gaps) of each row among those of its key.

    Rows are dealt to blocks by a hash of the order columns, so a key with a third of all rows
    is ranked by many tasks; a block's offset comes from the counts of blocks, of which there are
    (number of keys) x blocks(n_rows).
    """
    block, start = f"_{name}_block", f"_{name}_start"
    rows = df.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks(n_rows))).cast("int"))
    counts = rows.groupBy(key, block).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_k"), F.col(block).alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(start))
    inside = F.row_number().over(Window.partitionBy(key, block).orderBy(*order)) - 1
    ranked = rows.withColumn("_r", inside)
    return (
        ranked.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col(block) == F.col("_b")))
        .withColumn(name, (F.col(start) + F.col("_r")).cast("long"))
        .drop("_k", "_b", "_r", start, block)
    )
