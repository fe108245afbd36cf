"""The corpus pipeline: documents to packed sequences, in stages that each call one operator.

Every stage works on all that the one before it kept, written as Parquet and read again. Null and
empty texts pass the filters; tables without rows pass through. All but the last stage return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import decontamination, packing, simhash, suffix_dedup, toxicity
from shelfmark.llm.common import discard, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that score as toxic go. Learned from the labelled rows among docs."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return simhash.survivors(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: passages that a document with a smaller id holds are cut out of the text."""
    out = suffix_dedup.deduplicate(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("leaks", drop_leaks),
    ("packing", pack),
]

#: No stage but a plain filter can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = table(spark, sf_dir, "documents"), True
    for name, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if not first:
            discard(docs)
        docs, first = kept, False
    return STAGES[-1][1](spark, docs, sf_dir)
