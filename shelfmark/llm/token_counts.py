"""Operator 5: token counts by a map-side two-tier lookup.

The model's pieces never hold a word-boundary mark behind another character, so a text's tokens are
those of its pre-tokens: a run of blanks with the word behind it. Tier one is a broadcast hash table
from the most frequent pre-tokens to their token numbers; tier two is a cache in each Python worker,
filled by the library for what tier one misses. No pre-token is shuffled; only the heavy hitters of
each partition are, to build tier one.

Null text counts as empty: 0 bytes, 0 tokens. A null doc_id is kept. Repeated rows give repeated rows.
Of equally frequent pre-tokens the lesser one enters tier one, which no count depends on. A very long text
is cut into its pre-tokens whole; one of over 256 characters isn't kept in the cache. Tables without rows
give none; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.common import table

MODEL = "piece_bpe_32k.model"
#: Entries of the broadcast table: its proven bound (pre-tokens of at most TOP_BYTES bytes).
TOP, TOP_BYTES = 32_768, 64
#: Candidates that a partition sends to the count of frequent pre-tokens.
TOP_OF_PARTITION = 8_192
#: Entries of a worker's cache before it starts again from tier one.
CACHE = 400_000
LIMIT = 4096
_UNIT = re.compile(" +[^ ]*")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens, each without the one blank that the library itself puts before a text; "" is a last blank alone."""
    if "▁" in text:  # the library's own mark for a blank
        text = text.replace("▁", " ")
    words = text.split(" ")
    if "" in words:
        return [u[1:] for u in _UNIT.findall(" " + text)] if text else []
    return words


class Lengths(dict):
    """Token numbers by pre-token. What is missing is encoded; a full cache starts again from the frequent ones."""

    def __init__(self, path: str, frequent: dict[str, int], limit: int = CACHE):
        import sentencepiece

        super().__init__(frequent)
        self.encode, self.frequent, self.limit = sentencepiece.SentencePieceProcessor(model_file=path).encode, frequent, limit
        self[""] = 1  # a last blank alone

    def __missing__(self, unit: str) -> int:
        n = len(self.encode(unit, num_threads=1))
        if len(self) >= self.limit + len(self.frequent):
            self.clear()
            self.update(self.frequent)
            self[""] = 1
        if len(unit) <= 256:
            self[unit] = n
        return n

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text)))


def frequent_pre_tokens(docs: DataFrame, text: str = "text", top: int = TOP) -> list[str]:
    """The most frequent pre-tokens of all texts, from each partition's own heavy hitters.

    They decide only where a length is looked up, never what it is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                if (s := t.as_py()) is not None:
                    seen.update(pre_tokens(s))
                    if len(seen) > 300_000:
                        seen = Counter(dict(seen.most_common(100_000)))
        found = [(w, n) for w, n in seen.most_common(TOP_OF_PARTITION) if len(w.encode()) <= TOP_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["unit", "n"])

    hits = docs.select(text).mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return [r.unit for r in hits.orderBy(F.desc("n"), "unit").limit(top).collect()]


_WORKER: dict[str, Lengths] = {}


def lengths_for(path: str, frequent: dict[str, int]) -> Lengths:
    """This worker's own, which stay from task to task; tier one may change between runs, what is cached stays right."""
    if path not in _WORKER:
        _WORKER[path] = Lengths(path, frequent)
    return _WORKER[path]


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    path, spark = model or model_path(), docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = Lengths(path, {})
    tier = {w: first[w] for w in frequent_pre_tokens(docs)}
    shared = spark.sparkContext.broadcast(tier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = lengths_for(path, shared.value)
        for batch in batches:
            sizes, counts = [], []
            for t in batch.column(1):
                s = t.as_py() or ""
                sizes.append(len(s) if s.isascii() else len(s.encode()))
                counts.append(lengths.of(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
