"""Operator 9: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct words, pairs of neighbours, pairs with one word between them,
and words cut to their first STEM characters, hashed to 2**BITS coordinates. The cut words let forms of
a word that were never learned count for their stem, in languages that inflect or compound. FTRL-proximal with per-coordinate rates learns from a bounded
sample of the labelled rows (MAX_TRAIN documents by a hash of the id, of which the first that have
MAX_FEATURES features in all); its L1 term leaves few weights that aren't zero, and these alone are
broadcast. Every whole text is scored.

Null or empty text has no feature and gets the intercept's score. Rows without a label, with a null
label or a null doc_id are never learned from; a document with several labels counts as toxic if one
says so, and of several texts of one id the one whose features come first in order is learned. Rows with
equal texts have equal scores. Without any label to learn from, every score is below a millionth. A very long
text has at most 2**BITS different features. Tables without rows give none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.common import discard, first_of, held_out, staged, table

BITS = 20
#: Documented bound of the labelled sample.
MAX_TRAIN = 8000
#: Documented bound of the features that the driver receives (4 bytes each).
MAX_FEATURES = 20_000_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 10.0, 1.0
THRESHOLD = 0.3
#: The weights' proven bound: at most 2**BITS pairs of 12 bytes.
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SHIFT = np.uint64(64 - BITS)
#: Words that a worker keeps the hashes of, in each of its two caches.
CACHE = 200_000
#: Characters of a word's stem; words that aren't longer have none of their own.
STEM = 4


class WordHashes(dict):
    """64-bit hashes of words without the marks around them; 0 for marks alone. With a stem's length, of the longer words' stems."""

    def __init__(self, stem: int = 0):
        super().__init__()
        self.stem = stem

    def __missing__(self, word: str) -> int:
        bare = word.strip("\"'`.,;:!?()[]{}<>*_-#$%&|/\\~^+=@¿¡«»“”‘’…")
        if self.stem:
            bare = bare[: self.stem] if len(bare) > self.stem else ""
        h = xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) >> 1 if bare else 0
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def features(text: str | None, hashes: WordHashes, stems: WordHashes) -> np.ndarray:
    """Coordinates of the text's features, repeats included."""
    words = text.lower().split() if text else []
    u = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    u = u[u != 0]
    different = set(words)
    s = np.fromiter(map(stems.__getitem__, different), np.uint64, len(different))
    parts = [u * _K[0], s[s != 0] * _K[1] + _K[0]]
    for gap in (1, 2):
        if len(u) > gap:
            parts.append(((u[:-gap] * _K[1]) ^ (u[gap:] * _K[2])) * _K[3] + _K[gap])
    return (np.concatenate(parts) >> _SHIFT).astype(np.uint32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and intercept. The intercept is a coordinate without L1."""
    n, z = np.zeros(2**BITS), np.zeros(2**BITS)
    bn = bz = 0.0
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = rows[i]
            w, b = weight(z[x], n[x]), -bz / ((beta + bn**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - labels[i]
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - sigma * w
            n[x] += g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * b
            bn += g * g
    return weight(z, n), -bz / ((beta + bn**0.5) / alpha) if len(rows) else -99.0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, l1: float = L1) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates with weights, the weights, the intercept; learned from at most max_train labelled documents that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, stems = WordHashes(), WordHashes(STEM)
        for batch in batches:
            found = [np.unique(features(t.as_py(), hashes, stems)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.binary())], ["id", "y", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    rows = texts.join(F.broadcast(known), F.col("_id") == F.col("id")).select("id", "y", "text").mapInArrow(run, "id long, y int, x binary")
    rows = rows.groupBy(F.xxhash64("id").alias("place"), "id", "y").agg(F.min("x").alias("x")).withColumn("n", F.length("x") / 4)
    sample = staged(rows, "toxic-sample")
    rows = first_of(sample, ["place", "id"], "n", max_features).orderBy("id").collect()
    discard(sample)
    w, b = ftrl([np.frombuffer(r.x, np.uint32) for r in rows], np.array([float(r.y) for r in rows]), l1=l1)
    at = np.flatnonzero(w)
    return at.astype(np.uint32), w[at].astype(np.float64), float(b)


_WORKER: dict = {}


class Scorer:
    """A text's score under sparse weights."""

    def __init__(self, at: bytes, w: bytes, b: float):
        self.dense, self.b = np.zeros(2**BITS), b
        self.dense[np.frombuffer(at, np.uint32)] = np.frombuffer(w, np.float64)
        self.hashes, self.stems = _WORKER.setdefault("hashes", WordHashes()), _WORKER.setdefault("stems", WordHashes(STEM))

    def __call__(self, text: str | None) -> float:
        x = features(text, self.hashes, self.stems)
        x = np.unique(x[self.dense[x] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.dense[x].sum() + self.b, -35, 35))))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    at, w, b = model
    shared = docs.sparkSession.sparkContext.broadcast((at.tobytes(), w.tobytes(), b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            s = np.array([scorer(t.as_py()) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text scores threshold or more."""
    at, w, b = model
    shared = docs.sparkSession.sparkContext.broadcast((at.tobytes(), w.tobytes(), b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t.as_py()) < threshold for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
