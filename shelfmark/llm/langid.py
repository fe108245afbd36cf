"""Operator 10: language by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, other characters become blanks, and the 1- to 3-grams of code points are
hashed to 2**BITS coordinates. Inverse document frequencies count every document that may be learned
from; follow-the-regularised-leader with elastic-net penalties learns weights from a bounded sample
(MAX_TRAIN documents, by a hash of the id, drawn in turn from each language that the usable rows have, so
that none is lost: one row of each at least; of these the first that have MAX_TERMS terms in all). A
temperature is then fitted on sample rows kept from the gradient, up to a fifth of each language's: on the
whole texts and on cuttings of one, three and eight words, as long texts alone would make short ones
look certain. A term counts as its share of the text's n-grams times its idf.

`und` with score 0 for texts that are null or have no letter. Rows with null lang, null doc_id or held out
are never learned from; of several texts of one id and language the one whose terms come first in order is.
Of languages with equal scores the first by name is predicted. A very long text is worked on in parts of
CHARS characters. With nothing to learn from, every prediction is `und`. Repeated rows give repeated rows, tables
without rows none. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import discard, first_of, held_out, staged, table

BITS = 15
#: Documented bound of the sample that weights and temperature are learned from.
MAX_TRAIN = 2400
#: Documented bound of the terms that the driver receives (8 bytes each).
MAX_TERMS = 12_000_000
#: Words of the cuttings that the temperature is fitted on beside whole texts.
SHORT = (1, 3, 8)
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 3, 0.5, 1.0, 0.02, 0.05, 30.0
#: Characters that are worked on at once.
CHARS = 2_000_000
_P = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_WORKER: dict = {}


def fold_table() -> np.ndarray:
    """Lower-case code point for each letter, a blank for all else."""
    if "fold" not in _WORKER:
        fold = np.full(0x110000, 32, np.uint32)
        for c in range(0x40000):  # no letter stands above
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _WORKER["fold"] = fold
    return _WORKER["fold"]


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Coordinates of the 1-, 2- and 3-grams that start at each position (the last ones are cut)."""
    h = codes * _P[0]
    shift = np.uint32(32 - BITS)
    yield (h ^ (h >> np.uint32(15))) * _P[1] >> shift
    two = h[:-1] ^ (codes[1:] * _P[1])
    yield (two ^ (two >> np.uint32(15))) * _P[1] >> shift
    three = two[:-1] * _P[2] + codes[2:] * _P[0]
    yield (three ^ (three >> np.uint32(13))) * _P[1] >> shift


def folded(text: str) -> np.ndarray:
    """The text's folded code points between two blanks; blanks never stand side by side."""
    codes = fold_table()[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def sums(texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' weight rows, and the number of n-grams (0: no letter)."""
    out, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at] or "") < CHARS):
            c = folded(texts[at] or "")
            group.append((at, c))
            size += len(c)
            at += 1
        starts = np.cumsum([0, *(len(c) for _, c in group)])
        codes, ids = np.concatenate([c for _, c in group]), np.array([i for i, _ in group])
        sizes = np.diff(starts)
        n[ids] = np.where(sizes > 2, 3 * sizes - 3, 0)
        for a in range(0, len(codes), CHARS):  # parts of a very long text
            part, b = codes[a : a + CHARS + 2], min(a + CHARS, len(codes))
            inside = np.clip(starts, a, b) - a
            used = np.flatnonzero(np.diff(inside))
            for k, g in enumerate(grams(part)):
                rows = np.zeros((b - a, weights.shape[1]), weights.dtype)
                rows[: len(g)] = weights[g[: b - a]]
                for j in range(k):  # n-grams that run into the next text
                    last = starts[1:] - 1 - j - a
                    rows[last[(last >= 0) & (last < b - a)]] = 0
                out[ids[used]] += np.add.reduceat(rows, inside[:-1][used], axis=0)
    return out, n


def cut_short(text: str, words: int) -> str:
    """Some words of a text, from a place that its hash decides."""
    found = text.split()
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(found) - words + 1)
    return " ".join(found[at : at + words])


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's coordinates and how often each occurs."""
    codes = folded(text or "")
    if len(codes) <= 2:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    c = np.bincount(np.concatenate(list(grams(codes))), minlength=2**BITS)
    at = np.flatnonzero(c)
    return at.astype(np.uint32), c[at].astype(np.uint32)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: np.ndarray  # idf included: 2**BITS x langs
    bias: np.ndarray
    temperature: float


def idf(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of each coordinate over all the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(2**BITS + 1, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                codes = folded(t.as_py() or "")
                seen = np.zeros(2**BITS, bool)
                if len(codes) > 2:
                    for g in grams(codes):
                        seen[g] = True
                    n += 1
                df[:-1] += seen
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["at", "n"])

    found = np.zeros(2**BITS + 1)
    for r in docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        found[r["at"]] = r.n
    return np.log((1 + found[-1]) / (1 + found[:-1])) + 0.1


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with L1 and L2 on softmax gradients. Rows: coordinates, values, language."""
    d = 2**BITS
    z, n = np.zeros((d, n_langs)), np.zeros((d, n_langs))
    bz, bn = np.zeros(n_langs), np.zeros(n_langs)
    weight = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w, b = weight(z[at], n[at]), -bz / ((BETA + np.sqrt(bn)) / ALPHA)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            bz += p - (np.sqrt(bn + p * p) - np.sqrt(bn)) / ALPHA * b
            bn += p * p
    return weight(z, n), -bz / ((BETA + np.sqrt(bn)) / ALPHA)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(scores / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS) -> Model:
    usable = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang").where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.where(~held_out(F.col("id")))
    weight = idf(usable)
    labelled = usable.select("id", "lang").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    most = max(max_train, usable.select("lang").distinct().count())
    chosen = labelled.withColumn("place", place).where(F.col("place") <= max_train).orderBy("place", F.xxhash64("id"), "id", "lang").limit(most)
    chosen = chosen.select("place", F.xxhash64("id").alias("h"), F.col("id").alias("_id"), F.col("lang").alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column("text"):
                whole = t.as_py()
                parts = [counts(whole), *(counts(cut_short(whole, k)) for k in SHORT)]
                found.append([np.concatenate([x[i] for x in parts]).tobytes() for i in (0, 1)] + [[len(a) for a, _ in parts]])
            at, n, sizes = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("place", "h", "id", "lang")), pa.array(at, pa.binary()), pa.array(n, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], ["place", "h", "id", "lang", "at", "n", "sizes"])

    sample = usable.join(F.broadcast(chosen), (F.col("id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("place", "h", "id", "lang", "text")
    sample = sample.mapInArrow(run, "place int, h long, id long, lang string, at binary, n binary, sizes array<int>")
    sample = sample.groupBy("place", "h", "id", "lang").agg(F.min(F.struct("at", "n", "sizes")).alias("x")).select("place", "h", "id", "lang", "x.*", (F.length("x.at") / 4).alias("terms"))
    sample = staged(sample, "language-sample")
    found = first_of(sample, ["place", "h", "id", "lang"], "terms", max_terms).orderBy("id", "lang").collect()
    discard(sample)
    langs = tuple(sorted({r.lang for r in found}))
    rows, held, seen = [], [], dict.fromkeys(langs, 0)
    for r in found:
        at, c = (np.split(np.frombuffer(x, np.uint32), np.cumsum(r.sizes)[:-1]) for x in (r["at"], r.n))
        terms = [(a, SCALE * k / k.sum() * weight[a], langs.index(r.lang)) for a, k in zip(at, c, strict=True) if len(a)]
        if len(at[0]):
            seen[r.lang] += 1
            if seen[r.lang] % 5:
                rows.append(terms[0])
            else:
                held += terms
    if not langs:
        return Model((), np.zeros((2**BITS, 0), np.float32), np.zeros(0), 1.0)
    w, b = train(rows, len(langs))
    scores = np.array([x @ w[at] + b for at, x, _ in held]).reshape(len(held), len(langs))
    t = temperature(scores, np.array([y for _, _, y in held], int))
    return Model(langs, (SCALE * weight[:, None] * w).astype(np.float32), b, t)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the calibrated probability)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.bias, model.temperature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights, bias, t = shared.value
        for batch in batches:
            rows = batch.num_rows
            best, top = np.zeros(rows, int), np.zeros(rows)
            n = np.zeros(rows, np.int64)
            if langs and rows:
                s, n = sums(batch.column("text").to_pylist(), weights)
                p = softmax((s / np.maximum(n, 1)[:, None] + bias) / t)
                best, top = p.argmax(axis=1), p.max(axis=1)
            lang = [langs[b] if k else "und" for b, k in zip(best, n, strict=True)] if langs else ["und"] * rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(np.where(n > 0, top, 0.0), pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
