"""Operator 8: packing by cutting-stock column generation.

A document's ids are cut every 4096 tokens; full pieces are sequences of their own, and what is left
is an item. Items of FINE tokens at most are bundled with others of their length, so that a bundle fills
whole units. Items and bundles fall into 256 classes of UNIT tokens, and the histogram of classes (bounded,
whatever the corpus) is what the linear program sees: revised simplex over patterns of classes, with
a knapsack by dynamic programming that prices new columns. Pricing ends at the optimum, or after MOST_STEPS
columns, which is logged: the patterns found by then hold every item all the same, with more padding.
Patterns are rounded down, the few items left over are packed by best fit, and every document's rank in its
class says which copy of which pattern takes it.

Null text: empty, so its one id is the closing one. A null doc_id and repeated rows are kept. Ties in rank
(equal doc_id, start, crc and length) are equal pieces: either order gives the same rows. A very long text is
cut into as many pieces as it needs. Tables without rows give none. Other columns of the input are ignored.
"""

from __future__ import annotations

import logging
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import gapless, staged, table

MODEL, END_ID, CAPACITY, UNIT = "word_bpe_49k.json", 2, 4096, 16
CLASSES = CAPACITY // UNIT
#: Pieces of so many tokens at most are bundled.
FINE = 64
#: Columns that the linear program generates at most.
MOST_STEPS = 20_000
#: Words that a worker keeps the ids of, and characters that such a word has at most.
CACHE, LONGEST = 600_000, 64
#: A character that keeps a text from being cut into pre-tokens here: beyond Latin-1, or white space and controls other than blanks, tabs and line ends.
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]")
#: The pre-tokens of a small-letter text without such characters: the model's own pattern, with its letters and numbers within Latin-1.
_PIECE = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^ \t\n\ra-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_WORKER: dict[str, Ids] = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: itself if it is visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words(dict):
    """Ids (as little-endian 32-bit bytes) by pre-token, which goes to the model itself in its own byte letters when it is first met."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        body = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
        found = array("I", [t.id for t in self.model(body)]).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found


def plain(text: str) -> bool:
    return "<|" not in text and not _ODD.search(text)


class Ids(dict):
    """Ids by text, by pre-token and, as entries, by chunk between blanks.

    A text of Latin-1 letters and marks is normal but for its letter case, so it is put in small
    letters and cut into pre-tokens here. One that may hold a special token (with "<|"), or odd
    characters, is taken by chunks, as white space parts pre-tokens: only the chunks that hold
    these go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        whole = Tokenizer.from_file(path)
        self.encode, self.words = whole.encode_batch_fast, Words(whole.model.tokenize)

    def of(self, text: str) -> bytes:
        if plain(text):
            return self.cut(text)
        chunks = text.replace("\n", " ").split(" ")
        self.learn(set(chunks))
        return b"".join(map(self.__getitem__, chunks))

    def cut(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _PIECE.findall(text.lower())))

    def learn(self, chunks: set[str]) -> None:
        missing = [c for c in chunks if c not in self]
        if len(self) + len(missing) > CACHE:
            self.clear()
            missing = chunks
        rest = []
        for c in missing:
            if plain(c):
                self[c] = self.cut(c)
            else:
                rest.append(c)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for c, e in zip(part, self.encode(part, add_special_tokens=False), strict=True):
                self[c] = array("I", e.ids).tobytes()


def ids_for(path: str) -> Ids:
    """This worker's own, which stay from task to task."""
    if path not in _WORKER:
        _WORKER[path] = Ids(path)
    return _WORKER[path]


def ids_of(texts: list[str | None], ids: Ids) -> Iterator[bytes]:
    """Each text's ids with the closing one, as little-endian 32-bit bytes."""
    end = np.array([END_ID], "<u4").tobytes()
    for t in texts:
        yield ids.of(t or "") + end


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens per piece of at most CAPACITY tokens."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_for(path)
        for batch in batches:
            who, rows = batch.column(0), ([], [], [], [], [])
            for k, data in enumerate(ids_of(batch.column(1).to_pylist(), ids)):
                n = len(data) // 4
                for start in range(0, n, CAPACITY):
                    part = data[4 * start : 4 * (start + CAPACITY)]
                    for column, value in zip(rows, (k, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([who.take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.int64()) for c in rows[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The most valuable items (any number of each) that fit, by dynamic programming over the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size, kind="stable")
    sizes, values = size[order], value[order]
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], k = best[c - 1], upto[c]
        if k:
            total = best[c - sizes[:k]] + values[:k]
            i = int(total.argmax())
            if total[i] > best[c] + 1e-12:
                best[c], pick[c] = total[i], i
    found, c = {}, capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            i = int(order[pick[c]])
            found[i] = found.get(i, 0) + 1
            c -= int(size[i])
    return float(best[capacity]), found


def generate(size: np.ndarray, demand: np.ndarray, capacity: int, most: int = MOST_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often each is used, in the linear program's optimum: as few patterns as hold the demand."""
    m = len(size)
    columns = np.diag((capacity // size).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand
    for _ in range(most):
        duals = inverse.sum(axis=0)
        value, items = knapsack(duals, size, capacity)
        if value <= 1 + 1e-7:
            break
        a = np.zeros(m)
        for i, k in items.items():
            a[i] = k
        d = inverse @ a
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        r = int(ratio.argmin())
        step = max(0.0, ratio[r])
        x = x - step * d
        x[r] = step
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        columns[:, r] = a
    else:
        logging.getLogger(__name__).warning("column generation ended after %d columns, short of the optimum", most)
    return columns, np.maximum(x, 0)


def plan(histogram: dict[int, int], classes: int = CLASSES) -> list[tuple[int, dict[int, int]]]:
    """(copies, {class: items}) that hold every item of the histogram exactly once. A class's number is its size in units."""
    size = np.array(sorted(c for c, n in histogram.items() if n), int)
    if not len(size):
        return []
    demand = np.array([histogram[c] for c in size.tolist()], np.int64)
    columns, x = generate(size, demand.astype(float), classes)
    whole = np.floor(x + 1e-6).astype(np.int64)
    held = columns.astype(np.int64) @ whole
    for r in np.flatnonzero(held > demand):  # rounding noise: give copies back
        for p in np.flatnonzero(columns[r] > 0):
            while held[r] > demand[r] and whole[p] > 0:
                whole[p] -= 1
                held -= columns[:, p].astype(np.int64)
    found = [(int(k), {int(size[i]): int(columns[i, p]) for i in np.flatnonzero(columns[:, p])}) for p, k in enumerate(whole) if k > 0]
    bins: list[list] = []  # [room, {class: items}]
    for i in range(len(size) - 1, -1, -1):
        for _ in range(int(demand[i] - held[i])):
            fit = [b for b in bins if b[0] >= size[i]]
            b = min(fit, key=lambda b: b[0]) if fit else [classes, {}]
            if not fit:
                bins.append(b)
            b[0] -= int(size[i])
            b[1][int(size[i])] = b[1].get(int(size[i]), 0) + 1
    return found + [(1, b) for _, b in bins]


def bundled(histogram: dict[int, int]) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """The histogram of unit classes, and for each class rows (first rank, pieces a bundle, unit class, first rank there).

    A class below 0 holds the pieces of so many tokens, one above 0 those of so many units, which stay single.
    """
    units = {c: n for c, n in histogram.items() if c > 0}
    rows = {c: [(0, 1, c, 0)] for c in units}
    for c, n in sorted(histogram.items()):
        if c < 0:
            most = UNIT // math.gcd(c, UNIT)
            whole, rest = divmod(n, most)
            for first, pieces, copies in ((0, most, whole), (whole * most, rest, 1)):
                if pieces and copies:
                    u = -(c * pieces // UNIT)
                    rows.setdefault(c, []).append((first, pieces, u, units.get(u, 0)))
                    units[u] = units.get(u, 0) + copies
    return units, {c: np.array(v, np.int64) for c, v in rows.items()}


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each class rows (first rank, items a copy, first sequence, first slot): which ranks go where."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for copies, items in patterns:
        slot = 0
        for c in sorted(items, reverse=True):
            out.setdefault(c, []).append((rank.get(c, 0), items[c], sequence, slot))
            rank[c] = rank.get(c, 0) + copies * items[c]
            slot += items[c]
        sequence += copies
    return {c: np.array(v, np.int64) for c, v in out.items()}


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    length = F.col("length")
    kind = F.when(length == CAPACITY, 0).when(length <= FINE, -length).otherwise(F.ceil(length / UNIT)).cast("int")
    rows = staged(pieces(docs, doc_id, text, model).withColumn("class", kind), "pieces")
    histogram = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}
    units, bundles = bundled(histogram)
    patterns = plan(units)
    shared = docs.sparkSession.sparkContext.broadcast((bundles, places(patterns)))
    filled = sum(copies for copies, _ in patterns)
    ranked = gapless(rows, "class", ["doc_id", "start", "ids_crc32", "length"], "rank", sum(histogram.values()))

    def row_of(table: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row that each rank falls in, and its rank there."""
        found = table[np.searchsorted(table[:, 0], rank, "right") - 1]
        return found, rank - found[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles, where = shared.value
        for batch in batches:
            kind, rank = np.asarray(batch.column("class")), np.asarray(batch.column("rank"))
            sequence, slot = rank + filled, np.zeros(len(rank), np.int64)
            for c in np.unique(kind).tolist():
                if c:
                    at = np.flatnonzero(kind == c)
                    b, k = row_of(bundles[c], rank[at])
                    item, inside = b[:, 3] + k // b[:, 1], k % b[:, 1]
                    for u in np.unique(b[:, 2]).tolist():
                        of = b[:, 2] == u
                        t, k = row_of(where[u], item[of])
                        sequence[at[of]], slot[at[of]] = t[:, 2] + k // t[:, 1], (t[:, 3] + k % t[:, 1]) * UNIT + inside[of]
            keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(slot)], [*keep, "sequence_id", "slot"])

    dealt = ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
