"""Operator 4: benchmark decontamination by greedy string tiling.

Words are lower-cased and stripped of marks. Seeds of MIN_MATCH words that a document shares with a
benchmark item name the pairs to look at; running Karp-Rabin then marks the longest matches that
don't overlap, longest first, down to MIN_MATCH words. The share of the item's words that is marked
is its coverage, whatever the order of its passages in the document; THRESHOLD of it is a leak.

The benchmark is broadcast in blocks of a checked size, by a hash of the item, and the documents are
scanned once a block. Null or empty texts have no words and match nothing; an item of fewer than
MIN_MATCH words must occur whole. A null doc_id is kept. Repeated rows are judged each for itself. Of equally
long matches the one that begins first in the item, then in the document, is marked first. A very long text
takes memory for a number per word; tiling sees only the places around shared seeds. Tables without rows give
none; other columns are ignored by matches(), and kept by clean().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.common import table

MIN_MATCH, THRESHOLD = 5, 0.8
#: Length that the search for long matches starts with.
START = 24
#: Bytes of benchmark text that a broadcast block holds on average; one of over twice as much is cut, and an item that is larger alone has a block of its own.
BLOCK_BYTES = 8_000_000
CACHE = 400_000
_WORKER: dict[str, "Benchmark"] = {}
_MARKS = "\"'`.,;:!?()[]{}<>*_-#$%&|/\\~^+=@¿¡«»“”‘’…"
_P = np.int64(0x9E3779B97F4A7C1)


class WordNumbers(dict):
    """Numbers of the benchmark's words; 0 for other words, -1 for marks alone."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        bare = word.lower().strip(_MARKS)
        n = self.vocabulary.get(bare, 0) if bare else -1
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


def words_of(text: str | None) -> list[str]:
    return [b for w in (text or "").split() if (b := w.lower().strip(_MARKS))]


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k numbers."""
    h = np.zeros(max(0, len(ids) - k + 1), np.int64)
    for i in range(k):
        h = h * _P + ids[i : len(ids) - k + 1 + i]
    return h


class Benchmark:
    """The items' words as numbers, and where each seed occurs."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int = MIN_MATCH):
        self.vocabulary: dict[str, int] = {}
        self.items, self.min_match = [], min_match
        seeds: dict[int, dict[int, set[int]]] = {}  # seed length: hash: items
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            k = min(min_match, len(ids))
            for h in rolling(ids, k).tolist():
                seeds.setdefault(k, {}).setdefault(h, set()).add(len(self.items))
            self.items.append((item_id, ids))
        self.seeds = {k: (np.array(sorted(by), np.int64), by) for k, by in seeds.items()}
        self.numbers = WordNumbers(self.vocabulary)

    def hits(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, tiles, words matched, words of the item) for each item that shares a seed with the text."""
        words = text.split() if text else []
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        ids = ids[ids >= 0]
        for k, (hashes, by) in self.seeds.items():
            if len(ids) < k:
                continue
            known = np.convolve(ids > 0, np.ones(k, int), "valid") == k
            at = np.flatnonzero(known)
            if not len(at):
                continue
            h = rolling(ids, k)[at]
            found = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
            places: dict[int, list[int]] = {}
            for p, x in zip(at[found].tolist(), h[found].tolist(), strict=True):
                for item in by[x]:
                    places.setdefault(item, []).append(p)
            for item, starts in places.items():
                item_id, pattern = self.items[item]
                # All matches lie where seeds do: the rest of the document can't be part of a tile.
                inside = np.zeros(len(ids), bool)
                for p in starts:
                    inside[p : p + k] = True
                edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
                body = [x for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) for x in (*ids[a:b].tolist(), -1)]
                tiles = tiling(pattern.tolist(), body, k)
                yield item_id, len(tiles), sum(n for _, _, n in tiles), len(pattern)


def ready(name: str, block: Callable[[], list], min_match: int) -> Benchmark:
    """This worker's own, which stays from task to task; blocks come one after the other, so only the last is kept."""
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Benchmark(block(), min_match)
    return _WORKER[name]


def tiling(pattern: list[int], text: list[int], min_match: int, start: int = START) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (place in pattern, place in text, length) of the tiles.

    A search length s is tried from start downwards. Runs of s unmarked numbers are hashed; equal ones
    are stretched as far as they go, and the longest that are still free are marked first. A match of
    twice the search length starts the search again with its own length.
    """
    in_pattern, in_text = [False] * len(pattern), [x < 0 for x in text]
    tiles: list[tuple[int, int, int]] = []
    s = max(min_match, min(start, len(pattern)))
    while True:
        longest, matches = scan(pattern, text, in_pattern, in_text, s)
        if longest > 2 * s:
            s = longest
            continue
        for n, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not any(in_pattern[p : p + n]) and not any(in_text[t : t + n]):
                in_pattern[p : p + n] = in_text[t : t + n] = [True] * n
                tiles.append((p, t, n))
                continue
            # Partly taken by a longer one: what is left of it counts if it is long enough.
            for a, b, size in remainder(in_pattern, in_text, p, t, n):
                if size >= s:
                    in_pattern[a : a + size] = in_text[b : b + size] = [True] * size
                    tiles.append((a, b, size))
        if s <= min_match:
            return tiles
        s = max(min_match, s // 2)


def remainder(in_pattern: list[bool], in_text: list[bool], p: int, t: int, n: int) -> list[tuple[int, int, int]]:
    """The runs of a match that are free on both sides."""
    out, k = [], 0
    while k < n:
        a = k
        while k < n and not in_pattern[p + k] and not in_text[t + k]:
            k += 1
        if k > a:
            out.append((p + a, t + a, k - a))
        k += 1
    return out


def scan(pattern: list[int], text: list[int], in_pattern: list[bool], in_text: list[bool], s: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Matches (length, place in pattern, place in text) of s numbers at least, stretched; and the longest length."""
    table: dict[int, list[int]] = {}
    for t in free_runs(in_text, s):
        table.setdefault(hash(tuple(text[t : t + s])), []).append(t)
    longest, matches, seen = 0, [], set()
    for p in free_runs(in_pattern, s):
        for t in table.get(hash(tuple(pattern[p : p + s])), ()):
            if pattern[p : p + s] != text[t : t + s] or (p - t, p) in seen:
                continue
            n = s
            while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not in_pattern[p + n] and not in_text[t + n]:
                n += 1
            seen.update((p - t, p + k) for k in range(n - s + 1))
            longest = max(longest, n)
            matches.append((n, p, t))
    return longest, matches


def free_runs(marked: list[bool], s: int) -> Iterator[int]:
    """Places from which s numbers are unmarked."""
    run = 0
    for i, m in enumerate(marked):
        run = 0 if m else run + 1
        if run >= s:
            yield i - s + 1


def counted_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[tuple[int | None, int], str | None]]]:
    """The items, as ((item_id, equal rows), text), in blocks to broadcast."""
    rows = items.groupBy(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).agg(F.count("*").alias("copies"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows
        found, size = [], 0
        for r in block.toLocalIterator():
            more = len((r.text or "").encode("utf-8", "surrogatepass"))
            if found and size + more > 2 * block_bytes:
                yield found
                found, size = [], 0
            found.append(((r.item_id, r.copies), r.text))
            size += more
        yield found


def benchmark_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, equal rows once, in blocks to broadcast."""
    for block in counted_blocks(items, item_id, text, block_bytes):
        yield [(item, t) for (item, _), t in block]


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document and benchmark item that it leaks: doc_id, item_id, n_tiles, n_matched, n_item_words, coverage."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in counted_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            bench = ready(name, lambda: shared.value, min_match)
            for batch in batches:
                at, rows = [], []
                for k, t in enumerate(batch.column(1)):
                    for hit in bench.hits(t.as_py()):
                        if hit[2] >= threshold * hit[3]:
                            at.append(k)
                            rows.append(hit)
                cols = [*zip(*((*item, *rest) for item, *rest in rows), strict=True)] if rows else [(), (), (), (), ()]
                share = [m / n for m, n in zip(cols[3], cols[4], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols), pa.array(share, pa.float64())], ["doc_id", "item_id", "copies", "n_tiles", "n_matched", "n_item_words", "coverage"])

        found = docs.mapInArrow(run, "doc_id long, item_id long, copies long, n_tiles long, n_matched long, n_item_words long, coverage double")
        each = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")
        found = found.select("doc_id", "item_id", "n_tiles", "n_matched", "n_item_words", "coverage", each).drop("_copy")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text leaks an item."""
    for block in benchmark_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            bench = ready(name, lambda: shared.value, min_match)
            for batch in batches:
                keep = [not any(h[2] >= threshold * h[3] for h in bench.hits(t.as_py())) for t in batch.column(text)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
