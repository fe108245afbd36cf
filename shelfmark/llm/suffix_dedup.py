"""Operator 1: exact repeated passages by suffix arrays.

A 50-byte string counts as repeated in a document if it also starts in one with a smaller doc_id; all
bytes that such strings cover are removed. Matches never cross documents.

1. Every document is winnowed: of the GRAM-byte strings inside each 50-byte window the one with the
   least hash is an anchor, so equal windows have equal anchors. Anchors are sorted in each task; one
   that the task has seen in two documents is known to repeat and is sent on once, and the others
   are sent as packed numbers to find their twins elsewhere.
2. Of the windows whose anchor occurs in two documents or more, each task makes a suffix array of its
   own: their suffixes are put in order in two stages (those smaller than their successors are sorted
   directly, and a scan over the buckets of first bytes induces the rest), adjacent common prefixes of
   50 bytes form runs, and in each run the windows of documents other than the smallest are covered.
   What isn't covered is cut out and dealt by its anchor, so equal windows meet. Windows of an anchor
   that very many documents hold are dealt singly, by what they hold, so that no anchor fills a shard.
3. Each shard of cuttings gets its suffix array in the same way.
4. Covered spans are brought to the texts and removed.

No hash decides about equality: it only brings windows together. Texts travel packed: a row holds those of
one task and one box of documents. Null or empty text: nothing removed. A null doc_id counts after every
id. Rows with equal doc_id never repeat each other; identical rows have identical results. Ties (equal
windows of one document) are covered together. A very long text is hashed in blocks, so that memory grows
with its bytes and nothing else; tables without rows give none. Other columns of the input are ignored by
query(), and kept by deduplicate().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.llm.common import discard, staged, table

WINDOW, GRAM = 50, 20
SPAN = WINDOW - GRAM + 1
#: Text bytes, as UTF-8, for each shard of anchors, and for each shard of cuttings, which is sorted as one string.
SHARD_BYTES, CUTTING_BYTES = 3_000_000, 2_000_000
#: Text bytes that a task looks for anchors in at once, that it sorts at once, and that it gathers before it packs them by box.
GROUP_BYTES, SORT_BYTES, PACK_BYTES = 8_000_000, 4_000_000, 16_000_000
#: Documents that hold an anchor from which on its windows are dealt singly, and the most such anchors (more: the commonest).
HOT_DOCS, HOT_ANCHORS = 2_000, 1 << 21
#: Text bytes that are hashed at once; longer documents are cut at its multiples.
BLOCK_BYTES = 500_000
#: Text bytes of the documents whose mail lies in one box; numbers that a task gathers before it sends them.
BOX_BYTES, MAIL = 8_000_000, 2_000_000
NOTHING = np.zeros(0, np.int32)
#: The id that a null doc_id is carried as; the last bit of its tag tells it from a real one.
LAST = 2**63 - 1
#: The bits of a tag that a box depends on, and that come with an anchor: rows of one id that share them get each other's places, which does no harm.
SHORT = 0xFFFF
#: The shard number of rows that name hot anchors.
HOT = -(2**63)
_B = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in (1, 2, 4, 8, 16)]
_MIX, ALL_BITS = np.uint64(0xD6E8FEB86659FD93), np.uint64(2**64 - 1)


def gram_hashes(t: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes at each position."""
    powers, h = {}, t.astype(np.uint64) + np.uint64(1)
    size = 1
    for b in _B:
        powers[size] = h
        if size == 16:
            break
        h = h[:-size] * b + h[size:]
        size *= 2
    n = len(t) - GRAM + 1
    h = powers[16][:n] * _B[2] + powers[4][16 : 16 + n]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def dealt(least: np.ndarray, mask: np.uint64) -> np.ndarray:
    """The bits that name an anchor, spread evenly: least hashes themselves are mostly small."""
    h = least * _MIX
    h ^= h >> np.uint64(32)
    return h * _B[0] & mask


def segments_of(t: np.ndarray, doc: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same least hash inside one document: the anchor, first window, number of windows."""
    if len(t) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, m, size = len(t) - WINDOW + 1, gram_hashes(t), 1
    while size * 2 <= SPAN:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    best = np.minimum(m[:n], m[SPAN - size : SPAN - size + n])
    own = doc[:n] == doc[WINDOW - 1 :]
    first = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (own[1:] != own[:-1]) | (doc[1:n] != doc[: n - 1]))))
    count = np.diff(np.concatenate((first, [n])))
    keep = own[first]
    return dealt(best[first[keep]], mask), first[keep], count[keep]


def ranks(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The order numbers of ids; a null one (the tag's last bit) comes after all."""
    none = tags & 1
    order = np.lexsort((none, ids))
    new = np.zeros(len(ids), np.int32)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (none[order][1:] != none[order][:-1])
    out = np.empty(len(ids), np.int32)
    out[order] = np.cumsum(new)
    return out


class Group:
    """Documents of a batch as one byte string."""

    def __init__(self, ids: np.ndarray, tags: np.ndarray, texts: list[bytes], mask: np.uint64 = ALL_BITS):
        self.ids, self.tags, self.mask = ids, tags, mask
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        self.text = np.frombuffer(b"".join(texts), np.uint8)

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Places (from, to) of runs of whole small documents, and of the parts of long ones, which overlap by a window."""
        a = 0
        for d in range(len(self.ids)):
            b, e = int(self.start[d]), int(self.start[d + 1])
            if e - b > BLOCK_BYTES:
                if a < b:
                    yield a, b
                yield from ((c, min(e, c + BLOCK_BYTES + WINDOW - 1)) for c in range(b, e, BLOCK_BYTES))
                a = e
            elif e - a > BLOCK_BYTES:
                yield a, b
                a = b
        if a < len(self.text):
            yield a, len(self.text)

    def segments(self) -> tuple[np.ndarray, ...]:
        """segments_of for all texts, and the document of each segment."""
        found = []
        for a, b in self.blocks():
            doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.clip(self.start[1:], a, b) - np.clip(self.start[:-1], a, b))
            h, first, count = segments_of(self.text[a:b], doc, self.mask)
            found.append((h, first + a, count, doc[first].astype(np.int64)))
        if not found:
            return segments_of(self.text[:0], np.zeros(0, np.int32), self.mask) + (np.zeros(0, np.int64),)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def groups(batches: Iterator[pa.RecordBatch], mask: np.uint64, most: int) -> Iterator[Group]:
    """Batches of (doc_id, tag, data) as groups of about so many bytes."""
    ids, tags, texts, size = [], [], [], 0
    for batch in batches:
        for i, g, t in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("data"), strict=True):
            data = t.as_py()
            ids.append(i)
            tags.append(g)
            texts.append(data)
            size += len(data)
            if size >= most:
                yield Group(np.array(ids, np.int64), np.array(tags, np.int64), texts, mask)
                ids, tags, texts, size = [], [], [], 0
    if ids:
        yield Group(np.array(ids, np.int64), np.array(tags, np.int64), texts, mask)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, byte by byte of all numbers: bytes that are nearly always zero take no room."""
    body = b"".join(np.array([len(a)], "<i8").tobytes() + a.dtype.str.encode().ljust(4) + np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(body)


def unpacked(data: bytes) -> list[np.ndarray]:
    body, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(body):
        n, kind = int(np.frombuffer(body, "<i8", 1, at)[0]), np.dtype(body[at + 8 : at + 12].decode().strip())
        planes = np.frombuffer(body, np.uint8, n * kind.itemsize, at + 12).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 12 + n * kind.itemsize
    return out


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Shard numbers that ascend with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def kept_bits(size: int) -> int:
    """Bits of an anchor's hash that are sent for so many text bytes: about one anchor in a thousand then meets another one by chance."""
    return min(64, max(40, size.bit_length() + 6))


def first_pass(shards: int, boxes: int, bits: int):
    """Texts to anchors. Rows: shard, blob. Below 0: mail with places known to repeat; else numbers that look for twins."""
    drop = np.uint64(64 - bits)
    mask, most = ALL_BITS >> drop << drop, GROUP_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = Mail(boxes)
        for g in groups(batches, mask, most):
            h, first, count, doc = g.segments()
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, doc, first, count, short = h[order], doc[order], first[order], count[order], g.tags & SHORT
            new = np.concatenate(([True], h[1:] != h[:-1]))
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            holders = np.add.reduceat(new | np.concatenate(([True], doc[1:] != doc[:-1])), starts, dtype=np.int64)
            known = (holders > 1)[run_of]
            own = first - g.start[doc]
            mail.put(g.ids[doc[known]], short[doc[known]], own[known], count[known])
            # Of each anchor the task sends one entry: the first place if one document has it, else its hash and how many have it.
            rows = [], []
            h1, doc1, own1, count1 = h[starts] >> drop, doc[starts], np.where(holders > 1, -holders, own[starts]), np.where(holders > 1, 0, count[starts])
            # A document may hold an anchor in several places: all of them follow their first one.
            more = ~new & ~known
            extra = run_of[more], own[more], count[more]
            shard = shard_of(h[starts], shards)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            extra_cuts = np.searchsorted(extra[0], cuts)
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[s], cuts[s + 1]
                c, d = extra_cuts[s], extra_cuts[s + 1]
                used, local = np.unique(doc1[a:b], return_inverse=True)
                add(rows, s, packed(np.diff(h1[a:b], prepend=np.uint64(0)), local.astype(np.uint16 if len(used) < 65_536 else np.uint32), own1[a:b].astype(np.int32), g.ids[used], short[used].astype(np.uint16), (extra[0][c:d] - a).astype(np.int32), extra[1][c:d].astype(np.int32), count1[a:b].astype(np.int32), extra[2][c:d].astype(np.int32)))
            yield frame(rows)
            yield from mail.sent(MAIL)
        yield from mail.sent(0)

    return run


def box_of(ids: np.ndarray, tags: np.ndarray, boxes: int) -> np.ndarray:
    """The box of a document: its mail and its text go there."""
    return np.mod(ids ^ (tags & SHORT), boxes)


class Mail:
    """Numbers for documents (ids, tags, and two numbers each), gathered and sent as one blob for each box."""

    def __init__(self, boxes: int):
        self.boxes, self.lots, self.size = boxes, [], 0

    def put(self, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self.lots.append(arrays)
            self.size += len(arrays[0])

    def sent(self, over: int) -> Iterator[pa.RecordBatch]:
        """What has been gathered, if that is more than over."""
        if self.size <= over:
            return
        ids, tags, *values = (np.concatenate(x) for x in zip(*self.lots, strict=True))
        self.lots, self.size = [], 0
        where = box_of(ids, tags, self.boxes)
        order = np.lexsort((values[0], tags, ids, where))
        ids, tags, where, rows = ids[order], tags[order], where[order], ([], [])
        heads = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))))
        ends = np.concatenate((heads[1:], [len(ids)]))
        values = [v[order].astype(np.int32) for v in values]
        cuts = np.flatnonzero(np.concatenate(([True], where[heads][1:] != where[heads][:-1])))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(heads)], strict=True):
            at, to = heads[a], ends[b - 1]
            add(rows, -1 - int(where[at]), packed(ids[heads[a:b]], tags[heads[a:b]], (ends[a:b] - heads[a:b]).astype(np.int32), *(v[at:to] for v in values)))
        yield frame(rows)


def opened(blobs: list[bytes]) -> dict[tuple[int, int], list[np.ndarray]]:
    """A box's mail by (doc_id, tag). Equal rows of many tasks bring the same mail: it is kept once."""
    out: dict[tuple[int, int], list] = {}
    for blob in blobs:
        ids, tags, counts, *values = unpacked(blob)
        ends = np.cumsum(counts)
        for i, t, a, b in zip(ids.tolist(), tags.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            lots = out.setdefault((i, t), [])
            lots.append(np.stack([v[a:b] for v in values]))
            if len(lots) >= 64:
                lots[:] = [np.unique(np.concatenate(lots, axis=1), axis=1)]
    return {k: list(np.concatenate(v, axis=1)) for k, v in out.items()}


def add(rows: tuple[list, ...], *values) -> None:
    for column, value in zip(rows, values, strict=True):
        column.append(value)


def frame(rows: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], ["shard", "blob"])


ROWS = "shard long, blob binary"


def runs_of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows sorted by shard as (shard, blobs); mail comes blob by blob."""
    at, blobs = None, []
    for batch in batches:
        for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if s != at or s < 0:
                if blobs:
                    yield at, blobs
                at, blobs = s, []
            blobs.append(b)
    if blobs:
        yield at, blobs


def find_twins(boxes: int, bits: int):
    """Anchors of a shard to mail with the places whose anchor occurs in two documents or more, and the names of hot anchors."""
    enough = HOT_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = Mail(boxes)
        for s, blobs in runs_of_shards(batches):
            if s < 0:
                yield frame(([s], blobs))
                continue
            hot, *found = twins(blobs, bits, enough)
            if len(hot[0]):
                yield frame(([HOT], [packed(*hot)]))
            mail.put(*found)
            yield from mail.sent(MAIL)
        yield from mail.sent(0)

    return run


def twins(blobs: list[bytes], bits: int, enough: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hot anchors and how many documents have them; ids, tags, places and counts of windows of a shard's anchors that occur in two documents or more."""
    parts = [unpacked(b) for b in blobs]
    h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    place, count = np.concatenate([p[2] for p in parts]), np.concatenate([p[7] for p in parts])
    local = [p[1].astype(np.int64) for p in parts]
    ids = np.concatenate([p[3][k] for p, k in zip(parts, local, strict=True)])
    tags = np.concatenate([p[4][k] for p, k in zip(parts, local, strict=True)]).astype(np.int64)
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    extra_of, extra_at, extra_n = np.concatenate([p[5] + base[i] for i, p in enumerate(parts)]), np.concatenate([p[6] for p in parts]), np.concatenate([p[8] for p in parts])
    del parts, local
    order = np.argsort(h, kind="stable")
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    starts, run_of = np.flatnonzero(new), np.empty(len(h), np.int64)
    run_of[order] = np.cumsum(new) - 1
    # An anchor repeats if one task has seen it in two documents, or if a neighbour in order is of another document.
    a, b = order[1:], order[:-1]
    other = np.concatenate(([False], ~new[1:] & ((ids[a] != ids[b]) | ((tags[a] ^ tags[b]) & 1 > 0))))
    repeats = np.logical_or.reduceat(other | (place < 0)[order], starts)[run_of]
    holders = np.add.reduceat(np.maximum(1, -place[order].astype(np.int64)), starts)
    hot = holders >= enough
    mine = repeats & (place >= 0)
    more = repeats[extra_of] & (place[extra_of] >= 0)
    names = h[order[starts[hot]]] << np.uint64(64 - bits), holders[hot]
    return names, *(np.concatenate((x[mine], y[more])) for x, y in ((ids, ids[extra_of]), (tags, tags[extra_of]), (place, extra_at), (count, extra_n)))


def hot_anchors(places: DataFrame) -> np.ndarray:
    """The sorted hashes of hot anchors: at most HOT_ANCHORS, those that most documents have."""
    found = [unpacked(bytes(r.blob)) for r in places.where(F.col("shard") == HOT).toLocalIterator()]
    if not found:
        return np.zeros(0, np.uint64)
    h, n = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.sort(h[np.argsort(-n, kind="stable")[:HOT_ANCHORS]])


def runs(on: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of true; breaks[i]: none goes on from i - 1 to i."""
    head = on & np.concatenate(([True], ~on[:-1] | breaks[1:]))
    first = np.flatnonzero(head)
    return first, np.bincount(np.cumsum(head)[on] - 1, minlength=len(first))


def anchors_at(text: np.ndarray, at: np.ndarray, mask: np.uint64) -> np.ndarray:
    """The anchor of the window at each place."""
    m, size = gram_hashes(text), 1
    while size * 2 <= SPAN:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return dealt(np.minimum(m[at], m[at + SPAN - size]), mask)


def cut_out(shards: int, boxes: int, bits: int, hot: np.ndarray):
    """Texts with their mail to mail with covered spans, and cuttings by shard."""
    drop = np.uint64(64 - bits)
    mask, most = ALL_BITS >> drop << drop, SORT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = Mail(boxes)
        for g, first, count, doc in groups_with_places(batches, most):
            if not len(first):
                continue
            # Segments that follow each other are one piece of text.
            joint = np.concatenate(([False], (first[1:] == first[:-1] + count[:-1]) & (doc[1:] == doc[:-1])))
            heads, piece = np.flatnonzero(~joint), np.cumsum(~joint) - 1
            size = np.add.reduceat(count, heads) + WINDOW - 1
            text = g.text[spread(first[heads], size)]
            start = np.cumsum(size) - size
            shift = (first[heads] - g.start[doc[heads]]) - start  # from a place in text to one in its document
            h = anchors_at(text, first - first[heads][piece] + start[piece], mask)
            # Only windows whose anchor stands here twice can be covered here.
            order = np.argsort(h)
            twin = np.concatenate(([False], h[order][1:] == h[order][:-1]))
            twice = np.zeros(len(h), bool)
            twice[order] = twin | np.concatenate((twin[1:], [False]))
            segment = np.repeat(np.arange(len(h)), count)
            at = spread(start, size - WINDOW + 1)
            covered = repeated(text, size, ranks(g.ids, g.tags)[doc[heads]], at[twice[segment]])
            gone, n = runs(covered[at], np.concatenate(([True], piece[segment][1:] != piece[segment][:-1])))
            begin = at[gone] + shift[piece[segment[gone]]]
            mail.put(g.ids[doc[segment[gone]]], g.tags[doc[segment[gone]]], begin, begin + n + WINDOW - 1)
            # What is left of each segment is a cutting.
            change = np.concatenate(([True], segment[1:] != segment[:-1]))
            if len(hot):
                single = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                change |= single[segment]
            left, n = runs(~covered[at], change)
            begin, segment = at[left], segment[left]
            key = h[segment]
            if len(hot):
                key = np.where(single[segment], window_hashes(text, begin), key)
            yield cuttings(text, begin, n, key, shift[piece[segment]], doc[segment], g, shards)
            yield from mail.sent(MAIL)
        yield from mail.sent(0)

    return run


def cuttings(text: np.ndarray, begin: np.ndarray, count: np.ndarray, key: np.ndarray, shift: np.ndarray, doc: np.ndarray, g: Group, shards: int) -> pa.RecordBatch:
    """Rows of cuttings: the windows from begin on, dealt by key. shift leads to the place in the document."""
    out = [], []
    shard = shard_of(key, shards)
    order = np.argsort(shard, kind="stable")
    begin, count, shift, doc, shard = begin[order], count[order], shift[order], doc[order], shard[order]
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
    for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
        used, local = np.unique(doc[a:b], return_inverse=True)
        add(out, int(shard[a]), packed(text[spread(begin[a:b], count[a:b] + WINDOW - 1)], count[a:b].astype(np.int32), local.astype(np.int32), (begin[a:b] + shift[a:b]).astype(np.int32), g.ids[used], g.tags[used]))
    return frame(out)


def window_hashes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A mixed hash of the window at each place."""
    word, h = words_at(np.concatenate((text, np.zeros(8, np.uint8)))), np.zeros(len(at), np.uint64)
    for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        h = (h ^ word[at + k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run of the given size, one run after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def repeated(text: np.ndarray, size: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place of text, which holds pieces of the given sizes one after the other, whether it is one of at and its window is also at another one, in a piece of a smaller rank."""
    covered, wanted = np.zeros(len(text), bool), np.zeros(len(text), bool)
    if not len(at):
        return covered
    wanted[at] = True
    order, word = two_stage(text, wanted)
    who = np.repeat(rank.astype(np.int32), size)[order]
    head = np.concatenate(([True], ~reaches(word, order)))
    least = np.minimum.reduceat(who, np.flatnonzero(head))
    covered[order[who > least[np.cumsum(head) - 1]]] = True
    return covered


def boxed(boxes: int):
    """Rows (doc_id, tag and more) to rows box, kind 1 and a blob that holds those of a box as a packed table."""

    def packs(gathered: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = pa.Table.from_batches(gathered).combine_chunks()
        where = box_of(np.asarray(found.column("doc_id")), np.asarray(found.column("tag")), boxes)
        order = np.argsort(where, kind="stable")
        found, where, blobs = found.take(pa.array(order)), where[order], []
        cuts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(where)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, found.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_table(found.slice(a, b - a))
            blobs.append(sink.getvalue().to_pybytes())
        del found
        pa.default_memory_pool().release_unused()
        return pa.RecordBatch.from_arrays([pa.array(where[cuts], pa.int64()), pa.array([1] * len(cuts), pa.int32()), pa.array(blobs, pa.binary())], ["box", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gathered.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield packs(gathered)
                gathered, size = [], 0
        if gathered:
            yield packs(gathered)

    return run


def with_mail(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, dict[tuple[int, int], list[np.ndarray]]]]:
    """(packed table, its box's mail) of rows sorted by box and kind: a box's mail comes before its texts."""
    at, blobs, mail = None, [], None
    for batch in batches:
        for b, kind, blob in zip(batch.column("box").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            if b != at:
                at, blobs, mail = b, [], None
            if kind == 0:
                blobs.append(blob.as_py())
                continue
            if mail is None:
                mail = opened(blobs)
            yield pa.ipc.open_stream(blob.as_buffer()).read_all(), mail


def rows_with_mail(batches: Iterator[pa.RecordBatch], bits: int = -1) -> Iterator[tuple[int, int, bytes, list[np.ndarray] | None]]:
    """(doc_id, tag, text, mail or None) of each document. bits: those of the tag that the mail is addressed with."""
    for found, mail in with_mail(batches):
        for i, t, data in zip(found.column("doc_id").to_pylist(), found.column("tag").to_pylist(), found.column("data"), strict=True):
            yield i, t, data.as_py(), mail.get((i, t & bits))


def groups_with_places(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Group, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of the documents that have mail, and of the segments that repeat the first window (a place in the group's text), the number of windows and the document. Equal rows of a group count once."""
    rows, seen, size = [], set(), 0

    def group() -> tuple[Group, np.ndarray, np.ndarray, np.ndarray]:
        ids, tags, texts, found = zip(*rows, strict=True)
        g = Group(np.array(ids, np.int64), np.array(tags, np.int64), list(texts))
        doc = np.repeat(np.arange(len(ids)), [len(x[0]) for x in found])
        first, count = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        first += g.start[doc]
        order = np.lexsort((count, first))
        first, count, doc = first[order], count[order], doc[order]
        fits = (first + count + WINDOW - 1 <= g.start[doc + 1]) & np.concatenate(([True], (first[1:] != first[:-1]) | (count[1:] != count[:-1])))
        return g, first[fits], count[fits], doc[fits]

    for i, t, data, found in rows_with_mail(batches, SHORT):
        if found is None or (i, t) in seen:
            continue
        seen.add((i, t))
        rows.append((i, t, data, found))
        size += len(data)
        if size >= most:
            yield group()
            rows, seen, size = [], set(), 0
    if rows:
        yield group()


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as a sorted union without overlaps or touching ones."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    return start[new].astype(np.int32), end[last].astype(np.int32)


def words_at(t: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a number that sorts as they do. t is padded."""
    return np.ndarray((len(t) - 8,), ">u8", np.ascontiguousarray(t), 0, (1,)).astype(np.uint64)


def word_of(word: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The bytes from k to k + 8 of the windows at some places, as numbers that sort as they do."""
    found, more = word[k:][at], 8 - (WINDOW - k)
    return found >> np.uint64(8 * more) if more > 0 else found


def sort_directly(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places in the order of their windows: by 8 bytes, then where these are equal by the next 8, while windows differ at all."""
    key = word_of(word, at, 0)
    order = np.argsort(key)
    at, key = at[order], key[order]
    tie = np.concatenate(([False], key[1:] == key[:-1]))
    for k in range(8, WINDOW, 8):
        here = np.flatnonzero(tie)
        # A run of ties whose windows are all equal is in order already.
        differs = np.ones(len(here), bool)
        alive = np.arange(len(here))
        for j in range(k, WINDOW, 8):
            alive = alive[word_of(word, at[here[alive]], j) == word_of(word, at[here[alive] - 1], j)]
        differs[alive] = False
        run = np.cumsum(~tie) - 1
        open_runs = np.zeros(run[-1] + 1 if len(run) else 0, bool)
        open_runs[run[here[differs]]] = True
        todo = np.flatnonzero(open_runs[run])
        if not len(todo):
            break
        key, of = word_of(word, at[todo], k), run[todo]
        order = np.argsort(key)
        order = order[np.argsort(of[order], kind="stable")]
        at[todo], key = at[todo[order]], key[order]
        tie = np.zeros(len(at), bool)
        tie[todo[1:]] = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    return at


def two_stage(text: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted places in the order of their suffixes' first WINDOW bytes, and the text as words.

    Stage one sorts the suffixes that are smaller than their successors. Stage two scans the buckets
    of first bytes upwards: a suffix that is not smaller than its successor stands in its bucket in the
    order of its successor, which is placed already, and before the directly sorted ones.
    """
    t = np.concatenate((text, np.zeros(64, np.uint8), np.ones(1, np.uint8), np.zeros(80, np.uint8)))
    n = len(text) + 65
    body = t[:n]
    # The type of a place is that of the last place of its run of equal bytes.
    change = np.flatnonzero(body[1:] != body[:-1])
    run_end = np.concatenate((change, [n - 1]))
    rises = np.concatenate((body[change] < body[change + 1], [False]))
    smaller = np.repeat(rises, np.diff(np.concatenate(([-1], run_end))))
    # Each wanted place needs its successors up to the first that is sorted directly.
    place = np.where(smaller, np.arange(n, dtype=np.int32), np.int32(n))
    next_direct = np.minimum.accumulate(place[::-1])[::-1]
    need = np.zeros(n, bool)
    need[: len(text)] = wanted
    at = np.flatnonzero(need)
    ends = next_direct[at]
    steps = np.zeros(n + 1, np.int32)
    steps[at] = 1
    steps -= np.bincount(np.minimum(ends + 1, n), minlength=n + 1).astype(np.int32)
    need |= np.cumsum(steps)[:n] > 0
    del place, next_direct, steps
    direct = np.flatnonzero(need & smaller).astype(np.int32)
    word = words_at(t)
    direct = sort_directly(word, direct)
    induced = np.flatnonzero(need & ~smaller).astype(np.int32)
    first = body[induced]
    by_bucket = induced[np.argsort(first, kind="stable")]
    cut_l = np.searchsorted(np.sort(first), np.arange(257))
    cut_s = np.searchsorted(body[direct], np.arange(257))
    rank, order, filled = np.full(n + 1, -1, np.int32), np.empty(len(direct) + len(induced), np.int32), 0
    for c in range(256):
        todo = by_bucket[cut_l[c] : cut_l[c + 1]]
        while len(todo):
            known = rank[todo + 1] >= 0
            if not known.any():
                raise AssertionError("a suffix without an ordered successor")
            wave = todo[known]
            wave = wave[np.argsort(rank[wave + 1], kind="stable")]
            order[filled : filled + len(wave)] = wave
            rank[wave] = np.arange(filled, filled + len(wave))
            filled += len(wave)
            todo = todo[~known]
        own = direct[cut_s[c] : cut_s[c + 1]]
        order[filled : filled + len(own)] = own
        rank[own] = np.arange(filled, filled + len(own))
        filled += len(own)
    chosen = np.zeros(n, bool)
    chosen[: len(text)] = wanted
    return order[chosen[order]], word


def reaches(word: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place but the first, whether the common prefix with the one before it in order has WINDOW bytes."""
    first = word[order]
    alive = np.flatnonzero(first[1:] == first[:-1])
    for k in range(8, WINDOW, 8):
        alive = alive[word_of(word, order[alive + 1], k) == word_of(word, order[alive], k)]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[alive] = True
    return out


def cover(boxes: int):
    """Cuttings of a shard to mail with the spans that are covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = Mail(boxes)
        for s, blobs in runs_of_shards(batches):
            if s < 0:
                yield frame(([s], blobs))
                continue
            mail.put(*covered_by(blobs))
            yield from mail.sent(MAIL)
        yield from mail.sent(0)

    return run


def covered_by(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """ids, tags, starts and ends of what the cuttings of a shard show to be covered."""
    parts = [unpacked(b) for b in blobs]
    text, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    ids, tags = np.concatenate([p[4][p[2]] for p in parts]), np.concatenate([p[5][p[2]] for p in parts])
    begin = np.concatenate([p[3] for p in parts]).astype(np.int64)
    del parts
    size = count + WINDOW - 1
    start = np.cumsum(size) - size
    of, at = np.repeat(np.arange(len(count)), count), spread(start, count)
    covered = repeated(text, size, ranks(ids, tags), at)
    first, n = runs(covered[at], np.concatenate(([True], of[1:] != of[:-1])))
    of, first = of[first], at[first]
    first = first - start[of] + begin[of]
    return ids[of], tags[of], first, first + n + WINDOW - 1


def tagged(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """doc_id, tag (a hash of the text that tells rows of one id apart; its last bit: the id is null), and more."""
    id_, data = F.col(doc_id).cast("long"), F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    tag = F.xxhash64(data).bitwiseAND(F.lit(-2)).bitwiseOR(id_.isNull().cast("long"))
    return docs.select(F.coalesce(id_, F.lit(LAST)).alias("doc_id"), tag.alias("tag"), *(more or [data.alias("data")]))


def delivered(rows: DataFrame, mail: DataFrame, boxes: int) -> DataFrame:
    """rows (doc_id, tag and more), packed, and mail (shard, blob), dealt by box and sorted so that a box's mail comes first."""
    texts = rows.mapInArrow(boxed(boxes), "box long, kind int, blob binary")
    letters = mail.where((F.col("shard") < 0) & (F.col("shard") > HOT)).select((-1 - F.col("shard")).alias("box"), F.lit(0).alias("kind"), "blob")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-boxes // 2))
    return texts.unionByName(letters).repartition(tasks, "box").sortWithinPartitions("box", "kind")


def covered_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Mail with the spans to remove, and the number of its boxes."""
    spark = docs.sparkSession
    rows = tagged(docs, doc_id, text).where(F.length("data") >= WINDOW)
    size = rows.agg(F.sum(F.length("data"))).first()[0] or 0
    shards, lots, boxes = (max(16, -(-size // n)) for n in (SHARD_BYTES, CUTTING_BYTES, BOX_BYTES))
    bits = kept_bits(size)

    def by_shard(found: DataFrame, shards: int) -> DataFrame:
        tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 8))
        return found.repartition(tasks, F.xxhash64("shard")).sortWithinPartitions("shard")

    places = staged(by_shard(rows.mapInArrow(first_pass(shards, boxes, bits), ROWS), shards).mapInArrow(find_twins(boxes, bits), ROWS), "places")
    found = delivered(rows, places, boxes).mapInArrow(cut_out(lots, boxes, bits, hot_anchors(places)), ROWS)
    spans = staged(by_shard(found, lots).mapInArrow(cover(boxes), ROWS), "spans")
    discard(places)
    return spans, boxes


def without(data: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, tag, data, found in rows_with_mail(batches):
            a, b = merged(*found) if found else (NOTHING, NOTHING)
            add(out, None if tag & 1 else i, len(data), int((b - a).sum()), len(a), hashlib.sha256(without(data, a, b)).hexdigest())
            if len(out[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                out = ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    spans, boxes = covered_spans(docs, doc_id, text)
    return delivered(tagged(docs, doc_id, text), spans, boxes).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans drawn in to whole UTF-8 characters."""
    a, b = start.tolist(), end.tolist()
    for k in range(len(a)):
        while a[k] < b[k] and data[a[k]] & 0xC0 == 0x80:
            a[k] += 1
        while a[k] < b[k] < len(data) and data[b[k]] & 0xC0 == 0x80:
            b[k] -= 1
    return np.array(a, np.int64), np.array(b, np.int64)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with the repeated passages removed from the text (in whole characters)."""
    names = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in names))  # one column, so that no name can clash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, mail in with_mail(batches):
            row, bodies = dict(zip(names, found.column("row").combine_chunks().flatten(), strict=True)), []
            for i, t, body in zip(found.column("doc_id").to_pylist(), found.column("tag").to_pylist(), row[text].to_pylist(), strict=True):
                spans = mail.get((i, t))
                if body is not None and spans:
                    data = body.encode()
                    body = without(data, *whole_characters(data, *merged(*spans))).decode()
                bodies.append(body)
            row[text] = pa.array(bodies, pa.string())
            yield pa.RecordBatch.from_arrays(list(row.values()), names)

    spans, boxes = covered_spans(docs, doc_id, text)
    return delivered(tagged(docs, doc_id, text, whole.alias("row")), spans, boxes).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: The contract said directly: every 50-byte string of every document, and the least document that holds it.
SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, coalesce(doc_id, {LAST}) AS doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS MATERIALIZED (SELECT r, doc_id, b, octet_length(b)::BIGINT AS n FROM texts),
windows AS MATERIALIZED (SELECT r, doc_id, p, b[p + 1:p + {WINDOW}] AS s FROM (SELECT r, doc_id, b, unnest(range(0, n - {WINDOW - 1})) AS p FROM sized WHERE n >= {WINDOW})),
least_doc AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
hits AS (SELECT r, p FROM windows JOIN least_doc USING (s) WHERE first < doc_id),
marked AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + {WINDOW}, true) AS new FROM hits),
runs AS (SELECT r, p, sum(new::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM marked),
spans AS MATERIALIZED (SELECT r, k, min(p) AS a, max(p) + {WINDOW} AS e FROM runs GROUP BY r, k),
totals AS (SELECT r, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
edges AS (SELECT r, 0 AS a, 0 AS e FROM sized UNION ALL SELECT r, a, e FROM spans),
kept AS (SELECT r, e AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY e, a), n) AS z, b FROM edges JOIN sized USING (r)),
bodies AS (SELECT r, string_agg(CASE WHEN z > a THEN hex(b[a + 1:z]) ELSE '' END, '' ORDER BY a, z) AS body FROM kept GROUP BY r)
SELECT nullif(doc_id, {LAST}) AS doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(body)) AS kept_sha256
FROM sized JOIN bodies USING (r) LEFT JOIN totals USING (r)
"""
