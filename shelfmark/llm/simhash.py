"""Operator 2: SimHash near-duplicates through sharded BK-trees.

Each whole text becomes a fingerprint. Equal fingerprints form a class. Classes that may lie within
the radius are dealt to a common shard; a shard of at most SHARD classes is a BK-tree (children keyed
by integer Hamming distance to the parent), and its members search it along edges within the radius.
A larger shard is split: every tree of SHARD classes is sent to each part of the shard's members. A
shard yields at most one link per member (to the least of its component there), and alternating
stars over tables in the shared folder join the links to components; nothing is collected to the driver,
and no table that grows with the corpus is broadcast.

group() is exact: fingerprints of 64 bits that differ in at most r bits agree on whole blocks of bits,
so each class goes to one shard for every choice of blocks. survivors() looks for texts whose word
shingles are similar by a share of 0.8 or more, which 64-bit fingerprints hold up to 18 bits apart:
it takes 128 bits of each shingle once and deals by MINHASHES minimal shingle hashes (two texts of
similarity 0.8 share none of them with a probability of 0.2**MINHASHES). There the radius, SLACK
standard deviations wide, only finds candidates, by searches in BK-trees as above (a shard has one for each
range of sizes): texts that they join within a shard form a group, to which their texts are sent, and links are pairs of a group whose sets of shingles have that similarity.
Different texts are different members even where their fingerprints are equal.

Null or empty text: fingerprint zero, linked like any other (two empty sets of shingles count as equal). A null doc_id counts after every id: the
row is kept, and its component_id is the least id of its component, null if there is none. Repeated
rows are kept by group(); survivors() keeps one row of them, and of several texts of one id the one with the
least hash. A very long text takes memory for the hashes of its shingles. Tables without rows give none. Other
columns of the input are ignored by group(), and kept by survivors().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.llm.common import discard, staged, table

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Classes of one BK-tree.
SHARD = 4096
#: The blocks of bits that a shard's members share are so chosen that a mean shard stays below this.
MEAN_SHARD = 256
#: For survivors(): words of a shingle, similarity, bits, minimal hashes, and standard deviations that the radius for candidates allows for.
NEAR_SHINGLE, SIMILARITY, NEAR_BITS, MINHASHES, SLACK = 5, 0.8, 128, 8, 6
#: Shingles in one part of a group of candidates; each two parts of a larger group are compared.
PART_SHINGLES = 1 << 20
_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 3, 2**64)) for i in range(MINHASHES)]


def shingle_hashes(text: str | None, k: int, bits: int) -> np.ndarray:
    """The hashes of the k-word shingles, repeats included, as rows of bytes (little-endian)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    digest, size = (xxhash.xxh64_intdigest, 8) if bits == 64 else (xxhash.xxh3_128_intdigest, 16)
    if not words:
        return np.zeros((0, size), np.uint8)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.frombuffer(digest(joined, SEED).to_bytes(size, "little"), np.uint8).reshape(1, size)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    if bits == 64:
        return np.fromiter([digest(joined[a:b], SEED) for a, b in spans], np.uint64, n).view(np.uint8).reshape(n, 8)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(n, 16)[:, ::-1]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the rows."""
    ones = np.zeros(hashes.shape[1] * 8, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, k: int = SHINGLE, bits: int = 64) -> int:
    return majority(shingle_hashes(text, k, bits))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of shingles as sorted numbers, and the rows of the hashes without repeats."""
    found, at = np.unique(np.ascontiguousarray(hashes[:, :8]).view(np.uint64).ravel(), return_index=True)
    return found, hashes[at]


def minima(hashes: np.ndarray) -> list[int]:
    """Minimal shingle hashes under MINHASHES orders; empty texts share one key."""
    if not len(hashes):
        return [0]
    u = np.ascontiguousarray(hashes[:, :8]).view(np.uint64).ravel()
    u = u ^ (u >> np.uint64(31))
    found = []
    for i, m in enumerate(_ODD):
        x = u * m
        x ^= x >> np.uint64(32)
        found.append(int((x * _ODD[i - 1]).min() ^ m) - 2**63)
    return found


def fingerprints(docs: DataFrame, k: int = SHINGLE, bits: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (big-endian bytes), and for wide fingerprints the keys of the shards and a hash of the text.

    A wide fp is that of the set of shingles, followed by the hash of the text (8 bytes) and the size of the set (4 bytes).
    """
    wide = bits > 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keys = [], []
            for i, t in enumerate(batch.column(1)):
                h = shingle_hashes(t.as_py(), k, bits)
                if wide:
                    h = distinct(h)[1]
                    keys.append(minima(h))
                more = batch.column(2)[i].as_py().to_bytes(8, "big", signed=True) + len(h).to_bytes(4, "big") if wide else b""
                found.append(majority(h).to_bytes(bits // 8, "big") + more)
            more = [pa.array(keys, pa.list_(pa.int64())), batch.column(2)] if wide else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *more], ["doc_id", "fp", *(["keys", "tag"] if wide else [])])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.xxhash64(text).alias("tag")] if wide else []))
    return rows.mapInArrow(run, "doc_id long, fp binary" + ", keys array<long>, tag long" * wide)


class BKTree:
    """Values by Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parents: list[int] = []

    def add(self, value: int) -> int:
        """The place of the value."""
        at, values, children = -1, self.values, self.children
        if values:
            at = 0
            while True:
                d = (values[at] ^ value).bit_count()
                if d == 0:
                    return at
                below = children[at].get(d)
                if below is None:
                    children[at][d] = len(values)
                    break
                at = below
        values.append(value)
        children.append({})
        self.parents.append(at)
        return len(values) - 1

    def within(self, value: int, radius: int, live: list[int] | None = None) -> Iterator[int]:
        """Places of the values at most radius away; only edges from d - radius to d + radius are followed, and of those none to a place where live is 0."""
        if not self.values:
            return
        todo, values, children = [0], self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            for e, c in children[at].items():
                if d - radius <= e <= d + radius and (live is None or live[c]):
                    todo.append(c)


def links_of_shard(trees: list[int], others: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links (least, other) that join the components of a shard: among trees, or from others to trees."""
    tree, values = BKTree(), trees + (others or [])
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[a if values[a] > values[b] else b] = b if values[a] > values[b] else a

    for i, v in enumerate(trees):
        if others is None:
            for j in tree.within(v, radius):
                join(i, j)
        tree.add(v)
    for i, v in enumerate(others or [], len(trees)):
        for j in tree.within(v, radius):
            join(i, j)
    return [(values[r], v) for i, v in enumerate(values) if (r := find(i)) != i]


def spread(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[list[tuple[int, int]]]:
    """Of the components of n members that have two or more, the links of a tree; near(i, rest) tells which of rest i is linked to."""
    rest, trees = np.arange(n), []
    while len(rest) > 1:
        todo, rest, tree = [int(rest[0])], rest[1:], []
        while todo and len(rest):
            i = todo.pop()
            hit = near(i, rest)
            found = rest[hit].tolist()
            tree += [(i, j) for j in found]
            todo += found
            rest = rest[~hit]
        if tree:
            trees.append(tree)
    return trees


def near_by_bits(members: list[bytes], radius: int, similarity: float) -> tuple[np.ndarray, Callable[[int, np.ndarray], np.ndarray]]:
    """The sizes of the sets of shingles, and which members are candidates: wide fingerprints within the radius, and sizes that allow the similarity."""
    raw = np.frombuffer(b"".join(members), np.uint8).reshape(len(members), -1)
    a, b = np.ascontiguousarray(raw[:, :16]).view(np.uint64).T.copy()
    sizes = np.ascontiguousarray(raw[:, 24:]).view(">u4").ravel().astype(np.int64)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        n = sizes[rest]
        bits = np.bitwise_count(a[rest] ^ a[i]) + np.bitwise_count(b[rest] ^ b[i])
        return (bits <= radius) & (np.minimum(n, sizes[i]) >= similarity * np.maximum(n, sizes[i]))

    return sizes, near


def joined_by_trees(kinds: list[tuple[int, int]], radius: int, similarity: float) -> list[list[int]]:
    """The components of the kinds (size, fingerprint; sorted): BK-trees find those within the radius whose sizes allow the similarity.

    A tree holds sizes up to its least by the similarity, so that each kind searches its own tree, the one before and the one after.
    What is found leaves its tree, and branches without any left are not followed: a large group is not searched by all its pairs.
    """
    trees: list[tuple[BKTree, list[list[int]], list[int]]] = []
    places, least = [], -1.0
    for i, (size, value) in enumerate(kinds):
        if size > least / similarity:
            least = size
            trees.append((BKTree(), [], []))
        tree, held, live = trees[-1]
        at = tree.add(value)
        if at == len(held):
            held.append([])
            live.append(0)
        held[at].append(i)
        places.append((len(trees) - 1, at))
        while at >= 0:
            live[at] += 1
            at = tree.parents[at]

    def leave(i: int) -> int:
        tree, held, live = trees[places[i][0]]
        at = places[i][1]
        held[at].remove(i)
        while at >= 0:
            live[at] -= 1
            at = tree.parents[at]
        return i

    found, done = [], [False] * len(kinds)
    for i in reversed(range(len(kinds))):  # from the leaves, so that branches empty early
        if done[i]:
            continue
        todo, joined = [leave(i)], [i]
        while todo:
            k = todo.pop()
            done[k] = True
            size, value = kinds[k]
            for tree, held, live in trees[max(0, places[k][0] - 1) : places[k][0] + 2]:
                for at in tree.within(value, radius, live):
                    near = [leave(j) for j in held[at][:] if min(kinds[j][0], size) >= similarity * max(kinds[j][0], size)]
                    todo += near
                    joined += near
        found.append(joined)
    return found


def candidates_of_shard(trees: list[int], others: list[int] | None, radius: int, similarity: float) -> list[tuple[int, int]]:
    """(group, member) of the groups that candidate links join in a shard. A group is named by a hash of its members, so that the shards that find it agree."""
    width = NEAR_BITS // 8
    members = sorted(v.to_bytes(width + 12, "big") for v in trees + (others or []))
    sizes = np.array([int.from_bytes(m[width + 8 :], "big") for m in members], np.int64)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, m in enumerate(members):
        alike.setdefault((int(sizes[i]), int.from_bytes(m[:width], "big")), []).append(i)
    kinds, found = sorted(alike), []
    for joined in joined_by_trees(kinds, radius, similarity):
        at = np.sort([i for k in joined for i in alike[kinds[k]]])
        if len(at) < 2:
            continue
        part = np.cumsum(sizes[at]) // PART_SHINGLES
        parts = [at[part == p].tolist() for p in np.unique(part)]
        for group in [x + y for x, y in combinations(parts, 2)] or parts:
            name = xxhash.xxh3_128_intdigest(b"".join(members[i] for i in group))
            found += [(name, int.from_bytes(members[i], "big")) for i in group]
    return found


def links_of_group(members: list[bytes], sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that join the components of a group, each between two members whose sets of shingles have the similarity."""
    sizes, close = near_by_bits(members, radius, similarity)
    vocabulary, places = np.unique(np.concatenate(sets), return_inverse=True)
    places, marked = np.split(places, np.cumsum(sizes)[:-1]), np.zeros(len(vocabulary), bool)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        hit = close(i, rest)
        at = rest[hit]
        if len(at):
            marked[places[i]] = True
            sums = np.concatenate(([0], np.cumsum(marked[np.concatenate([places[j] for j in at])])))
            marked[places[i]] = False
            ends = np.cumsum(sizes[at])
            shared = sums[ends] - sums[ends - sizes[at]]
            hit[hit] = shared >= similarity * (sizes[i] + sizes[at] - shared)
        return hit

    return [(members[i], members[j]) for tree in spread(len(members), near) for i, j in tree]


def masks(n: int, radius: int) -> list[int]:
    """Masks of the bits that shards share: every choice of blocks on which two fingerprints within the radius must agree for one choice at least.

    More blocks, and so more choices with more bits each, as the classes grow: a mean shard stays under MEAN_SHARD.
    """
    for blocks in range(radius + 1, radius + 5):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        choices = [sum(c) for c in combinations(single, blocks - radius)]
        if n >> min(m.bit_count() for m in choices) <= MEAN_SHARD:
            break
    return choices


def block_keys(classes: DataFrame, n: int, radius: int) -> DataFrame:
    """key, fp: a row for each of the shards that a 64-bit fingerprint is dealt to."""
    chosen = [np.uint64(m) for m in masks(n, radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").astype(np.uint64)
            for i, m in enumerate(chosen):
                key = (fp & m) * _ODD[0] + np.uint64(i) * _ODD[1]
                key = (key ^ (key >> np.uint64(32))) * _ODD[2]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, fp binary")


def merged(left: DataFrame, right: DataFrame, on: Column | str, how: str = "inner") -> DataFrame:
    """A join by sorting both sides. Both grow with the corpus, and files of 10 MB (Spark's default) hold over a million classes, whose hash table the driver would have to build to broadcast it."""
    return left.join(right.hint("merge"), on, how)


def links(rows: DataFrame, radius: int, of_shard: Callable[[list[int], list[int] | None, int], list[tuple[int, int]]] = links_of_shard) -> DataFrame:
    """Links a < b between fingerprints that share a key (columns key, fp, without repeats): they join what lies within the radius. Or the pairs a, b that of_shard makes of each shard."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key"), F.ceil(F.col("n") / SHARD).cast("int").alias("parts"))
    rows = merged(rows, sizes, F.col("key") == F.col("_key"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.select("key", "fp", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                cols = [*(np.asarray(batch.column(c)) for c in range(4)), np.array([int.from_bytes(x, "big") for x in batch.column(4).to_pylist()], object)]
                size = len(batch.column(4)[0].as_py()) if batch.num_rows else 8
                rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            key, i, j, part, fp = rest
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cuts = [0, *new.tolist(), *([len(key)] if batch is None else [])]
            found: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                values = fp[a:b].tolist()
                if i[a] == j[a]:
                    found += of_shard(values, None, radius)
                else:
                    cut = int((part[a:b] == i[a]).sum())
                    found += of_shard(values[:cut], values[cut:], radius)
            rest = [c[cuts[-1] :] for c in rest]
            sides = [pa.array([p[k].to_bytes(size, "big") for p in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(sides, ["a", "b"])

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "part", "fp")
    return dealt.mapInArrow(run, "a binary, b binary")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node) for every node of the links a, b, by alternating stars until all are: each v has one u, and no u is a v."""
    edges = staged(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
    while not is_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = merged(both, least, F.col("u") == F.col("k")).where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # Now each v may have several smaller u: all hang on the least of them.
        small = large.groupBy(F.col("v").alias("k")).agg(F.min("u").alias("m"))
        hung = merged(large, small, F.col("v") == F.col("k"))
        before, edges = edges, staged(hung.select(F.col("m").alias("u"), "v").union(hung.where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct(), "links")
        discard(before)
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)


def is_stars(edges: DataFrame) -> bool:
    """Whether each v of the distinct links u < v has one u, and no u is a v."""
    sides = edges.select(F.col("v").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("u", F.lit(0), F.lit(1)))
    return sides.groupBy("node").agg(F.sum("below").alias("n"), F.max("above").alias("m")).where("n > 1 or (n > 0 and m > 0)").isEmpty()


def rooted(classes: DataFrame, found: DataFrame) -> DataFrame:
    """classes (fp, ...) with the root of each one's component."""
    return staged(merged(classes, found, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node"), "roots")


def group(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, fp, component_id (the least doc_id reachable over links of 64-bit fingerprints)."""
    rows = staged(fingerprints(docs, k, 64, doc_id, text), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    known = rooted(classes, components(links(block_keys(classes, classes.count(), radius), radius)))
    least = known.groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("component_id"))
    label = merged(known, least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    return merged(rows, label, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def near_radius(similarity: float = SIMILARITY, bits: int = NEAR_BITS) -> int:
    """Bits by which fingerprints of texts with this Jaccard similarity differ on average, and SLACK standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + SLACK * math.sqrt(bits * share * (1 - share)))


def verified(groups: DataFrame, docs: DataFrame, k: int, radius: int, similarity: float, text: str = "text") -> DataFrame:
    """Links a, b between the members of groups (columns a: group, b: member) whose texts have the similarity. A text goes to each group that it is in."""
    tag = F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
    member = groups.select(F.col("a").alias("group"), F.col("b").alias("member"), F.substring("b", NEAR_BITS // 8 + 1, 8).alias("tag"))
    wanted = merged(docs.select(tag.alias("_tag"), F.col(text).alias("text")), member.select(F.col("tag").alias("_tag")).distinct(), "_tag", "left_semi")
    rows = merged(member, wanted.groupBy("_tag").agg(F.first("text").alias("text")), F.col("tag") == F.col("_tag")).select("group", "member", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, sets = None, [], []
        for batch in _with_end(batches):
            found: list[tuple[bytes, bytes]] = []
            for g, m, t in [(None, None, None)] if batch is None else zip(*batch.columns, strict=True):
                g = g and g.as_py()
                if g != group:
                    if members:
                        found += links_of_group(members, sets, radius, similarity)
                    group, members, sets = g, [], []
                if g is not None:
                    members.append(m.as_py())
                    sets.append(distinct(shingle_hashes(t.as_py(), k, NEAR_BITS))[0])
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("group").sortWithinPartitions("group", "member").mapInArrow(run, "a binary, b binary")


def survivors(docs: DataFrame, k: int = NEAR_SHINGLE, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one row (the least doc_id, null last) of each group of near copies."""
    last = F.lit(2**63 - 1)
    rows = staged(fingerprints(docs, k, NEAR_BITS, doc_id, text), "fingerprints")
    first = F.min(F.struct(F.coalesce("doc_id", last).alias("id"), F.col("tag").alias("tag"))).alias("first")
    classes = staged(rows.groupBy("fp").agg(first, F.first("keys").alias("keys")), "classes")
    dealt = classes.select(F.explode(F.array_distinct("keys")).alias("key"), "fp")
    radius = near_radius(similarity)
    groups = staged(links(dealt, radius, partial(candidates_of_shard, similarity=similarity)).distinct(), "candidates")
    known = rooted(classes, components(verified(groups, docs, k, radius, similarity, text)))
    chosen = known.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("_keep_id"), F.col("first.tag").alias("_keep_tag"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # one column, so that no name can clash
    keyed = docs.select(whole.alias("row"), F.coalesce(F.col(doc_id).cast("long"), last).alias("id"), F.xxhash64(text).alias("tag"))
    kept = merged(keyed, chosen, (F.col("id") == F.col("_keep_id")) & (F.col("tag") == F.col("_keep_tag")), "left_semi")
    return kept.dropDuplicates(["id", "tag"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
