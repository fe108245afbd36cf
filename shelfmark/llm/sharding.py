"""Operator 6: sharding by a hierarchical weighted hash tree (law: key).

A document descends region, rack and shard levels. At each node every child draws -ln(u) / weight,
with u from a hash of the document's id and the child's name; the least draw wins. A child's draw
doesn't depend on its siblings, so when weights change, only documents that enter or leave the
changed subtree move. A shard that is added to the layout gets a region and a rack of its own, so it
takes documents only into itself.

Null text: size 16, crc32 of no bytes. Null ids share one shard. Rows with equal ids
share a shard. Slots number a shard's rows from 0 by a hash block and then by doc_id, crc and size.
Tables without rows give none; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.llm.common import gapless, staged, table

#: Bytes that a row needs beside its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Node:
    """A shard (no children) or a region, a rack or the root. name enters the hash; number is a shard's."""

    name: str
    children: tuple[Node, ...] = ()
    number: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards()] if self.children else [self.number]


def layout(n_shards: int, regions: int = 2, racks: int = 4) -> Node:
    """n_shards equal shards over regions x racks, dealt out evenly in order."""
    per_rack = -(-n_shards // (regions * racks))
    shards = [Node(f"shard-{i}", number=i) for i in range(n_shards)]
    groups = [tuple(shards[i : i + per_rack]) for i in range(0, n_shards, per_rack)]
    rack_nodes = [Node(f"rack-{i}", g) for i, g in enumerate(groups)]
    return Node("root", tuple(Node(f"region-{i}", tuple(rack_nodes[i * racks : (i + 1) * racks])) for i in range(-(-len(rack_nodes) // racks))))


def grown(tree: Node) -> Node:
    """tree with one more shard, in a region and a rack of its own."""
    n = max(tree.shards()) + 1
    return replace(tree, children=(*tree.children, Node(f"region-of-{n}", (Node(f"rack-of-{n}", (Node(f"shard-{n}", number=n),)),))))


def draw(key: Column, name: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, name), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(u) / weight


def least(draws: list[Column]) -> Column:
    """The place of the least draw that isn't null."""
    return F.array_min(F.filter(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(draws))), lambda x: x["d"].isNotNull()))["i"]


def descend(rows: DataFrame, tree: Node, key: str, out: str) -> DataFrame:
    """Adds the shard's number, level by level; each level draws only among the children of the node that was taken.

    The names and weights of a level's nodes are literal arrays, of the size of the tree.
    """
    at, level = f"_{out}_at", [tree]
    rows = rows.withColumn(at, F.lit(0))
    while any(n.children for n in level):
        wide = max(len(n.children) for n in level)
        below = [c for n in level for c in n.children]
        ids = iter(range(len(below)))
        slots = [(next(ids), c) if c else (None, None) for n in level for c in (*n.children, *[None] * (wide - len(n.children)))]
        names = F.array(*(F.lit(c.name if c else None).cast("string") for _, c in slots))
        weights = F.array(*(F.lit(float(c.weight) if c else None).cast("double") for _, c in slots))
        nodes = F.array(*(F.lit(i).cast("int") for i, _ in slots))
        first = F.col(at) * wide
        rows = rows.withColumn(f"{at}_pick", least([draw(F.col(key), F.get(names, first + k), F.get(weights, first + k)) for k in range(wide)]))
        rows = rows.withColumn(at, F.get(nodes, first + F.col(f"{at}_pick"))).drop(f"{at}_pick")
        level = below
    return rows.withColumn(out, F.get(F.array(*(F.lit(n.number) for n in level)), F.col(at)).cast("int")).drop(at)


def assign(docs: DataFrame, tree: Node, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = descend(descend(rows, tree, "doc_id", "shard"), grown(tree), "doc_id", "grown_shard")
    rows = staged(rows, "shards")
    out = gapless(rows, "shard", ["doc_id", "text_crc32", "size"], "slot", rows.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), layout(40))
