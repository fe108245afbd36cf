"""Trees as adjacency lists with materialised ancestors: paths, roll-ups, inheritance.

ancestors (the ids from the root to the parent) turns each recursive walk into one explode and one
aggregation with map-side partial sums. It is computed once, by pointer doubling over the folders
alone: as many joins as the logarithm of the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.operators.staging import staged

#: Doublings that are tried; more means a cycle (or a tree of a depth beyond 2**MAX_DOUBLINGS).
MAX_DOUBLINGS = 12


def with_ancestors(nodes: DataFrame, node_id: str = "item_id", parent_id: str = "parent_id", is_folder: Column | None = None) -> DataFrame:
    """Adds ancestors and depth. is_folder tells which nodes can be parents (default: all). A parent that is no node ends the chain there."""
    folders = nodes.where(is_folder) if is_folder is not None else nodes
    known = folders.select(F.col(node_id).alias("_id"))
    chain = folders.select(F.col(node_id).alias("id"), F.col(parent_id).alias("top")).join(known, F.col("top") == F.col("_id"), "left")
    chain = chain.select("id", F.col("_id").alias("top"), F.when(F.col("_id").isNull(), F.array().cast("array<bigint>")).otherwise(F.array(F.col("_id").cast("bigint"))).alias("up"))
    for _ in range(MAX_DOUBLINGS):
        if chain.where("top is not null").isEmpty():
            break
        above = chain.select(F.col("id").alias("_id"), F.col("top").alias("_top"), F.col("up").alias("_up"))
        chain = chain.join(above, F.col("top") == F.col("_id"), "left")
        chain = chain.select("id", F.col("_top").alias("top"), F.concat(F.coalesce("_up", F.array().cast("array<bigint>")), "up").alias("up"))
        chain = staged(chain, "ancestors")
    else:
        raise ValueError("the parents form a cycle")
    chains = chain.select(F.col("id").alias("_id"), F.concat("up", F.array(F.col("id").cast("bigint"))).alias("_chain"))
    out = nodes.drop("ancestors", "depth").join(chains, F.col(parent_id) == F.col("_id"), "left")
    out = out.withColumn("ancestors", F.coalesce("_chain", F.array().cast("array<bigint>"))).drop("_id", "_chain")
    return out.withColumn("depth", F.size("ancestors"))


def rollup(items: DataFrame, is_leaf: Column, value: str = "length", node_id: str = "item_id", parent_id: str = "parent_id") -> DataFrame:
    """Per node that holds something: direct_count, direct_size, subtree_count, subtree_size of the leaves below it.

    Leaves are summed by parent first (all of one parent have the same ancestors); only these sums walk up.
    """
    sums = items.where(is_leaf).groupBy(F.col(parent_id).alias("own"), "ancestors").agg(F.count("*").alias("n"), F.sum(value).alias("size"))
    return walked_up(sums, node_id)


def walked_up(sums: DataFrame, node_id: str) -> DataFrame:
    """The sums (own, ancestors, n, size) of each folder, added to it and to every folder above it."""
    steps = sums.select("own", "n", "size", F.explode("ancestors").alias(node_id))
    own = F.col("own") == F.col(node_id)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return steps.groupBy(node_id).agg(
        total(F.when(own, F.col("n"))).alias("direct_count"),
        total(F.when(own, F.col("size"))).alias("direct_size"),
        total(F.col("n")).alias("subtree_count"),
        total(F.col("size")).alias("subtree_size"),
    )


def file_rollup(items: DataFrame) -> DataFrame:
    """Sizes and counts of files below each folder and volume. An archive counts once, as a file; what is in it doesn't."""
    archives = items.where("is_container and kind = 'File'").select(F.col("item_id").alias("_archive"))
    inside = items.where("kind = 'File'").select("item_id", "parent_id", "length", "ancestors", F.explode_outer("ancestors").alias("_a"))
    held = inside.join(archives, F.col("_a") == F.col("_archive"), "left_semi").select("item_id").distinct()
    files = items.where("kind = 'File'").join(held, "item_id", "left_anti")
    return rollup(files, F.lit(True))


def paths(nodes: DataFrame, separator: str = "\\", node_id: str = "item_id", name: str = "name") -> DataFrame:
    """node_id and path_and_name: the names from the root down to the node."""
    own = nodes.select(F.col(node_id).alias("id"), name, "ancestors")
    steps = own.select("id", F.posexplode(F.concat("ancestors", F.array(F.col("id").cast("bigint")))).alias("at", "node"))
    names = own.select(F.col("id").alias("node"), F.col(name).alias("part"))
    parts = steps.join(names, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return parts.select(F.col("id").alias(node_id), F.concat_ws(separator, F.transform("parts", lambda p: p["part"])).alias("path_and_name"))


def inside(nodes: DataFrame, is_mark: Column, node_id: str = "item_id") -> DataFrame:
    """node_id, self_or_below and strictly_below: whether the node or an ancestor (only an ancestor) is marked."""
    marks = nodes.where(is_mark).select(F.col(node_id).alias("_mark")).distinct()
    steps = nodes.select(F.col(node_id).alias("id"), F.explode(F.concat("ancestors", F.array(F.col(node_id).cast("bigint")))).alias("_node"))
    hits = steps.join(marks, F.col("_node") == F.col("_mark")).groupBy("id").agg(F.max(F.col("_node") != F.col("id")).alias("strict"))
    out = nodes.select(F.col(node_id).alias("_id")).join(hits, F.col("_id") == F.col("id"), "left")
    return out.select(F.col("_id").alias(node_id), F.col("id").isNotNull().alias("self_or_below"), F.coalesce("strict", F.lit(False)).alias("strictly_below"))


def subtree(nodes: DataFrame, roots: list[int], node_id: str = "item_id") -> DataFrame:
    """The roots with all that lies below them."""
    ids = F.array(*(F.lit(r).cast("bigint") for r in roots))
    return nodes.where(F.col(node_id).isin(roots) | F.arrays_overlap("ancestors", ids)) if roots else nodes.limit(0)


def preorder_key(items: DataFrame, node_id: str = "item_id") -> DataFrame:
    """node_id and an array that sorts as a walk does: a folder, then its sub-folders with what they hold, then its files."""
    own = items.select(F.col(node_id).alias("id"), "ancestors", "name", (F.col("kind") == "File").cast("int").alias("is_file"))
    steps = own.select("id", F.posexplode(F.concat("ancestors", F.array(F.col("id").cast("bigint")))).alias("at", "node"))
    levels = own.select(F.col("id").alias("node"), F.struct("is_file", "name", "id").alias("level"))
    keys = steps.join(levels, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "level"))).alias("k"))
    return keys.select(F.col("id").alias(node_id), F.transform("k", lambda x: x["level"]).alias("preorder"))
