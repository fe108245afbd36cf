"""Logical folders: a tree of user-defined folders, and the bag of items that are attached to them.

Every change is a function from tables to new tables. Ids of new folders continue after the largest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.operators.staging import numbered
from shelfmark.operators.tree import inside, subtree, walked_up, with_ancestors
from shelfmark.schema import FOLDER_TYPES, LOGICAL_FOLDERS, conform

DISC, GENERAL, CATALOGUE = "Disc", "GeneralFolder", "DiscCatalog"


def type_number(folder_type: Column) -> Column:
    """A type's number, in the fixed order of types."""
    return F.array_position(F.array(*map(F.lit, FOLDER_TYPES)), folder_type).cast("int") - 1


def child_type(parent_type: Column) -> Column:
    """What a new folder under a parent is: a disc under a catalogue, a general folder under a disc, else as the parent."""
    return F.when(parent_type == CATALOGUE, DISC).when(parent_type == DISC, GENERAL).otherwise(parent_type)


def members(items: DataFrame, tags: DataFrame, folders: DataFrame) -> DataFrame:
    """A row per tag: the item's columns and folder_id, folder_name, folder_type."""
    named = folders.select("folder_id", F.col("name").alias("folder_name"), "folder_type")
    return items.join(tags, "item_id").join(named, "folder_id")


def is_member(items: DataFrame, tags: DataFrame, folder_id: int) -> DataFrame:
    return items.join(tags.where(F.col("folder_id") == folder_id), "item_id", "left_semi")


def add_items(tags: DataFrame, added: DataFrame, distinct: bool = False) -> DataFrame:
    """tags and the added rows; distinct adds only what isn't there yet, once."""
    added = added.select("item_id", "folder_id")
    if distinct:
        added = added.distinct().join(tags, ["item_id", "folder_id"], "left_anti")
    return tags.unionByName(added)


def remove_items(tags: DataFrame, removed: DataFrame) -> DataFrame:
    """One tag less for each removed row."""
    return tags.exceptAll(removed.select("item_id", "folder_id"))


def folder_sizes(folders: DataFrame, tags: DataFrame, items: DataFrame, distinct: bool = False) -> DataFrame:
    """folder_id, size, direct_count, subtree_count: what is tagged in each folder and below. An item that is tagged twice counts twice unless distinct."""
    tree = with_ancestors(folders, "folder_id").select("folder_id", F.concat("ancestors", F.array("folder_id")).alias("ancestors"))
    bag = tags.distinct() if distinct else tags
    held = bag.join(items.select("item_id", "length"), "item_id").groupBy(F.col("folder_id").alias("own")).agg(F.count("*").alias("n"), F.sum("length").alias("size"))
    sums = walked_up(held.join(tree, F.col("own") == F.col("folder_id")).drop("folder_id"), "folder_id")
    out = folders.select("folder_id").join(sums, "folder_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return out.select("folder_id", zero(F.col("subtree_size")).alias("size"), zero(F.col("direct_count")).alias("direct_count"), zero(F.col("subtree_count")).alias("subtree_count"))


def part_of_disc(folders: DataFrame) -> DataFrame:
    """folder_id, is_part_of_disc (itself or an ancestor is a disc), is_folder_of_disc (an ancestor is)."""
    found = inside(with_ancestors(folders, "folder_id"), F.col("folder_type") == DISC, "folder_id")
    return found.select("folder_id", F.col("self_or_below").alias("is_part_of_disc"), F.col("strictly_below").alias("is_folder_of_disc"))


def name_clashes(folders: DataFrame) -> DataFrame:
    """parent_id, name (lower case), n: sibling names that occur more than once inside a disc."""
    held = part_of_disc(folders).where("is_part_of_disc").select(F.col("folder_id").alias("_disc"))
    kids = folders.join(held, F.col("parent_id") == F.col("_disc"), "left_semi")
    return kids.groupBy("parent_id", F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def valid_name(taken: list[str], name: str) -> str:
    """name, or the first of 'name (1)', 'name (2)', ... that no sibling has, whatever the case."""
    low = {t.lower() for t in taken}
    if name.lower() not in low:
        return name
    i = 1
    while f"{name} ({i})".lower() in low:
        i += 1
    return f"{name} ({i})"


def numbered_names(rows: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """Adds unique_name: the first of equal names in a group keeps it, the next get ' (1)', ' (2)', ... by order. No name may end so already."""
    key = [*group, "_low"]
    placed = numbered(rows.withColumn("_low", F.lower(name)), [*key, *order], "_place")
    first = placed.groupBy(*(F.col(c).alias(f"_of_{i}") for i, c in enumerate(key))).agg(F.min("_place").alias("_first"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(key)))
    n = F.col("_place") - F.col("_first")
    unique = F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n, F.lit(")")))
    return placed.join(first, same).select(*rows.columns, unique.alias("unique_name"))


def _one(folders: DataFrame, folder_id: int):
    row = folders.where(F.col("folder_id") == folder_id).first()
    if row is None:
        raise ValueError(f"no folder {folder_id}")
    return row


def _next_id(folders: DataFrame) -> int:
    return (folders.agg(F.max("folder_id")).first()[0] or 0) + 1


def add_folder(folders: DataFrame, name: str, parent_id: int | None = None, folder_type: str | None = None, max_size: int = 0) -> DataFrame:
    """folders with a new one. Inside a disc only general folders with names of their own are allowed; the type follows the parent's if not given."""
    spark = folders.sparkSession
    if parent_id is not None:
        parent = _one(folders, parent_id)
        default = spark.range(1).select(child_type(F.lit(parent.folder_type))).first()[0]
        kind = folder_type or default
        disc = part_of_disc(folders).where(F.col("folder_id") == parent_id).first()
        if disc.is_part_of_disc:
            if kind != GENERAL:
                raise ValueError("Only general folders can be added to a disc.")
            taken = folders.where((F.col("parent_id") == parent_id) & (F.lower("name") == name.lower()))
            if not taken.isEmpty():
                raise ValueError(f"The disc has a folder {name!r} there already.")
    else:
        kind = folder_type or GENERAL
    row = spark.createDataFrame([(_next_id(folders), parent_id, name, kind, 0, max_size, None)], LOGICAL_FOLDERS)
    return conform(folders, LOGICAL_FOLDERS).unionByName(row)


def remove_folder(folders: DataFrame, tags: DataFrame, folder_id: int) -> tuple[DataFrame, DataFrame]:
    """folders and tags without the folder, what lies below it, and their tags."""
    gone = subtree(with_ancestors(folders, "folder_id"), [folder_id], "folder_id").select("folder_id")
    return folders.join(gone, "folder_id", "left_anti"), tags.join(gone, "folder_id", "left_anti")


def edit_folder(folders: DataFrame, folder_id: int, name: str | None = None, max_size: int | None = None, description: str | None = None) -> DataFrame:
    """folders with changed properties. Inside a disc a name must differ from its siblings'; only discs have a size."""
    row, here = _one(folders, folder_id), F.col("folder_id") == folder_id
    if name is not None and row.parent_id is not None:
        others = folders.where(F.col("folder_id") != folder_id).unionByName(folders.where(here).withColumn("name", F.lit(name)))
        if not name_clashes(others).where((F.col("parent_id") == row.parent_id) & (F.col("name") == name.lower())).isEmpty():
            raise ValueError(f"The disc has a folder {name!r} there already.")
    if max_size is not None and row.folder_type != DISC:
        raise ValueError("Only discs have a size.")
    for column, value in (("name", name), ("max_size", max_size), ("description", description)):
        if value is not None:
            folders = folders.withColumn(column, F.when(here, F.lit(value)).otherwise(F.col(column)))
    return folders


def add_physical_folder(folders: DataFrame, tags: DataFrame, items: DataFrame, item_id: int, parent_id: int, as_name: str | None = None, as_disc: bool = False) -> tuple[DataFrame, DataFrame]:
    """folders and tags with a physical folder's tree as logical folders, its files tagged.

    Archives are files, and what is in them stays out. The root is a disc, or takes its type from the
    parent; each folder below takes its type from the one above it. items need ancestors.
    """
    parent = _one(folders, parent_id)
    archives = items.where("is_container and kind = 'File'").select(F.col("item_id").alias("_archive"))
    tree = subtree(items, [item_id])
    tree = tree.join(tree.select("item_id", F.explode("ancestors").alias("_a")).join(archives, F.col("_a") == F.col("_archive"), "left_semi").select("item_id").distinct(), "item_id", "left_anti")
    first = _next_id(folders)
    real = tree.where("kind <> 'File'").select("item_id", F.col("parent_id").alias("physical_parent"), "name", "depth")
    ranked = numbered(real, ["depth", "item_id"], "place").withColumn("folder_id", (F.col("place") + first).cast("bigint"))
    ids = ranked.select(F.col("item_id").alias("_physical"), F.col("folder_id").alias("_logical"))
    root_type = DISC if as_disc else items.sparkSession.range(1).select(child_type(F.lit(parent.folder_type))).first()[0]
    top = items.where(F.col("item_id") == item_id).select("depth").first()
    if top is None:
        raise ValueError(f"no item {item_id}")
    kind = F.when(F.col("depth") == top.depth, root_type)
    below = F.lit(root_type)
    for d in range(1, 4):  # a chain of child_type is constant from the second step on
        below = child_type(below)
        kind = kind.when(F.col("depth") == top.depth + d, below)
    kind = kind.otherwise(below)
    is_root = F.col("item_id") == item_id
    new = ranked.join(ids, F.col("physical_parent") == F.col("_physical"), "left").select(
        "folder_id",
        F.when(is_root, F.lit(parent_id)).otherwise(F.col("_logical")).cast("bigint").alias("parent_id"),
        F.when(is_root, F.coalesce(F.lit(as_name), "name")).otherwise(F.col("name")).alias("name"),
        kind.alias("folder_type"),
        F.lit(0).alias("max_size_selected"),
        F.lit(0).cast("bigint").alias("max_size"),
        F.lit(None).cast("string").alias("description"),
    )
    files = tree.where("kind = 'File'").join(ids, F.col("parent_id") == F.col("_physical")).select("item_id", F.col("_logical").alias("folder_id"))
    return conform(folders, LOGICAL_FOLDERS).unionByName(new), add_items(tags, files)


def convert_to_general(folders: DataFrame, tags: DataFrame, items: DataFrame, folder_id: int) -> tuple[DataFrame, DataFrame]:
    """The sub-folders of a folder become general ones without a size; folder items that are tagged in the tree become empty general folders."""
    tree = with_ancestors(folders, "folder_id")
    here = subtree(tree, [folder_id], "folder_id").select("folder_id")
    below = here.where(F.col("folder_id") != folder_id).select("folder_id", F.lit(True).alias("_below"))
    changed = conform(folders, LOGICAL_FOLDERS).join(below, "folder_id", "left")
    changed = changed.withColumn("folder_type", F.when(F.col("_below"), GENERAL).otherwise(F.col("folder_type")))
    changed = changed.withColumn("max_size", F.when(F.col("_below"), F.lit(0).cast("bigint")).otherwise(F.col("max_size"))).drop("_below")
    tagged = tags.join(here, "folder_id", "left_semi").join(items.where("kind = 'Folder'").select("item_id", "name"), "item_id")
    placed = numbered(tagged, ["folder_id", "item_id"], "place")
    new = conform(placed.select((F.col("place") + _next_id(folders)).cast("bigint").alias("folder_id"), F.col("folder_id").alias("parent_id"), "name", F.lit(GENERAL).alias("folder_type"), F.lit(0).cast("bigint").alias("max_size")), LOGICAL_FOLDERS)
    return conform(changed, LOGICAL_FOLDERS).unionByName(new), tags.join(tagged.select("item_id", "folder_id").distinct(), ["item_id", "folder_id"], "left_anti")
