"""Scanning a volume again: what is known of its items is carried over, and the old volume goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.scalars import joined, options_text
from shelfmark.operators.setops import remove_volume


def relative_path(items: DataFrame, separator: str = "\\") -> DataFrame:
    """Adds rel_path: the names below the volume's root, '' for the root. Names are compared as they are, with their case."""
    from shelfmark.operators.tree import paths

    below = F.when(F.instr("path_and_name", separator) > 0, F.substring(F.col("path_and_name"), F.instr("path_and_name", separator) + 1, F.length("path_and_name"))).otherwise("")
    return items.join(paths(items, separator).select("item_id", below.alias("rel_path")), "item_id")


def carry_over(new: DataFrame, old: DataFrame, on: list[str] | None = None, columns: tuple[str, ...] = ("keywords", "description")) -> DataFrame:
    """new, with the columns of the old item at the same place and kind, and its id as old_item_id (null for new items).

    Equal relative paths are equal names all the way down, so one join finds what a walk through both
    trees would. Several old rows at one place: the least id counts.
    """
    keys, columns = on or ["rel_path", "kind"], tuple(c for c in columns if c in old.columns)
    best = old.groupBy(*keys).agg(F.min(F.struct("item_id", *columns)).alias("_old"))
    found = new.join(best, keys, "left")
    for c in columns:
        found = found.withColumn(c, F.coalesce(F.nullif(F.col("_old")[c], F.lit("")), F.col(c)) if c in new.columns else F.col("_old")[c])
    return found.withColumn("old_item_id", F.col("_old")["item_id"]).drop("_old")


def carried_tags(matched: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of the old items, on the new ones."""
    pairs = matched.where("old_item_id is not null").select(F.col("item_id").alias("_new"), F.col("old_item_id").alias("item_id"))
    return pairs.join(tags, "item_id").select(F.col("_new").alias("item_id"), "folder_id")


def merged_texts(new: DataFrame, old: DataFrame, key: str = "volume_id", columns: tuple[str, ...] = ("keywords", "physical_location")) -> DataFrame:
    """new volumes, with their texts behind the old one's (';' between them)."""
    before = old.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = new.join(before, F.col(key) == F.col("_key"), "left")
    for c in columns:
        out = out.withColumn(c, joined(F.col(f"_{c}"), F.col(c))).drop(f"_{c}")
    return out.drop("_key")


def exclude(items: DataFrame, excluded: DataFrame, path: str = "path", separator: str = "/") -> DataFrame:
    """items outside the excluded paths and all that lies below them, whatever the case. excluded: a column path.

    Only the folders' paths, each once, are cut into their own ancestors, so that the join is on equality;
    items then go by their folder's path and by their own. Both lists are broadcast where they are small
    at run time. Items without a path stay.
    """
    gone = excluded.select(F.lower("path").alias("_gone")).where("_gone is not null").distinct()
    whole = F.lower(F.col(path))
    rows = items.withColumn("_whole", whole).withColumn("_folder", F.left(whole, F.length(whole) - F.length(F.substring_index(whole, separator, -1)) - F.lit(len(separator))))
    parts = F.split(F.col("_folder"), F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")), -1)
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    folders = rows.select("_folder").where("_folder <> ''").distinct()
    hit = folders.select(F.col("_folder").alias("_hit"), F.explode(ups).alias("_up")).join(gone, F.col("_up") == F.col("_gone"), "left_semi").select("_hit").distinct()
    left = rows.join(hit, F.col("_folder") == F.col("_hit"), "left_anti").join(gone, F.col("_whole") == F.col("_gone"), "left_anti")
    return left.select(*items.columns)


def is_excluded(path: Column, roots: list[str], separator: str = "/") -> Column:
    """The same for a short list of roots, as a predicate that needs no join."""
    low, found = F.lower(path), F.lit(False)
    for r in roots:
        found = found | (low == r.lower()) | low.startswith(r.lower().rstrip(separator) + separator)
    return found


def checked(paths: DataFrame, clicks: DataFrame, path: str = "path", separator: str = "/") -> DataFrame:
    """paths with a column checked: a tree's nodes after clicks (columns path, checked, at: their order).

    A click holds for its node and all below, until a later one on the way down to a node; nodes that none
    holds for are checked. Of two clicks at one time on one way the deeper counts. What isn't checked is left out
    of a scan. Whatever the case; rows without a path are checked. Each different path is cut once.
    """
    found = clicks.where("path is not null and checked is not null").groupBy(F.lower("path").alias("_clicked")).agg(F.max_by("checked", F.struct("at", ~F.col("checked"))).alias("_state"), F.max("at").alias("_at"))
    parts = F.split(F.col("_low"), F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")), -1)
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    different = paths.select(F.lower(path).alias("_low")).where("_low is not null").distinct()
    held = different.select("_low", F.explode(ups).alias("_up")).join(found, F.col("_up") == F.col("_clicked"))
    states = held.groupBy(F.col("_low").alias("_node")).agg(F.max_by("_state", F.struct("_at", F.length("_up"))).alias("_state"))
    return paths.join(states, F.lower(path) == F.col("_node"), "left").select(*paths.columns, F.coalesce("_state", F.lit(True)).alias("checked"))


def discs_to_replace(volumes: DataFrame) -> DataFrame:
    """What a list of discs to scan again shows: volume_id, name, from_drive, options, scanned; in order of names, then ids."""
    options = options_text(F.col("scanned_crc"), F.col("scanned_file_version"), F.col("scanned_zip"))
    return volumes.select("volume_id", "name", "from_drive", options.alias("options"), "scanned").orderBy(F.lower("name"), "volume_id")


def replace_volume(tables: dict[str, DataFrame], scanned: dict[str, DataFrame], old_volume_id: int | None, folder_ids: tuple[int, ...] = ()) -> dict[str, DataFrame]:
    """The catalogue with a scanned volume (tables items and volumes, with rel_path known by names) in place of the old one, if any.

    Keywords, descriptions and tags go over to items at the same place; the new root gets the chosen
    logical folders. The result is new tables: nothing is changed if anything fails.
    """
    items, tags = scanned["items"], tables["item_tags"]
    new_tags = tags.limit(0)
    volumes = scanned["volumes"]
    if old_volume_id is not None:
        old_items = relative_path(tables["items"].where(F.col("volume_id") == old_volume_id))
        matched = carry_over(relative_path(items), old_items)
        new_tags = carried_tags(matched, tags)
        items = matched.drop("rel_path", "old_item_id")
        old_row = tables["volumes"].where(F.col("volume_id") == old_volume_id).withColumn("volume_id", F.lit(scanned["volumes"].first()["volume_id"]))
        volumes = merged_texts(volumes, old_row)
    roots = items.where("kind = 'Volume'").select("item_id")
    for f in folder_ids:
        new_tags = new_tags.unionByName(roots.select("item_id", F.lit(f).cast("bigint").alias("folder_id")))
    kept = remove_volume(tables, old_volume_id) if old_volume_id is not None else dict(tables)
    kept["items"] = kept["items"].unionByName(items, allowMissingColumns=True)
    kept["volumes"] = kept["volumes"].unionByName(volumes, allowMissingColumns=True)
    kept["item_tags"] = kept["item_tags"].unionByName(new_tags)
    return kept
