"""Rows as a result grid or a property sheet shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.scalars import attributes_text, crc_text, options_text, or_placeholder, serial_text, short_time, size_gb, size_kb, size_kb_and_bytes
from shelfmark.schema import FOLDER_TYPES

GRID = ["name", "size", "creation_time", "attributes", "keywords", "extension", "file_description", "file_version", "volume", "path", "crc"]


def with_volume(items: DataFrame, volumes: DataFrame) -> DataFrame:
    """items with the name of their volume as volume; items of unknown volumes stay, with null."""
    names = volumes.select(F.col("volume_id").alias("_volume_id"), F.col("name").alias("volume"))
    return items.join(names, F.col("volume_id") == F.col("_volume_id"), "left").drop("_volume_id")


def grid(items: DataFrame, volumes: DataFrame) -> DataFrame:
    """The 11 columns of the result grid, with item_id. Folders and volumes show no size and no CRC."""
    rows, is_file = with_volume(items, volumes), F.col("kind") == "File"
    return rows.select(
        "item_id",
        "name",
        F.when(is_file, size_kb(F.col("length"))).otherwise("").alias("size"),
        short_time(F.col("creation_time")).alias("creation_time"),
        attributes_text(F.col("attributes")).alias("attributes"),
        "keywords",
        "extension",
        "file_description",
        "file_version",
        "volume",
        "path",
        F.when(is_file, crc_text(F.col("crc"))).otherwise("").alias("crc"),
    )


def item_sheet(items: DataFrame, volumes: DataFrame, tags: DataFrame, folders: DataFrame) -> DataFrame:
    """Name, volume, path, keywords, description and the sorted names of the logical folders of each item."""
    named = tags.join(folders.select("folder_id", F.col("name").alias("folder")), "folder_id")
    by_item = named.groupBy(F.col("item_id").alias("_item_id")).agg(F.array_sort(F.collect_list("folder")).alias("folders"))
    rows = with_volume(items, volumes).join(by_item, F.col("item_id") == F.col("_item_id"), "left")
    return rows.select("item_id", "name", "volume", "path", "keywords", "description", F.concat_ws(", ", "folders").alias("folders"))


def file_sheet(items: DataFrame) -> DataFrame:
    """Size with bytes, CRC or (not computed), description and version or (empty)."""
    crc = or_placeholder(crc_text(F.col("crc")), "(not computed)")
    texts = [or_placeholder(F.col(c), "(empty)").alias(c) for c in ("file_description", "file_version")]
    return items.where("kind = 'File'").select("item_id", "name", size_kb_and_bytes(F.col("length")).alias("size"), crc.alias("crc"), *texts)


def volume_sheet(volumes: DataFrame) -> DataFrame:
    return volumes.select(
        "volume_id",
        "name",
        or_placeholder(F.col("volume_label"), "(no label)").alias("label"),
        or_placeholder(F.col("from_drive"), "(no drive)").alias("drive"),
        size_gb(F.col("total_size")).alias("size"),
        size_gb(F.col("total_free_space")).alias("free"),
        options_text(F.col("scanned_crc"), F.col("scanned_file_version"), F.col("scanned_zip")).alias("options"),
    )


def type_label(folder_type: Column) -> Column:
    label = None
    for name, text in FOLDER_TYPES.items():
        label = F.when(folder_type == name, text) if label is None else label.when(folder_type == name, text)
    return label.otherwise("Unknown")


def icon_type(folder_type: Column, inside_disc: Column) -> Column:
    """Folders in a disc's tree show as disc catalogues."""
    return F.when(inside_disc, "DiscCatalog").otherwise(folder_type)


def store_path(root: str, guid: Column, path: Column, name: Column) -> Column:
    """Where the content store keeps an item."""
    return F.concat(F.lit(root), guid, path, name)


def has_preview(name: Column) -> Column:
    """Only names that end in jpg, in lower case."""
    return F.right(name, F.lit(3)) == "jpg"


def serial(volumes: DataFrame, number: str = "serial") -> DataFrame:
    return volumes.withColumn("serial_number", serial_text(F.col(number)))
