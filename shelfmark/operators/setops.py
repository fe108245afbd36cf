"""Merging catalogues and removing parts of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shelfmark.operators.tree import subtree

#: Columns that hold ids, by table and by what they point to.
ID_COLUMNS = {
    "items": {"item_id": "item", "parent_id": "item", "volume_id": "volume"},
    "volumes": {"volume_id": "volume"},
    "logical_folders": {"folder_id": "folder", "parent_id": "folder"},
    "item_tags": {"item_id": "item", "folder_id": "folder"},
}


def merge_databases(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All of both catalogues, without looking for equal volumes; the second one's ids continue after the first one's."""
    top = lambda t, c: (first[t].agg(F.max(c)).first()[0] if t in first else 0) or 0
    shift = {"item": top("items", "item_id") + 1, "volume": top("volumes", "volume_id") + 1, "folder": top("logical_folders", "folder_id") + 1}
    out = {}
    for name, ids in ID_COLUMNS.items():
        if name in first and name in second:
            moved = second[name]
            for c, kind in ids.items():
                if c in moved.columns:
                    moved = moved.withColumn(c, F.col(c) + F.lit(shift[kind]).cast("bigint"))
            if "ancestors" in moved.columns:
                moved = moved.withColumn("ancestors", F.transform("ancestors", lambda a: a + F.lit(shift["item"]).cast("bigint")))
            out[name] = first[name].unionByName(moved, allowMissingColumns=True)
    return out


def remove_items(tables: dict[str, DataFrame], item_ids: list[int]) -> dict[str, DataFrame]:
    """The catalogue without the items, all below them, and their tags."""
    gone = subtree(tables["items"], item_ids).select("item_id")
    return tables | {"items": tables["items"].join(gone, "item_id", "left_anti"), "item_tags": tables["item_tags"].join(gone, "item_id", "left_anti")}


def remove_volume(tables: dict[str, DataFrame], volume_id: int) -> dict[str, DataFrame]:
    """The catalogue without a volume, its items and their tags."""
    gone = tables["items"].where(F.col("volume_id") == volume_id).select("item_id")
    keep = F.col("volume_id") != volume_id
    return tables | {"items": tables["items"].where(keep), "volumes": tables["volumes"].where(keep), "item_tags": tables["item_tags"].join(gone, "item_id", "left_anti")}


def edited(rows: DataFrame, key: str, value: int, **columns) -> DataFrame:
    """rows with the given columns changed where key has the value."""
    here = F.col(key) == value
    return reduce(lambda df, kv: df.withColumn(kv[0], F.when(here, F.lit(kv[1])).otherwise(F.col(kv[0]))), columns.items(), rows)


def edit_item(items: DataFrame, item_id: int, **columns) -> DataFrame:
    """Keywords and description of any item; the name of a volume only."""
    allowed = {"keywords", "description", "name"}
    if set(columns) - allowed:
        raise ValueError(f"can't be edited: {', '.join(sorted(set(columns) - allowed))}")
    row = items.where(F.col("item_id") == item_id).first()
    if "name" in columns and (row is None or row["kind"] != "Volume"):
        raise ValueError("Only volumes can be renamed.")
    return edited(items, "item_id", item_id, **columns)


def edit_volume(volumes: DataFrame, volume_id: int, **columns) -> DataFrame:
    allowed = {"name", "keywords", "physical_location", "description"}
    if set(columns) - allowed:
        raise ValueError(f"can't be edited: {', '.join(sorted(set(columns) - allowed))}")
    return edited(volumes, "volume_id", volume_id, **columns)
