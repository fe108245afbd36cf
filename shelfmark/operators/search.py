"""Search, duplicates, sorting and paging over items."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.masks import keyword_predicate, mask_predicate, split_masks
from shelfmark.functions.scalars import kb_to_bytes, name_length_key


@dataclass(frozen=True)
class SearchCriteria:
    """What is searched for; None switches a criterion off. Sizes are kilobytes as typed."""

    file_mask: str = "*.*"
    treat_file_mask_as_wildcard: bool = True
    date_from: datetime | None = None
    date_to: datetime | None = None
    size_from: str | float | None = None
    size_to: str | float | None = None
    keywords: str | None = None
    all_keywords_needed: bool = False
    only_duplicates: bool = False
    search_in_volumes: tuple[int, ...] | None = None
    case_sensitive_keywords: bool = False
    treat_keywords_as_wildcard: bool = True

    def validate(self) -> SearchCriteria:
        if not split_masks(self.file_mask or ""):
            raise ValueError("The file mask is empty.")
        if (self.date_from is None) != (self.date_to is None):
            raise ValueError("Both dates are needed, or none.")
        if self.date_from is not None and self.date_from > self.date_to:
            raise ValueError("Invalid date range.")
        if (self.size_from is None) != (self.size_to is None):
            raise ValueError("Both sizes are needed, or none.")
        if self.size_from is not None:
            for side, value in (("from", self.size_from), ("to", self.size_to)):
                try:
                    kb_to_bytes(value)
                except ValueError:
                    raise ValueError(f"The size {side} isn't a number: {value!r}") from None
            if kb_to_bytes(self.size_from) > kb_to_bytes(self.size_to):
                raise ValueError("Invalid size range.")
        return self

    def predicates(self) -> list[Column]:
        self.validate()
        found = [mask_predicate(F.col("name"), self.file_mask, self.treat_file_mask_as_wildcard)]
        if self.date_from is not None:
            found.append(F.col("creation_time").between(F.lit(self.date_from).cast("timestamp_ntz"), F.lit(self.date_to).cast("timestamp_ntz")))
        if self.size_from is not None:
            found.append(F.col("length").between(kb_to_bytes(self.size_from), kb_to_bytes(self.size_to)))
        if self.keywords:
            found.append(keyword_predicate(F.col("keywords"), self.keywords, self.all_keywords_needed, self.case_sensitive_keywords, self.treat_keywords_as_wildcard))
        if self.search_in_volumes is not None:
            found.append(F.col("volume_id").isin(list(self.search_in_volumes)))
        return found


def search(items: DataFrame, criteria: SearchCriteria) -> DataFrame:
    """Items (files and folders, no volumes) that meet all criteria; with only_duplicates the files among them that repeat."""
    found = items.where(reduce(Column.__and__, criteria.predicates())).where("kind <> 'Volume'")
    return duplicates(found) if criteria.only_duplicates else found


def search_nonempty(items: DataFrame, criteria: SearchCriteria) -> DataFrame:
    """As search, but a catalogue without rows is refused, as a user would be told."""
    if items.isEmpty():
        raise ValueError("The database is empty.")
    return search(items, criteria)


def in_volumes(items: DataFrame, volumes: DataFrame) -> DataFrame:
    """Items of the volumes in a table of any size."""
    return items.join(volumes.select("volume_id"), "volume_id", "left_semi")


def duplicate_key(crc: Column, name: Column, length: Column, digest: Column | None = None) -> Column:
    """By checksum where there is one, else by name and length; the two never meet.

    A checksum of 32 bits is that of other contents too, so a digest of the contents, where it is known, tells them apart.
    """
    known = F.lit(None).cast("string") if digest is None else digest
    return F.when((crc != 0) | known.isNotNull(), F.struct(F.lit("C").alias("by"), F.concat_ws(":", crc.cast("string"), known).alias("key"))).otherwise(F.struct(F.lit("N").alias("by"), name_length_key(name, length).alias("key")))


def duplicates(items: DataFrame) -> DataFrame:
    """Files whose key another file has too, with dup_key. A column digest is used if there is one.

    Keys are counted before they are shuffled and joined back, so a key with very many files is
    split by the join instead of sorted in one task. Files without a key (null name or length) never repeat.
    """
    files = items.where("kind = 'File'").withColumn("dup_key", duplicate_key(F.col("crc"), F.col("name"), F.col("length"), F.col("digest") if "digest" in items.columns else None))
    repeated = files.where("dup_key.key is not null").groupBy("dup_key").agg(F.count("*").alias("_n")).where("_n > 1").select("dup_key")
    return files.join(repeated, "dup_key", "left_semi")


def sort_by(items: DataFrame, column: str, ascending: bool = True, tie: str = "item_id") -> DataFrame:
    """By the column's typed value, nulls first, with a tie-breaker for a stable order."""
    key = F.col(column).asc_nulls_first() if ascending else F.col(column).desc_nulls_last()
    return items.orderBy(key, tie)


def page(items: DataFrame, order: list[str], first: int, count: int) -> DataFrame:
    """count rows from row first on, in a total order."""
    return items.orderBy(*order).offset(first).limit(count)


def in_comparer_order(items: DataFrame, by_crc: bool) -> DataFrame:
    """Files by CRC, or by name and length written together (binary order)."""
    key = F.col("crc") if by_crc else name_length_key(F.col("name"), F.col("length"))
    return items.where("kind = 'File'").orderBy(key, "item_id")


def find_item(items: DataFrame, item_id: int) -> DataFrame:
    return items.where(F.col("item_id") == item_id)


def find_path(items: DataFrame, full_name: str) -> DataFrame:
    """Items at a path, whatever its case."""
    return items.where(F.lower("full_name") == full_name.lower())
