"""Scanning a file system as a data source: one input partition for each top-level directory."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.operators.staging import staged
from shelfmark.operators.tree import with_ancestors
from shelfmark.schema import ITEMS, VOLUMES, conform
from shelfmark.sources.archives import archive_entries, as_items
from shelfmark.sources.drives import drive_facts
from shelfmark.sources.versions import TEXTS, file_version

SCAN = "full_name string, parent_path string, kind string, name string, extension string, length bigint, attributes int, creation_time timestamp_ntz, last_access_time timestamp_ntz, last_write_time timestamp_ntz, is_read_only boolean, crc bigint, comments string, company_name string, legal_copyright string, product_name string, file_description string, file_version string, scan_error string"
ARCHIVES = (".zip", ".rar")


@dataclass(frozen=True)
class ScanOptions:
    """What a scan reads beside names, sizes and times; all off by default."""

    read_file_info: bool = False
    compute_crc: bool = False
    browse_inside_compressed: bool = False
    autosave: bool = False
    auto_eject: bool = False


class Part(InputPartition):
    def __init__(self, path: str, recursive: bool):
        self.path, self.recursive = path, recursive


def _time(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


def file_crc(path: str) -> int:
    crc = 0
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            crc = zlib.crc32(part, crc)
    return crc


def one(path: str, kind: str, crc: bool, versions: bool = False) -> tuple:
    """A row; what can't be read is told in scan_error. A checksum or version text that couldn't be made is null."""
    s, error, check, texts = os.stat(path), None, None, {}
    name = os.path.basename(path)
    read_only = not os.access(path, os.W_OK)
    if crc and kind == "File":
        try:
            check = file_crc(path)
        except OSError as e:
            error = str(e)
    if versions and kind == "File":
        try:
            texts = file_version(path)
        except OSError as e:
            error = str(e)
    at = name.rfind(".")
    attributes = (16 if kind == "Folder" else 0) | (1 if read_only else 0) | (2 if name.startswith(".") else 0)
    return (path, os.path.dirname(path), kind, name, name[at:] if at >= 0 and kind == "File" else "", s.st_size if kind == "File" else None, attributes, _time(s.st_ctime), _time(s.st_atime), _time(s.st_mtime), read_only, check, *(texts.get(c) for c in TEXTS.values()), error)


def walk(path: str, recursive: bool, excluded: frozenset[str], crc: bool, versions: bool = False) -> Iterator[tuple]:
    """A directory's own files, or a directory with all below. An excluded folder takes its whole tree along."""
    todo = [path]
    while todo:
        folder = todo.pop()
        if folder.lower() in excluded:
            continue
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
            error = None
        except OSError as e:
            entries, error = [], str(e)
        if recursive:
            row = one(folder, "Folder", crc)
            yield (*row[:-1], error) if error else row
        for e in entries:
            if e.path.lower() in excluded:
                continue
            if e.is_dir(follow_symlinks=False):
                if recursive:
                    todo.append(e.path)
            elif e.is_file(follow_symlinks=False):
                yield one(e.path, "File", crc, versions)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.crc = str(options.get("computecrc", options.get("computeCrc", "false"))).lower() == "true"
        self.versions = str(options.get("readversions", options.get("readVersions", "false"))).lower() == "true"
        self.excluded = frozenset(x.lower() for x in options.get("excluded", "").split("|") if x)

    def partitions(self) -> list[InputPartition]:
        if self.root.lower() in self.excluded:
            return []
        tops = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [Part(self.root, False), *(Part(t, True) for t in tops)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return walk(partition.path, partition.recursive, self.excluded, self.crc, self.versions)


class FileSystemScan(DataSource):
    """spark.read.format("fsscan").option("path", root).option("computeCrc", "true").option("readVersions", "true").option("excluded", "a|b")"""

    @classmethod
    def name(cls) -> str:
        return "fsscan"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def scan(spark: SparkSession, root: str, volume_id: int, excluded: tuple[str, ...] = (), options: ScanOptions = ScanOptions(), name: str | None = None) -> dict[str, DataFrame]:
    """items and volumes of a directory tree. Ids come from a hash of volume and path, so a scan gives the same ids again."""
    spark.dataSource.register(FileSystemScan)
    root = os.path.abspath(root)
    reader = spark.read.format("fsscan").option("path", root).option("excluded", "|".join(excluded)).option("computeCrc", str(options.compute_crc).lower()).option("readVersions", str(options.read_file_info).lower())
    item = lambda path: F.xxhash64(F.lit(volume_id), path)
    rows = reader.load()
    top = spark.createDataFrame([(root, None, "Volume", name or root, "")], "full_name string, parent_path string, kind string, name string, extension string")
    rows = rows.unionByName(top, allowMissingColumns=True)
    rows = staged(rows, "scan")  # the tree is walked once
    rows = rows.withColumn("is_container", (F.col("kind") != "File") | (F.lower("extension").isin(*ARCHIVES) & F.lit(options.browse_inside_compressed)))
    rows = rows.withColumns({"item_id": item(F.col("full_name")), "parent_id": F.when(F.col("kind") != "Volume", item(F.col("parent_path"))), "volume_id": F.lit(volume_id).cast("bigint"), "path": F.col("parent_path")})
    items = conform(with_ancestors(rows, is_folder=F.col("kind") != "File"), ITEMS)
    if options.browse_inside_compressed:
        found = items.where("is_container and kind = 'File'").select(F.col("full_name").alias("path"), "item_id", "volume_id", "ancestors", "depth")
        entries = archive_entries(found.select("path").repartition(spark.sparkContext.defaultParallelism), content=None)
        errors = entries.where("scan_error is not null").select(F.col("archive").alias("_path"), F.col("scan_error").alias("_error"))
        items = items.join(errors, F.col("full_name") == F.col("_path"), "left").withColumn("scan_error", F.coalesce("_error", "scan_error")).drop("_path", "_error")
        items = items.select(*ITEMS.names).unionByName(conform(as_items(entries, found), ITEMS))
    facts = drive_facts(root)
    volume = {
        "volume_id": volume_id,
        "name": name or root,
        **{k: facts[k] for k in ("drive_format", "drive_type", "volume_label", "serial_number", "total_size", "total_free_space")},
        "guid": str(uuid.uuid4()),
        "scanned": datetime.now(timezone.utc).replace(tzinfo=None),
        "scanned_crc": options.compute_crc,
        "scanned_zip": options.browse_inside_compressed,
        "scanned_file_version": options.read_file_info,
        "from_drive": root,
    }
    volume = tuple(volume.get(c) for c in VOLUMES.names)
    return {"items": items, "volumes": spark.createDataFrame([volume], VOLUMES)}


def masked_files(spark: SparkSession, folder: str, masks: str) -> DataFrame:
    """Files of a folder by each ;-separated mask; a file that two masks match is listed twice."""
    out = None
    for m in (x.strip() for x in masks.split(";") if x.strip()):
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*" if m == "*.*" else m).load(folder).select("path", "length", "modificationTime")
        out = found if out is None else out.unionAll(found)
    if out is None:
        raise ValueError("The file mask is empty.")
    return out
