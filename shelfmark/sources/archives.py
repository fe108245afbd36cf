"""Entries of ZIP and RAR archives, from their headers alone."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.schema import ARCHIVE_ENTRIES

RAR_MARK = b"Rar!\x1a\x07\x00"
#: Fixed values of the RAR 4 format: block types and flags of a file's header.
FILE_BLOCK, END_BLOCK = 0x74, 0x7B
FROM_PREVIOUS, ON_NEXT, DIRECTORY, LARGE, HAS_DATA = 0x01, 0x02, 0xE0, 0x100, 0x8000
RAR5_MARK = b"Rar!\x1a\x07\x01\x00"
#: Fixed values of the RAR 5 format: header types, flags of any header, flags of a file's header.
RAR5_FILE, RAR5_ENCRYPTED, RAR5_END = 2, 4, 5
RAR5_EXTRA, RAR5_DATA, RAR5_FROM_PREVIOUS, RAR5_ON_NEXT = 0x01, 0x02, 0x08, 0x10
RAR5_FOLDER, RAR5_TIME, RAR5_CRC, RAR5_UNKNOWN = 0x01, 0x02, 0x04, 0x08


def dos_datetime(packed: int) -> datetime | None:
    hi, lo = packed >> 16, packed & 0xFFFF
    try:
        return datetime((hi >> 9) + 1980, hi >> 5 & 15, hi & 31, lo >> 11, lo >> 5 & 63, (lo & 31) * 2)
    except ValueError:
        return None


def zip_entries(file: BinaryIO) -> Iterator[dict]:
    with zipfile.ZipFile(file) as z:
        for e in z.infolist():
            try:
                time = datetime(*e.date_time)
            except ValueError:
                time = None
            yield {"file_name": e.filename, "packed_size": e.compress_size, "unpacked_size": e.file_size, "file_crc": e.CRC, "file_time": time, "file_attributes": e.external_attr & 0xFFFF, "is_directory": e.is_dir(), "continued_from_previous": False, "continued_on_next": False}


def rar_entries(file: BinaryIO) -> Iterator[dict]:
    """The file headers of a RAR 4 archive. Data is skipped."""
    at = len(RAR_MARK)
    while True:
        file.seek(at)
        start = file.read(7)
        if len(start) < 7:
            return
        _, kind, flags, size = struct.unpack("<HBHH", start)
        if kind == END_BLOCK or size < 7:
            return
        body = file.read(size - 7)
        packed = struct.unpack_from("<I", body)[0] if flags & HAS_DATA else 0
        if kind == FILE_BLOCK:
            packed, unpacked, _, crc, time, _, _, length, attributes = struct.unpack_from("<IIBIIBBHI", body)
            name = 25
            if flags & LARGE:
                high_packed, high_unpacked = struct.unpack_from("<II", body, name)
                packed, unpacked, name = packed | high_packed << 32, unpacked | high_unpacked << 32, name + 8
            raw = body[name : name + length].split(b"\0")[0]
            yield {"file_name": raw.decode("utf-8", "replace"), "packed_size": packed, "unpacked_size": unpacked, "file_crc": crc, "file_time": dos_datetime(time), "file_attributes": attributes & 0x7FFFFFFF, "is_directory": flags & DIRECTORY == DIRECTORY, "continued_from_previous": bool(flags & FROM_PREVIOUS), "continued_on_next": bool(flags & ON_NEXT)}
        at += size + packed


class Numbers:
    """A RAR 5 header: numbers of seven bits a byte, and plain fields."""

    def __init__(self, body: bytes):
        self.body, self.at = body, 0

    def next(self) -> int:
        value = shift = 0
        while True:
            byte = self.body[self.at]
            self.at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    def plain(self) -> int:
        self.at += 4
        return struct.unpack_from("<I", self.body, self.at - 4)[0]


def rar5_entries(file: BinaryIO) -> Iterator[dict]:
    """The file headers of a RAR 5 archive. Data is skipped."""
    at = len(RAR5_MARK)
    while True:
        file.seek(at)
        start = file.read(4 + 3)
        if len(start) < 7:
            return
        size = Numbers(start[4:])
        length = size.next()
        file.seek(at + 4 + size.at)
        head = Numbers(file.read(length))
        kind, flags = head.next(), head.next()
        if flags & RAR5_EXTRA:
            head.next()
        packed = head.next() if flags & RAR5_DATA else 0
        if kind == RAR5_END:
            return
        if kind == RAR5_ENCRYPTED:
            raise ValueError("the headers are encrypted")
        if kind == RAR5_FILE:
            own, unpacked, attributes = head.next(), head.next(), head.next()
            time = datetime.fromtimestamp(head.plain(), timezone.utc).replace(tzinfo=None) if own & RAR5_TIME else None
            crc = head.plain() if own & RAR5_CRC else None
            head.next(), head.next()  # compression, system
            n = head.next()
            name = head.body[head.at : head.at + n].decode("utf-8", "replace")
            yield {"file_name": name, "packed_size": packed, "unpacked_size": None if own & RAR5_UNKNOWN else unpacked, "file_crc": crc, "file_time": time, "file_attributes": attributes & 0x7FFFFFFF, "is_directory": bool(own & RAR5_FOLDER), "continued_from_previous": bool(flags & RAR5_FROM_PREVIOUS), "continued_on_next": bool(flags & RAR5_ON_NEXT)}
        at += 4 + size.at + length + packed


def entries_of(file: BinaryIO) -> list[dict]:
    """Of an archive of any kind that is known; only its headers are read."""
    mark = file.read(8)
    file.seek(0)
    return list(rar5_entries(file) if mark == RAR5_MARK else rar_entries(file) if mark.startswith(RAR_MARK) else zip_entries(file))


def archive_entries(files: DataFrame, path: str = "path", content: str | None = "content") -> DataFrame:
    """A row per entry of each archive: path, the entry, scan_error. What can't be read is one row with the error alone.

    Without a content column the archives are opened at their paths, and their data is skipped by seeking.
    """
    names = [f.name for f in ARCHIVE_ENTRIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist() if content else [None] * batch.num_rows, strict=True):
                try:
                    with io.BytesIO(c or b"") if content else open(p, "rb") as file:
                        rows += [{"archive": p, **e, "scan_error": None} for e in entries_of(file)]
                except Exception as e:  # any fault of an archive is that archive's: it is kept as text
                    rows.append({"archive": p, **dict.fromkeys(names), "scan_error": f"{type(e).__name__}: {e}"})
            kinds = {"file_name": pa.string(), "packed_size": pa.int64(), "unpacked_size": pa.int64(), "file_crc": pa.int64(), "file_time": pa.timestamp("us"), "file_attributes": pa.int32()}
            schema = pa.schema([("archive", pa.string()), *((n, kinds.get(n, pa.bool_())) for n in names), ("scan_error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "archive string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ARCHIVE_ENTRIES) + ", scan_error string"
    return files.select(F.col(path).alias("path"), *([F.col(content).alias("content")] if content else [])).mapInArrow(run, ddl)


def listed_files(entries: DataFrame) -> DataFrame:
    """Names of the entries that are no directories."""
    return entries.where("not is_directory").select("archive", "file_name")


def as_items(entries: DataFrame, archive: DataFrame) -> DataFrame:
    """Entries as items below their archive's row. archive: path, item_id, volume_id, ancestors, depth. item_id comes from a hash of both names."""
    rows = entries.where("file_name is not null").join(archive, F.col("archive") == F.col("path"))
    name = F.regexp_extract("file_name", r"([^/\\]*)[/\\]?$", 1)
    return rows.select(
        F.xxhash64("archive", "file_name").alias("item_id"),
        "volume_id",
        F.col("item_id").alias("parent_id"),
        F.when(F.col("is_directory"), "Folder").otherwise("File").alias("kind"),
        F.lit(False).alias("is_container"),
        name.alias("name"),
        F.concat("archive", F.lit("/"), "file_name").alias("full_name"),
        F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("extension"),
        F.concat("ancestors", F.array("item_id")).alias("ancestors"),
        (F.col("depth") + 1).alias("depth"),
        F.col("unpacked_size").alias("length"),
        F.col("file_time").alias("last_write_time"),
        F.col("file_crc").alias("crc"),
    )
