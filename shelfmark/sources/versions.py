"""Version texts of Windows programs and libraries, read from their resources by seeking."""

from __future__ import annotations

import struct
from typing import BinaryIO

#: Names of the texts in a file, with the columns that they fill.
TEXTS = {"Comments": "comments", "CompanyName": "company_name", "LegalCopyright": "legal_copyright", "ProductName": "product_name", "FileDescription": "file_description", "FileVersion": "file_version"}
#: Fixed values of the portable executable format: number of the version resource's kind, the bit of a sub-directory.
RT_VERSION, SUBDIRECTORY = 16, 0x80000000
#: Longer version resources, and more entries or sections, are taken for damaged.
MAX_RESOURCE, MAX_ENTRIES, MAX_SECTIONS = 1 << 20, 4096, 96


def _at(file: BinaryIO, place: int, layout: str) -> tuple:
    file.seek(place)
    return struct.unpack(layout, file.read(struct.calcsize(layout)))


def version_resource(file: BinaryIO) -> bytes | None:
    """The first version resource of a program; None if there is none."""
    if file.read(2) != b"MZ":
        return None
    head = _at(file, 0x3C, "<I")[0]
    mark, _, n_sections, _, _, _, optional = _at(file, head, "<4sHHIIIH")
    if mark != b"PE\0\0" or optional < 2 or n_sections > MAX_SECTIONS:
        return None
    tables = head + 24 + (112 if _at(file, head + 24, "<H")[0] == 0x20B else 96)
    if tables + 24 > head + 24 + optional:
        return None
    resources = _at(file, tables + 16, "<I")[0]
    sections = [_at(file, head + 24 + optional + 40 * i + 8, "<IIII") for i in range(n_sections)]

    def place(address: int) -> int | None:
        return next((address - start + raw for size, start, raw_size, raw in sections if start <= address < start + max(size, raw_size)), None)

    root = place(resources) if resources else None
    if root is None:
        return None
    at, wanted = 0, RT_VERSION
    while True:  # kind, name, language: of the last two the first is taken
        named, numbered = _at(file, root + at + 12, "<HH")
        if named + numbered > MAX_ENTRIES:
            return None
        entries = [_at(file, root + at + 16 + 8 * i, "<II") for i in range(named + numbered)]
        chosen = next((below for name, below in entries if wanted is None or name == wanted), None)
        if chosen is None:
            return None
        if not chosen & SUBDIRECTORY:
            address, size = _at(file, root + chosen, "<II")
            start = place(address)
            if start is None or size > MAX_RESOURCE:
                return None
            file.seek(start)
            return file.read(size)
        if chosen & ~SUBDIRECTORY <= at:  # directories follow each other: anything else would go in circles
            return None
        at, wanted = chosen & ~SUBDIRECTORY, None


def version_texts(block: bytes, start: int = 0, stop: int | None = None, depth: int = 4) -> dict[str, str]:
    """Names and texts in a version resource; blocks hold a header, a key, a value and further blocks, each on four bytes."""
    found: dict[str, str] = {}
    stop = len(block) if stop is None else min(stop, len(block))
    while start + 6 <= stop:
        length, n_value, kind = struct.unpack_from("<HHH", block, start)
        if length < 6:
            break
        end, key = min(start + length, stop), start + 6
        while key + 1 < end and block[key : key + 2] != b"\0\0":
            key += 2
        name = block[start + 6 : key].decode("utf-16-le", "replace")
        value = key + 2 + (-(key + 2) % 4)
        if kind == 1 and n_value:
            text = block[value : min(value + 2 * n_value, end)].decode("utf-16-le", "replace")
            found.setdefault(name, text.split("\0")[0])
        elif depth > 1:
            inner = value + n_value
            for k, v in version_texts(block, inner + -inner % 4, end, depth - 1).items():
                found.setdefault(k, v)
        start = end + -end % 4
    return found


def file_version(path: str) -> dict[str, str | None]:
    """The version columns of a file; all null for files of other kinds and damaged ones."""
    texts: dict[str, str] = {}
    with open(path, "rb") as file:
        try:
            texts = version_texts(version_resource(file) or b"")
        except struct.error:  # cut off within a header
            pass
    return {column: texts.get(name) for name, column in TEXTS.items()}
