"""Scalar columns of the catalogue."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

#: Bytes of the writable DVDs, minutes and sectors of CDs, bytes of a CD's sector by mode.
DVD_BYTES = {"DVD-R Single": 4707319808, "DVD+R Single": 4700372992, "DVD-R Double": 8543666176, "DVD+R Double": 8547991552}
CD_SECTORS = {63: 283500, 74: 333000, 80: 360000, 90: 405000, 99: 445500}
CD_MODE_BYTES = {1: 2048, 2: 2336}
SIZE_UNITS = {"B": 1, "kB": 1024, "MB": 1024**2, "GB": 1024**3}
ATTRIBUTES = {"ReadOnly": 1, "Hidden": 2, "System": 4, "Directory": 16, "Archive": 32, "Device": 64, "Normal": 128, "Temporary": 256, "SparseFile": 512, "ReparsePoint": 1024, "Compressed": 2048, "Offline": 4096, "NotContentIndexed": 8192, "Encrypted": 16384}


def left(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def mid(s: Column, start: int, n: int | None = None) -> Column:
    """From a 0-based start."""
    return F.substring(s, start + 1, n if n is not None else 2**31 - 1)


def drop_drive(path: Column) -> Column:
    """The path without its three characters of drive."""
    return F.substring(path, 4, 2**31 - 1)


def crc_text(crc: Column) -> Column:
    """Upper-case hex without padding; '' for null or 0."""
    return F.when(crc.isNull() | (crc == 0), F.lit("")).otherwise(F.hex(crc))


def content_crc(content: Column) -> Column:
    return F.crc32(content)


def kb_to_bytes(text: str | float | None) -> int:
    """Kilobytes as typed, in single precision, rounded half to even; an empty text is 0."""
    if text is None or text == "":
        return 0
    return int(round(float(np.float32(float(text)) * np.float32(1024))))


def size_kb(n: Column) -> Column:
    return F.concat(F.format_number(F.ceil(n / 1024), 0), F.lit(" KB"))


def size_bytes(n: Column) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" B"))


def size_kb_and_bytes(n: Column) -> Column:
    return F.concat(size_kb(n), F.lit(" ("), size_bytes(n), F.lit(")"))


def size_gb(n: Column) -> Column:
    return F.concat(F.format_number(F.round(n / F.lit(1024**3), 2), 2), F.lit(" GB"))


def in_units(n: Column, unit: str) -> Column:
    return n / SIZE_UNITS[unit]


def short_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm")


def duration(seconds: Column) -> Column:
    """H:MM:SS with all hours, days included."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def dos_time(packed: Column) -> Column:
    """A packed MS-DOS date and time (high and low 16 bits) as a timestamp."""
    hi, lo = F.shiftright(packed, 16).bitwiseAND(0xFFFF).cast("int"), packed.bitwiseAND(0xFFFF).cast("int")
    parts = (F.shiftright(hi, 9) + 1980, F.shiftright(hi, 5).bitwiseAND(15), hi.bitwiseAND(31), F.shiftright(lo, 11), F.shiftright(lo, 5).bitwiseAND(63), (lo.bitwiseAND(31) * 2).cast("int"))
    return F.try_make_timestamp_ntz(*parts)


def wide_size(high: Column, low: Column) -> Column:
    """A 64-bit size from two unsigned 32-bit halves."""
    return high.cast("long") * F.lit(2**32) + low.cast("long")


def has_flag(value: Column, mask: int) -> Column:
    return value.bitwiseAND(mask) == mask


def attributes_text(a: Column) -> Column:
    """Names of the set attributes, ', ' between them."""
    return F.concat_ws(", ", *(F.when(has_flag(a, bit), F.lit(name)) for name, bit in ATTRIBUTES.items()))


def is_compressible(attributes: Column, extension: Column) -> Column:
    """Not hidden, and not .gz already (case matters)."""
    return ~has_flag(attributes, ATTRIBUTES["Hidden"]) & (extension != ".gz")


def extension(name: Column) -> Column:
    """From the last dot on, the dot included; '' without one."""
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def parent_directory(path: Column, separator: str = "/") -> Column:
    """Without the last part."""
    at = F.length(path) - F.length(F.substring_index(path, separator, -1)) - 1
    return F.when(F.instr(path, separator) == 0, F.lit("")).otherwise(F.substring(path, F.lit(1), F.greatest(at, F.lit(0))))


def serial_text(n: Column) -> Column:
    """Hex, padded to 8 digits, as XXXX-XXXX."""
    s = F.lpad(F.hex(n), 8, "0")
    return F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 8))


def or_placeholder(s: Column, text: str) -> Column:
    """text in place of null or ''."""
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(text))


def options_text(crc: Column, versions: Column, archives: Column) -> Column:
    """What a scan read, or (none)."""
    names = F.concat_ws(", ", F.when(crc, F.lit("CRC")), F.when(versions, F.lit("File versions")), F.when(archives, F.lit("Browsed compressed files")))
    return or_placeholder(names, "(none)")


def joined(a: Column, b: Column) -> Column:
    """Two lists of keywords or locations as one; null and '' add nothing."""
    return F.concat_ws(";", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def used_percent(used: Column, capacity: Column) -> Column:
    """The whole percent of a capacity that is used, in single precision; 0 for no capacity."""
    share = used.cast("float") / F.nullif(capacity, F.lit(0).cast("long")).cast("float") * F.lit(100).cast("float")
    return F.coalesce(share.cast("int"), F.lit(0))


def done_percent(done: Column, total: Column) -> Column:
    """The share of an archive that is extracted; 0 for an empty one."""
    return F.coalesce(done / F.nullif(total, F.lit(0).cast("long")) * 100.0, F.lit(0.0))


def progress_percent(running: Column, total: Column) -> Column:
    """Whole percent of the way, 100 at most."""
    return F.least(F.lit(100).cast("long"), F.coalesce(F.floor(running * 100 / F.nullif(total, F.lit(0).cast("long"))), F.lit(0).cast("long")))


def remaining_seconds(elapsed: Column, percent: Column) -> Column:
    """The estimated whole time: elapsed / percent x 100; null at 0 percent."""
    return elapsed / F.nullif(percent, F.lit(0).cast("long")) * 100


def name_length_key(name: Column, length: Column) -> Column:
    """Name and length written one after the other, with nothing between them."""
    return F.concat(name, length.cast("string"))


def disc_capacities() -> list[tuple[str, int]]:
    """The selectable disc sizes in their order: label and bytes. 0 is no limit; a custom size, the last choice, is the caller's."""
    cds = [(f"CD {minutes} min ({mode})", n * size) for minutes, n in CD_SECTORS.items() for mode, size in CD_MODE_BYTES.items()]
    return [("No max size", 0), *DVD_BYTES.items(), *cds, ("Custom size", 0)]


def selected_capacity(choice: Column, custom: Column) -> Column:
    """Bytes of the chosen disc size; the last choice takes the custom text, null if that is no whole number."""
    sizes = disc_capacities()
    known = F.coalesce(F.get(F.array(*(F.lit(n).cast("long") for _, n in sizes)), choice), F.lit(0).cast("long"))
    return F.when(choice == len(sizes) - 1, custom.try_cast("long")).otherwise(known)
