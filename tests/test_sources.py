"""Version texts, drives, files packed by gzip, and what follows a scan."""

import gzip
import os
import struct

import pytest

from shelfmark.operators import rescan
from shelfmark.sources import drives, fsscan, sinks, versions


def block(key, value=b"", kind=1, inner=b"", n_value=None):
    """A block of a version resource."""
    head = key.encode("utf-16-le") + b"\0\0"
    head += b"\0" * (-(6 + len(head)) % 4) + value
    head += b"\0" * (-(6 + len(head)) % 4) if inner else b""
    n = n_value if n_value is not None else len(value) // 2 if kind else len(value)
    body = struct.pack("<HHH", 6 + len(head) + len(inner), n, kind) + head + inner
    return body + b"\0" * (-len(body) % 4)


def text(key, value):
    return block(key, (value + "\0").encode("utf-16-le"))


def program(resource, wide=False):
    """A file of one section that holds nothing but the resource."""
    n_optional = (112 if wide else 96) + 16 * 8
    base, start = 0x1000, 0x400
    tree = b""
    for name, below in ((versions.RT_VERSION, 24 | versions.SUBDIRECTORY), (1, 48 | versions.SUBDIRECTORY), (1033, 72)):
        tree += struct.pack("<IIHHHH", 0, 0, 0, 0, 0, 1) + struct.pack("<II", name, below)
    tree += struct.pack("<IIII", base + 88, len(resource), 0, 0) + resource
    optional = struct.pack("<H", 0x20B if wide else 0x10B).ljust(n_optional - 16 * 8, b"\0") + b"\0" * 16 + struct.pack("<II", base, len(tree))
    section = b".rsrc\0\0\0" + struct.pack("<IIII", len(tree), base, len(tree), start) + b"\0" * 16
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0" + struct.pack("<HHIIIHH", 0, 1, 0, 0, 0, n_optional, 0)
    return (head + optional.ljust(n_optional, b"\0") + section).ljust(start, b"\0") + tree


STRINGS = block("StringFileInfo", inner=block("040904b0", inner=text("CompanyName", "Ünï Ltd") + text("FileVersion", "1.2.3") + text("Comments", "") + text("Other", "x")))
RESOURCE = block("VS_VERSION_INFO", b"\xbd\x04\xef\xfe" + b"\0" * 48, 0, STRINGS + block("VarFileInfo", inner=block("Translation", b"\x09\x04\xb0\x04", 0)))


@pytest.mark.parametrize("wide", [False, True])
def test_version_texts(tmp_path, wide):
    (tmp_path / "a.exe").write_bytes(program(RESOURCE, wide))
    got = versions.file_version(str(tmp_path / "a.exe"))
    assert (got["company_name"], got["file_version"], got["product_name"]) == ("Ünï Ltd", "1.2.3", None) and not got["comments"]


def test_damaged_programs_have_no_version(tmp_path):
    whole = program(RESOURCE)
    for n in range(0, len(whole), 7):  # cut off anywhere
        (tmp_path / "cut").write_bytes(whole[:n])
        assert set(versions.file_version(str(tmp_path / "cut"))) == set(versions.TEXTS.values())
    for i in range(0x3C, len(whole), 3):  # a wrong byte anywhere
        (tmp_path / "odd").write_bytes(whole[:i] + bytes([whole[i] ^ 0xFF]) + whole[i + 1 :])
        versions.file_version(str(tmp_path / "odd"))
    circle = bytearray(whole)
    circle[0x400 + 24 + 20 : 0x400 + 24 + 24] = struct.pack("<I", versions.SUBDIRECTORY | 24)
    (tmp_path / "circle").write_bytes(bytes(circle))
    assert versions.file_version(str(tmp_path / "circle"))["file_version"] is None


def test_scan_reads_versions_and_drive(spark, tmp_path):
    (tmp_path / "a.dll").write_bytes(program(RESOURCE))
    (tmp_path / "b.txt").write_text("MZ")
    rows = {o: {r.name: r for r in fsscan.scan(spark, str(tmp_path), 1, options=fsscan.ScanOptions(read_file_info=o))["items"].collect()} for o in (True, False)}
    assert rows[True]["a.dll"].company_name == "Ünï Ltd" and rows[True]["b.txt"].company_name is None and rows[False]["a.dll"].company_name is None
    v = fsscan.scan(spark, str(tmp_path), 1)["volumes"].first()
    facts = drives.drive_facts(str(tmp_path))
    assert (v.drive_format, v.drive_type, v.total_size) == (facts["drive_format"], facts["drive_type"], facts["total_size"]) and v.from_drive == str(tmp_path) and not v.scanned_file_version


def test_drives(spark, tmp_path):
    (tmp_path / "mounts").write_text("/dev/sda1 / ext4 rw 0 0\nproc /proc proc rw 0 0\nhost:/x /mnt/my\\040disk nfs4 rw 0 0\n/dev/sr0 /cd iso9660 ro 0 0\n/dev/sdb1 /cd udf ro 0 0\n")
    found = drives.mounts(str(tmp_path / "mounts"))
    assert found == [("/dev/sda1", "/", "ext4"), ("/dev/sdb1", "/cd", "udf"), ("host:/x", "/mnt/my disk", "nfs4")]
    assert [drives.drive_kind(d, k) for d, _, k in found[1:]] == ["CDRom", "Network"] and drives.mounts(str(tmp_path / "none")) == []
    facts = drives.drive_facts(str(tmp_path), found)
    assert (facts["root"], facts["drive_format"]) == ("/", "ext4") and facts["total_size"] >= facts["total_free_space"] >= 0
    os.makedirs(tmp_path / "sdq" / "sdq1")
    (tmp_path / "sdq" / "removable").write_text("1\n")
    os.symlink(tmp_path / "sdq" / "sdq1", tmp_path / "sdq1")
    assert drives.drive_kind("/dev/sdq1", "vfat", str(tmp_path)) == "Removable"
    os.makedirs(tmp_path / "by-label")
    os.symlink("/dev/sdq1", tmp_path / "by-label" / "my\\x20disk")
    assert drives.device_names("by-label", str(tmp_path)) == {"/dev/sdq1": "my disk"} and drives.device_names("by-uuid", str(tmp_path)) == {}
    assert {"root", "drive_type", "serial_number"} <= set(drives.drives(spark).columns)
    assert drives.default_drive(["/", "/cd"], "/cd") == "/cd" and drives.default_drive(["/", "/cd"], "/x") == "/" and drives.default_drive([], "/") is None


def test_after_a_scan():
    done, options = [], fsscan.ScanOptions(autosave=True, auto_eject=True)
    assert drives.after_scan(options, lambda: done.append(1), lambda: done.append(2)) == ["saved", "ejected"] and done == [1, 2]
    assert drives.after_scan(fsscan.ScanOptions(), lambda: done.append(1)) == [] and done == [1, 2]
    with pytest.raises(ZeroDivisionError):
        drives.after_scan(options, lambda: 1 / 0, lambda: done.append(2))
    assert done == [1, 2]


def test_gzip_beside_files(spark, tmp_path):
    for name, body in (("a.txt", b"x" * 3_000_000), (".hidden", b"h"), ("b.GZ", b"no"), ("empty", b"")):
        (tmp_path / name).write_bytes(body)
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.txt", ".hidden", "b.GZ", "empty", "none")] + [(None,)], "path string")
    got = {os.path.basename(r.path or ""): r for r in sinks.gzip_files(files).collect()}
    assert got["a.txt"].written == str(tmp_path / "a.txt.gz") and got["none"].error and not any(got[n].written for n in ("", ".hidden", "b.GZ"))
    assert gzip.open(tmp_path / "a.txt.gz").read() == b"x" * 3_000_000 and (tmp_path / "a.txt").exists()
    os.remove(tmp_path / "a.txt")
    packed = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.txt.gz", "empty.gz", "b.GZ")], "path string")
    back = {os.path.basename(r.path): r for r in sinks.gunzip_files(packed).collect()}
    assert (tmp_path / "a.txt").read_bytes() == b"x" * 3_000_000 and (tmp_path / "empty").read_bytes() == b"" and back["b.GZ"].error
    assert not [n for n in os.listdir(tmp_path) if ".part-" in n]


def test_checked_trees(spark):
    nodes = spark.createDataFrame([("v",), ("v/a",), ("v/A/b",), ("v/a/b/c",), ("v/ab",), (None,), ("v/a",)], "path string")
    clicks = lambda *rows: spark.createDataFrame(rows, "path string, checked boolean, at int")
    state = lambda c: [r.path for r in rescan.checked(nodes, c).orderBy("path").collect() if not r.checked]
    assert state(clicks()) == [] and state(clicks((None, False, 1), ("v", None, 2))) == []
    assert state(clicks(("V/a", False, 1))) == ["v/A/b", "v/a", "v/a", "v/a/b/c"]
    assert state(clicks(("v/a", False, 1), ("v/a/b", True, 2))) == ["v/a", "v/a"]
    assert state(clicks(("v/a/b", True, 1), ("v/a", False, 2))) == ["v/A/b", "v/a", "v/a", "v/a/b/c"]
    assert state(clicks(("v/a", False, 1), ("v/a", True, 2))) == []
