import gzip
import os
import struct
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import progress, rescan, setops, tags, tree
from shelfmark.plans.queries import ORACLE_SQL, QUERIES
from shelfmark.schema import ITEM_TAGS, ITEMS, LOGICAL_FOLDERS, conform
from shelfmark.sources import archives, fsscan, sinks
from shelfmark.streaming import stream

#    id, parent, kind, name, length, container
TREE = [(1, None, "Volume", "V", None, True), (2, 1, "Folder", "a", None, True), (3, 2, "Folder", "B", None, True), (4, 2, "File", "x", 10, False), (5, 3, "File", "y", 5, False), (6, 1, "File", "z.zip", 7, True), (7, 6, "File", "in.txt", 100, False), (8, 1, "Folder", "empty", None, True)]


@pytest.fixture(scope="module")
def items(spark):
    rows = spark.createDataFrame([(*r, 1) for r in TREE], "item_id long, parent_id long, kind string, name string, length long, is_container boolean, volume_id long")
    return conform(tree.with_ancestors(rows), ITEMS).cache()


@pytest.fixture(scope="module")
def folders(spark):
    rows = [(1, None, "Root", "GeneralFolder"), (2, 1, "Cat", "DiscCatalog"), (3, 2, "D1", "Disc"), (4, 3, "Docs", "GeneralFolder"), (5, 4, "Deep", "GeneralFolder"), (6, 1, "P", "Person")]
    return conform(spark.createDataFrame(rows, "folder_id long, parent_id long, name string, folder_type string"), LOGICAL_FOLDERS).cache()


def bag(spark, rows):
    return spark.createDataFrame(rows, ITEM_TAGS)


def test_ancestors(spark, items):
    assert {r.item_id: r.ancestors for r in items.collect()} == {1: [], 2: [1], 3: [1, 2], 4: [1, 2], 5: [1, 2, 3], 6: [1], 7: [1, 6], 8: [1]}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 777)], "item_id long, parent_id long")
    assert {r.item_id: r.depth for r in tree.with_ancestors(chain).collect()} == {**{i: i for i in range(40)}, 100: 0}
    with pytest.raises(ValueError):
        tree.with_ancestors(spark.createDataFrame([(1, 2), (2, 1)], "item_id long, parent_id long"))


def test_ancestors_equal_recursion(spark):
    import random

    r = random.Random(2)
    rows = [(0, None, 0)] + [(i, r.randrange(i), r.randrange(100)) for i in range(1, 120)]
    up = {i: p for i, p, _ in rows}
    want = {}
    for i, _, n in rows:
        at = up[i]
        while at is not None:
            c, s = want.get(at, (0, 0))
            want[at] = (c + 1, s + n)
            at = up[at]
    nodes = tree.with_ancestors(spark.createDataFrame(rows, "item_id long, parent_id long, length long"))
    got = {x.item_id: (x.subtree_count, x.subtree_size) for x in tree.rollup(nodes, F.lit(True)).collect()}
    assert got == want


def test_rollup_counts_archives_once(items):
    got = {r.item_id: (r.direct_count, r.direct_size, r.subtree_count, r.subtree_size) for r in tree.file_rollup(items).collect()}
    assert got == {1: (1, 7, 3, 22), 2: (1, 10, 2, 15), 3: (1, 5, 1, 5)}


def test_paths_and_walk(items):
    assert {r.item_id: r.path_and_name for r in tree.paths(items).collect()}[5] == "V\\a\\B\\y"
    order = [r.item_id for r in items.join(tree.preorder_key(items), "item_id").orderBy("preorder").collect()]
    assert order == [1, 2, 3, 5, 4, 8, 6, 7]


def test_part_of_disc(folders):
    got = {r.folder_id: (r.is_part_of_disc, r.is_folder_of_disc) for r in tags.part_of_disc(folders).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (True, False), 4: (True, True), 5: (True, True), 6: (False, False)}


def test_new_folders(folders):
    kinds = {r.name: r.folder_type for r in tags.add_folder(tags.add_folder(tags.add_folder(folders, "x", 2), "y", 3), "z", 6).collect()}
    assert (kinds["x"], kinds["y"], kinds["z"]) == ("Disc", "GeneralFolder", "Person")
    with pytest.raises(ValueError):
        tags.add_folder(folders, "docs", 3)
    with pytest.raises(ValueError):
        tags.add_folder(folders, "p", 4, "Person")
    assert tags.add_folder(folders, "p", 1).where("name = 'p'").count() == 1  # outside a disc names may repeat
    assert tags.valid_name(["Docs", "docs (1)"], "docs") == "docs (2)" and tags.valid_name(["a"], "b") == "b"
    with pytest.raises(ValueError):
        tags.edit_folder(folders, 6, max_size=5)
    assert tags.edit_folder(folders, 3, name="N", max_size=5).where("folder_id = 3").first().max_size == 5


def test_tags(spark, items, folders):
    t = bag(spark, [(4, 5), (4, 5), (5, 3)])
    size = lambda **k: {r.folder_id: r["size"] for r in tags.folder_sizes(folders, t, items, **k).collect()}
    assert size()[3] == 25 and size(distinct=True)[3] == 15 and size()[6] == 0
    assert tags.remove_items(t, bag(spark, [(4, 5)])).count() == 2
    assert tags.add_items(t, bag(spark, [(4, 5), (6, 6), (6, 6)]), distinct=True).count() == 4
    kept, left = tags.remove_folder(folders, t, 4)
    assert sorted(r.folder_id for r in kept.collect()) == [1, 2, 3, 6] and [(r.item_id, r.folder_id) for r in left.collect()] == [(5, 3)]


def test_physical_folders_become_logical(spark, items, folders):
    f, t = tags.add_physical_folder(folders, bag(spark, []), items, 1, 2, as_name="Disc 9", as_disc=True)
    new = {r.name: (r.folder_id, r.parent_id, r.folder_type) for r in f.where("folder_id > 6").collect()}
    assert new["Disc 9"] == (7, 2, "Disc") and new["a"][1:] == (7, "GeneralFolder") and new["B"][1] == new["a"][0]
    assert sorted((r.item_id, r.folder_id) for r in t.collect()) == sorted([(4, new["a"][0]), (5, new["B"][0]), (6, 7)])  # what is in the archive stays out


def test_convert_to_general(spark, items, folders):
    f, t = tags.convert_to_general(folders.withColumn("max_size", F.lit(9).cast("bigint")), bag(spark, [(2, 3), (4, 3)]), items, 2)
    rows = {r.folder_id: r for r in f.collect()}
    assert rows[3].folder_type == "GeneralFolder" and rows[3].max_size == 0 and rows[2].folder_type == "DiscCatalog" and rows[2].max_size == 9
    assert rows[7].name == "a" and rows[7].parent_id == 3 and [(r.item_id) for r in t.collect()] == [4]


def test_rescan(spark, items):
    old = items.withColumn("keywords", F.concat(F.lit("k"), F.col("item_id")))
    names = [(11, None, "Volume", "V"), (12, 11, "Folder", "a"), (13, 12, "Folder", "renamed"), (14, 12, "File", "x"), (15, 13, "File", "y"), (16, 12, "File", "new")]
    new = spark.createDataFrame([(*n, 2) for n in names], "item_id long, parent_id long, kind string, name string, volume_id long")
    new = conform(tree.with_ancestors(new), ITEMS)
    tables = {"items": old, "volumes": spark.createDataFrame([(1, "V", "old", "shelf")], "volume_id long, name string, keywords string, physical_location string"), "item_tags": bag(spark, [(4, 1), (5, 1), (8, 1)])}
    volumes = spark.createDataFrame([(2, "V", "fresh", None)], "volume_id long, name string, keywords string, physical_location string")
    out = rescan.replace_volume(tables, {"items": new, "volumes": volumes}, 1, (6,))
    got = {r.item_id: r.keywords for r in out["items"].collect()}
    assert got == {11: "k1", 12: "k2", 13: None, 14: "k4", 15: None, 16: None}
    assert sorted((r.item_id, r.folder_id) for r in out["item_tags"].collect()) == [(11, 6), (14, 1)]
    v = out["volumes"].collect()
    assert [(r.volume_id, r.keywords, r.physical_location) for r in v] == [(2, "old;fresh", "shelf")]


def test_exclusions(spark, items):
    rows = items.join(tree.paths(items, "/"), "item_id").withColumn("path", F.col("path_and_name"))
    gone = spark.createDataFrame([("v/A",), (None,)], "path string")
    assert sorted(r.item_id for r in rescan.exclude(rows, gone).collect()) == [1, 6, 7, 8]
    assert sorted(r.item_id for r in rows.where(~rescan.is_excluded(F.col("path"), ["V/A"])).collect()) == [1, 6, 7, 8]


def test_merge_and_remove(spark, items, folders):
    tables = {"items": items, "volumes": spark.createDataFrame([(1, "V")], "volume_id long, name string"), "logical_folders": folders, "item_tags": bag(spark, [(4, 6)])}
    both = setops.merge_databases(tables, tables)
    assert both["items"].count() == 16 and both["items"].select("item_id").distinct().count() == 16 and both["volumes"].count() == 2
    assert {r.item_id: r.ancestors for r in both["items"].collect()}[5 + 9] == [10, 11, 12]
    assert sorted((r.item_id, r.folder_id) for r in both["item_tags"].collect()) == [(4, 6), (13, 13)]
    left = setops.remove_items(tables, [2])
    assert sorted(r.item_id for r in left["items"].collect()) == [1, 6, 7, 8] and left["item_tags"].count() == 0
    assert setops.remove_volume(tables, 1)["items"].count() == 0
    assert setops.edit_item(items, 1, name="W", keywords="k").where("name = 'W' and keywords = 'k'").count() == 1
    for bad in ({"name": "n"}, {"length": 1}):
        with pytest.raises(ValueError):
            setops.edit_item(items, 4, **bad)


def test_progress(spark, items):
    files = spark.createDataFrame([(i, "s", i) for i in range(1, 5)], "id int, scan string, length long")
    assert [r.percent for r in progress.running(files, "id", "scan", by_size=True).orderBy("id").collect()] == [10, 30, 60, 100]
    assert progress.scan_totals(items.limit(0)).first().asDict() == {"file_count": 0, "file_size": 0}


def test_tables_round_trip(spark, items, folders, tmp_path):
    sinks.save({"items": items, "logical_folders": folders}, str(tmp_path / "db"))
    db = sinks.open_database(spark, str(tmp_path / "db"))
    assert db["items"].schema == ITEMS and sorted(map(str, db["items"].collect())) == sorted(map(str, items.collect()))
    assert db["item_tags"].count() == 0 and db["logical_folders"].count() == 6


def test_export(spark, items, tmp_path):
    odd = items.withColumn("description", F.when(F.col("item_id") == 4, F.lit('q " , \n e')))
    volumes = spark.createDataFrame([(1, "NTFS", "Fixed", 1, 2, "L", "g")], "volume_id long, drive_format string, drive_type string, total_free_space long, total_size long, volume_label string, guid string")
    sinks.export_csv(odd, volumes, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "csv"))
    rows = back.collect()
    assert [r.name for r in rows] == ["V", "a", "B", "y", "x", "empty", "z.zip", "in.txt"]
    assert rows[4].description == 'q " , \n e' and rows[0].drive_format == "NTFS"
    sinks.save_gzip(spark.createDataFrame([("line",)], "value string"), str(tmp_path / "gz"))
    packed = [f for f in os.listdir(tmp_path / "gz") if f.endswith(".gz")]
    assert b"".join(gzip.open(tmp_path / "gz" / f).read() for f in packed) == b"line\n" and spark.read.text(str(tmp_path / "gz")).first().value == "line"


def rar(name: bytes, data: bytes, flags: int = 0, high: tuple[int, int] | None = None) -> bytes:
    """A block of a RAR 4 archive with a stored file."""
    extra = struct.pack("<II", *high) if high else b""
    size = 32 + len(extra) + len(name)
    head = struct.pack("<HBHH", 0, 0x74, flags | 0x8000 | (0x100 if high else 0), size)
    return head + struct.pack("<IIBIIBBHI", len(data), len(data), 2, zlib.crc32(data), (44 << 9 | 12 << 5 | 31) << 16 | 29, 20, 0x30, len(name), 32) + extra + name + data


def test_archives(spark, tmp_path):
    body = archives.RAR_MARK + struct.pack("<HBHH", 0, 0x73, 0, 13) + b"\0" * 6 + rar(b"dir\\one.txt", b"hello", 0x02) + rar(b"dir", b"", 0xE0) + rar(b"big", b"x", 0x01, (0, 3)) + struct.pack("<HBHH", 0, 0x7B, 0, 7)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("f.txt", "data")
        z.writestr("sub/", "")
    rows = spark.createDataFrame([("r", bytearray(body)), ("z", bytearray((tmp_path / "a.zip").read_bytes())), ("bad", bytearray(b"junk")), ("none", None)], "path string, content binary")
    found = archives.archive_entries(rows).collect()
    by = {(r.archive, r.file_name): r for r in found}
    one = by["r", "dir\\one.txt"]
    assert (one.unpacked_size, one.file_crc, one.is_directory, one.continued_on_next, one.file_time.second) == (5, zlib.crc32(b"hello"), False, True, 58)
    assert by["r", "dir"].is_directory and by["r", "big"].continued_from_previous and by["r", "big"].unpacked_size == 3 * 2**32 + 1
    assert by["z", "f.txt"].file_crc == zlib.crc32(b"data") and by["z", "sub/"].is_directory
    assert by["bad", None].scan_error and by["none", None].scan_error
    assert sorted(r.file_name for r in archives.listed_files(archives.archive_entries(rows)).collect()) == ["big", "dir\\one.txt", "f.txt"]


def test_scan(spark, tmp_path):
    for p, text in (("top.txt", "t"), ("a/x.bin", "xx"), ("a/b/y", ""), ("Skip/deep/n.txt", "n")):
        os.makedirs((tmp_path / p).parent, exist_ok=True)
        (tmp_path / p).write_text(text)
    with zipfile.ZipFile(tmp_path / "a" / "z.zip", "w") as z:
        z.writestr("in/side.txt", "data")
    (tmp_path / "bad.zip").write_text("no archive")
    got = fsscan.scan(spark, str(tmp_path), 4, (str(tmp_path / "skip"),), fsscan.ScanOptions(compute_crc=True, browse_inside_compressed=True))
    rows = {r.name: r for r in got["items"].collect()}
    assert set(rows) == {str(tmp_path), "top.txt", "a", "b", "x.bin", "y", "z.zip", "side.txt", "bad.zip"}
    assert rows["x.bin"].crc == zlib.crc32(b"xx") and rows["x.bin"].length == 2 and rows["x.bin"].extension == ".bin" and rows["y"].extension == ""
    assert rows["side.txt"].parent_id == rows["z.zip"].item_id and rows["side.txt"].ancestors == [rows[str(tmp_path)].item_id, rows["a"].item_id, rows["z.zip"].item_id]
    assert rows["bad.zip"].scan_error and rows["b"].depth == 2 and got["volumes"].first().scanned_crc
    assert fsscan.ScanOptions() == fsscan.ScanOptions(False, False, False, False, False)
    found = fsscan.masked_files(spark, str(tmp_path), "*.txt;top.*")
    assert [os.path.basename(r.path) for r in found.collect()] == ["top.txt", "top.txt"]


def test_content_store(spark, tmp_path):
    files = spark.createDataFrame([("D:\\a\\b.txt", bytearray(b"1"))], "full_name string, content binary")
    sinks.store_content(files, "g-1", str(tmp_path / "store"))
    assert [(r.path, bytes(r.content)) for r in sinks.read_content(spark, str(tmp_path / "store"), "g-1").collect()] == [("a\\b.txt", b"1")]


def test_arrivals(spark, tmp_path):
    drop, seen = str(tmp_path / "drop"), []
    rows = spark.createDataFrame([(1, "v"), (2, "v")], "id long, volume string")
    for _ in range(2):
        rows.write.mode("append").parquet(drop)
        stream.arrivals(spark, drop, rows.schema, lambda df, n: seen.append(df.count()), str(tmp_path / "state")).awaitTermination()
    assert seen == [2, 2]


def vint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def rar5(kind: int, body: bytes, flags: int = 0, data: bytes | int = b"") -> bytes:
    """A header of a RAR 5 archive, with data behind it (or the size of data that a hole stands for)."""
    size = data if isinstance(data, int) else len(data)
    head = vint(kind) + vint(flags | (2 if size else 0)) + (vint(size) if size else b"") + body
    return struct.pack("<I", 0) + vint(len(head)) + head + (b"" if isinstance(data, int) else data)


def rar5_file(name: str, data: bytes | int, flags: int = 0, folder: bool = False) -> bytes:
    size = data if isinstance(data, int) else len(data)
    own = vint(2 | 4 | folder) + vint(size) + vint(0x20) + struct.pack("<II", 1_700_000_000, 0 if isinstance(data, int) else zlib.crc32(data)) + vint(0) + vint(1) + vint(len(name.encode())) + name.encode()
    return rar5(2, own, flags, data)


def test_archives_of_a_new_kind_and_of_any_size(spark, tmp_path):
    """RAR 5 by its headers; a file above 2 GB beside small archives, and one inside an archive, are not read."""
    big = 3 * 2**30
    start = archives.RAR5_MARK + rar5(1, vint(0)) + rar5_file("dir/ünï.txt", b"hello", 0x10) + rar5_file("dir", b"", 0, True)
    with open(tmp_path / "a.rar", "wb") as f:
        f.write(start + rar5_file("film.bin", big, 0x08))
        f.seek(big, os.SEEK_CUR)
        f.write(rar5_file("last", b"1") + rar5(5, vint(0)))
    with open(tmp_path / "film.mkv", "wb") as f:
        f.truncate(big)
    got = fsscan.scan(spark, str(tmp_path), 9, options=fsscan.ScanOptions(browse_inside_compressed=True))
    rows = {r.name: r for r in got["items"].collect()}
    assert {"ünï.txt", "dir", "film.bin", "last", "film.mkv", "a.rar"} <= set(rows) and all(r.scan_error is None for r in rows.values())
    assert rows["ünï.txt"].crc == zlib.crc32(b"hello") and rows["film.bin"].length == big and rows["dir"].kind == "Folder"
    assert rows["ünï.txt"].last_write_time.year == 2023 and rows["last"].parent_id == rows["a.rar"].item_id
    flags = {e["file_name"]: (e["continued_from_previous"], e["continued_on_next"]) for e in archives.entries_of(open(tmp_path / "a.rar", "rb"))}
    assert flags["film.bin"] == (True, False) and flags["dir/ünï.txt"] == (False, True)


def test_save_where_it_was_opened(spark, items, folders, tmp_path):
    """Tables that are read while they are replaced; a save that fails changes nothing."""
    place = str(tmp_path / "db")
    sinks.save({"items": items, "logical_folders": folders}, place)
    db = sinks.open_database(spark, place)
    sinks.save({"items": setops.edit_item(db["items"], 4, keywords="new")}, place)
    again = sinks.open_database(spark, place)
    assert again["items"].where("keywords = 'new'").count() == 1 and again["items"].count() == 8 and again["logical_folders"].count() == 6
    broken = again["items"].withColumn("length", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        sinks.save({"items": broken}, place)
    assert sinks.open_database(spark, place)["items"].count() == 8


def test_csv_of_older_programs(spark, items, tmp_path):
    (tmp_path / "old.csv").write_text('ID,Title,Bytes,Keywords,Other\n1,"a, b",10,k,z\n2,c,many,,\n')
    rows = sinks.load_csv(spark, str(tmp_path / "old.csv"), "items", {"id": "item_id", "title": "name", "bytes": "length"})
    assert rows.schema == ITEMS
    assert [(r.item_id, r.name, r.length, r.keywords) for r in rows.orderBy("item_id").collect()] == [(1, "a, b", 10, "k"), (2, "c", None, None)]


def test_running_totals_over_blocks(spark):
    import random

    r = random.Random(1)
    rows = [(i, r.choice(["hot", "hot", "hot", "cold"]), r.randrange(50)) for i in range(700)] + [(None, "hot", 3)]
    frame = spark.createDataFrame(rows, "id long, scan string, length long")
    for block in (1, 20, 10**6):
        got = {(x.id, x.scan): (x.running_count, x.running_size) for x in progress.running(frame, "id", "scan", block_rows=block).collect()}
        sums: dict = {}
        for i, scan, n in sorted(rows, key=lambda x: -1 if x[0] is None else x[0]):
            c, s = sums.get(scan, (0, 0))
            sums[scan] = (c + 1, s + n)
            assert got[i, scan] == sums[scan]
    text = spark.createDataFrame([("a", "s", 1), ("b", "s", 2)], "id string, scan string, length long")
    assert [x.percent for x in progress.running(text, "id", "scan").orderBy("id").collect()] == [50, 100]


def test_numbers_without_gaps(spark):
    from shelfmark.operators.staging import numbered

    rows = spark.range(500).withColumn("k", F.col("id") % 7)
    got = {r.id: r.place for r in numbered(rows, ["k", "id"], "place").collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(500), key=lambda i: (i % 7, i)))}
    assert numbered(rows.limit(0), ["id"], "place").count() == 0


def test_values_of_editing_and_order(spark, items):
    from shelfmark.operators import search

    volumes = spark.createDataFrame([(1, "V", None), (2, "W", "k")], "volume_id long, name string, keywords string")
    assert [tuple(r) for r in setops.edit_volume(volumes, 2, name="X").orderBy("volume_id").collect()] == [(1, "V", None), (2, "X", "k")]
    with pytest.raises(ValueError):
        setops.edit_volume(volumes, 1, serial_number="1")
    files = items.withColumn("crc", F.lit(9) - F.col("item_id"))
    assert [r.item_id for r in search.in_comparer_order(files, by_crc=True).collect()] == [7, 6, 5, 4]


def test_listener_and_windows(spark, tmp_path):
    """A stream by windows of a minute: the totals, and what the listener is told."""
    import time

    rows = [("2024-01-01 00:00:10", "f", 3), ("2024-01-01 00:00:50", "f", 4), ("2024-01-01 00:01:10", "f", 5), ("2024-01-01 00:00:20", "g", 1)]
    files = spark.createDataFrame(rows, "ts string, kind string, length long").withColumn("ts", F.to_timestamp("ts"))
    files.write.parquet(str(tmp_path / "in"))
    moved, ended = [], []
    listener = stream.ScanListener(moved.append, ended.append)
    spark.streams.addListener(listener)
    try:
        totals = stream.windowed_totals(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")), "ts", "1 minute", "5 minutes", "kind")
        query = totals.writeStream.format("memory").queryName("window_totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = sorted((r.window.start.minute, r.kind, r.file_count, r.file_size) for r in spark.table("window_totals").collect())
    assert got == [(0, "f", 2, 7), (0, "g", 1, 1), (1, "f", 1, 5)]
    assert sum(moved) == 4 and ended == [None]


def same_as_sql(spark, folder, name):
    """The rows of a query on documents of odd kinds, after a comparison with its SQL: texts of one CRC-32, empty and null texts, null and repeated ids."""
    texts = ["plumless", "buckeroo", "", "", "other", "same", "same", None, None, "gnu", "codding"]
    rows = [(3 * i + 1, t, "en", None if i == 4 else 8) for i, t in enumerate(texts)]
    rows += [(100, None, "en", 5), (100, None, "en", 5), (None, "same", "de", 4), (None, None, "en", 5), (None, None, "en", 5), (103, "alone", "de", 5), (106, "alone too", "de", 5)]
    rows += [(300, "plumless", "en", 3), (303, "buckeroo", "en", 3), (306, "x", None, 3), (309, "x", None, 3), (312, "y", "it", None), (315, "y", "it", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    docs.withColumn("source", F.lit("s")).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = sorted((r.item_id for r in QUERIES[name](spark, str(folder)).collect()), key=str)
    assert got == sorted((x for (x,) in con.execute(ORACLE_SQL[name]).fetchall()), key=str)
    return got


def test_mixed_duplicates_of_one_checksum(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "dup_mixed")
    assert {1, 4}.isdisjoint(got) and {7, 10, 300, 303} <= set(got)


def test_duplicates_of_one_checksum(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "dup_crc")
    assert {28, 31, 100, 103}.isdisjoint(got) and {7, 10, 16, 19, None} <= set(got)
