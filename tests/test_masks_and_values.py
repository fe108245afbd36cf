import fnmatch
import zlib
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import display, scalars
from shelfmark.functions.masks import glob_regex, keyword_predicate, mask_predicate
from shelfmark.operators.search import SearchCriteria, duplicates, search, search_nonempty
from shelfmark.schema import ITEMS, VOLUMES, conform, empty


def matching(spark, names, mask, as_wildcard=True):
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    return sorted(r.name for r in rows.where(mask_predicate(F.col("name"), mask, as_wildcard)).collect())


def test_masks(spark):
    assert matching(spark, ["A.DOC", "b.xls", "c.docx"], "*.doc; *.xls") == ["A.DOC", "b.xls"]
    assert matching(spark, ["nodot", "a.b", None], "*.*") == ["a.b", "nodot"]
    assert matching(spark, ["a+b(1).txt", "aab(1).txt", "a+b1.txt"], "a+b(1).txt", False) == ["a+b(1).txt"]
    assert matching(spark, ["Spring", "ring", "rung"], "ring") == ["Spring", "ring"]
    assert matching(spark, ["Spring", "ring", "rung"], "ring", False) == ["ring"]
    assert matching(spark, ["ring", "xring"], "r?ng") == ["ring"]  # typed wildcards switch the flag off
    assert matching(spark, ["50%", "a_b", "a\nb"], "*%;a_b;a*b") == ["50%", "a\nb", "a_b"]
    with pytest.raises(ValueError):
        mask_predicate(F.col("name"), " ; ")


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(mask=st.text("ab.*?[+", min_size=1, max_size=6), names=st.lists(st.text("ab.[+", max_size=5), min_size=1, max_size=8))
def test_masks_against_fnmatch(spark, mask, names):
    escaped = mask.replace("[", "[[]")
    want = sorted(n for n in names if mask in ("*.*", "*") or fnmatch.fnmatchcase(n, escaped))
    assert matching(spark, names, mask, False) == want


def test_glob_regex_is_anchored():
    import re

    assert re.match(glob_regex("a*c"), "abc") and not re.match(glob_regex("a*c"), "abcd")


@pytest.mark.parametrize(
    ("wanted", "flags", "want"),
    [("b", {}, [1]), ("a;b", {"all_needed": True}, [1]), ("B", {"case_sensitive": True}, [1]), ("b", {"case_sensitive": True}, []), ("zz;a", {}, [1, 2]), ("long", {}, [3]), ("long", {"as_wildcard": False}, []), ("lo*er", {}, [3]), ("", {}, [1, 2, 3, 4, 5])],
)
def test_keywords(spark, wanted, flags, want):
    rows = spark.createDataFrame([(1, "a; B ;c"), (2, "a"), (3, "longer"), (4, None), (5, "")], "id int, keywords string")
    assert sorted(r.id for r in rows.where(keyword_predicate(F.col("keywords"), wanted, **flags)).collect()) == want


def test_sizes_as_typed():
    assert (scalars.kb_to_bytes("0.5"), scalars.kb_to_bytes("2.5"), scalars.kb_to_bytes(""), scalars.kb_to_bytes(None)) == (512, 2560, 0, 0)
    assert scalars.kb_to_bytes("0.00048828125") == 0 and scalars.kb_to_bytes("0.00146484375") == 2  # half to even
    assert scalars.kb_to_bytes("1.1") == 1126


def test_criteria_are_checked(spark):
    day = datetime(2024, 1, 1)
    SearchCriteria(size_from="1", size_to="1", date_from=day, date_to=day).validate()
    for bad in ({"size_from": "2", "size_to": "1"}, {"date_from": datetime(2024, 2, 1), "date_to": day}, {"file_mask": ""}, {"size_from": "x", "size_to": "1"}, {"size_from": "1", "size_to": "x"}, {"size_from": "1"}, {"date_to": day}):
        with pytest.raises(ValueError):
            SearchCriteria(**bad).validate()
    with pytest.raises(ValueError):
        search_nonempty(empty(spark, ITEMS), SearchCriteria())
    assert search(empty(spark, ITEMS), SearchCriteria(only_duplicates=True)).count() == 0


def test_duplicates(spark):
    rows = [(1, "File", "x", 5, 7), (2, "File", "y", 6, 7), (3, "File", "a1", 2, None), (4, "File", "a", 12, 0), (5, "File", "x", 5, None), (6, "Folder", "x", 5, 7), (7, "File", None, 1, None), (8, "File", None, 1, None)]
    items = spark.createDataFrame(rows, "item_id long, kind string, name string, length long, crc long")
    assert sorted(r.item_id for r in duplicates(items).collect()) == [1, 2, 3, 4]


def test_values(spark):
    row = spark.range(1).select(
        F.lit(b"123456789").alias("data"), F.lit(None).cast("bigint").alias("none"), F.lit(0).cast("bigint").alias("zero"), F.lit(0xCBF43926).alias("crc"),
    )
    hi, lo = (2024 - 1980) << 9 | 12 << 5 | 31, 23 << 11 | 59 << 5 | 29
    got = row.select(
        scalars.content_crc(F.col("data")).alias("crc"), scalars.crc_text(F.col("crc")).alias("hex"), scalars.crc_text(F.col("zero")).alias("hex0"), scalars.crc_text(F.col("none")).alias("hexn"),
        scalars.dos_time(F.lit(hi << 16 | lo)).alias("time"), scalars.dos_time(F.lit(0)).alias("bad_time"), scalars.wide_size(F.lit(3), F.lit(2**32 - 1)).alias("wide"),
        scalars.serial_text(F.lit(0xAB)).alias("serial"), scalars.duration(F.lit(90_061)).alias("long"), scalars.used_percent(F.lit(1).cast("bigint"), F.col("zero")).alias("used"),
        scalars.joined(F.lit("a"), F.lit("b")).alias("j1"), scalars.joined(F.lit("a"), F.lit("")).alias("j2"), scalars.joined(F.lit(None).cast("string"), F.lit("b")).alias("j3"), scalars.joined(F.lit(""), F.lit(None).cast("string")).alias("j4"),
        scalars.options_text(F.lit(False), F.lit(False), F.lit(False)).alias("o1"), scalars.options_text(F.lit(True), F.lit(True), F.lit(True)).alias("o2"),
        scalars.progress_percent(F.lit(15).cast("bigint"), F.lit(10).cast("bigint")).alias("p"), scalars.done_percent(F.lit(1), F.col("zero")).alias("d"),
        scalars.parent_directory(F.lit("/a/b/c.txt")).alias("up"), scalars.extension(F.lit("a.tar.gz")).alias("ext"), scalars.extension(F.lit("none")).alias("no_ext"),
        scalars.size_bytes(F.lit(1234567)).alias("bytes"), scalars.has_flag(F.lit(0xE1), 0xE0).alias("flag"), scalars.mid(F.lit("abcdef"), 2, 3).alias("mid"),
        display.has_preview(F.lit("x.jpg")).alias("jpg"), display.has_preview(F.lit("x.JPG")).alias("JPG"), display.store_path("s/", F.lit("g"), F.lit("/p/"), F.lit("n")).alias("store"),
        scalars.selected_capacity(F.lit(15), F.lit("x")).alias("cap_bad"), scalars.selected_capacity(F.lit(15), F.lit("99")).alias("cap"), scalars.remaining_seconds(F.lit(10), F.lit(0).cast("bigint")).alias("eta"),
    ).first()
    assert (got.hex, got.hex0, got.hexn) == ("CBF43926", "", "") and got.crc == zlib.crc32(b"123456789") == 0xCBF43926
    assert got.time == datetime(2024, 12, 31, 23, 59, 58) and got.bad_time is None and got.wide == 4 * 2**32 - 1
    assert (got.serial, got.long, got.used) == ("0000-00AB", "25:01:01", 0)
    assert (got.j1, got.j2, got.j3, got.j4) == ("a;b", "a", "b", "")
    assert (got.o1, got.o2) == ("(none)", "CRC, File versions, Browsed compressed files") and (got.p, got.d) == (100, 0.0)
    assert (got.up, got.ext, got.no_ext, got.bytes, got.flag, got.mid) == ("/a/b", ".gz", "", "1,234,567 B", True, "cde")
    assert (got.jpg, got.JPG, got.store, got.cap_bad, got.cap, got.eta) == (True, False, "s/g/p/n", None, 99, None)


def test_sheets(spark):
    items = conform(spark.createDataFrame([(1, 1, "File", "a", 2048, 0, None), (2, 1, "Folder", "b", None, None, "x")], "item_id long, volume_id long, kind string, name string, length long, crc long, file_description string"), ITEMS)
    volumes = conform(spark.createDataFrame([(1, "v", "", None, 0, 0)], "volume_id long, name string, volume_label string, from_drive string, total_size long, total_free_space long"), VOLUMES)
    grid = {r.item_id: r for r in display.grid(items, volumes).collect()}
    assert grid[1]["size"] == "2 KB" and grid[2]["size"] == "" and grid[1].crc == "" and grid[1].volume == "v"
    sheet = display.file_sheet(items).first()
    assert sheet.crc == "(not computed)" and sheet.file_version == "(empty)"
    v = display.volume_sheet(volumes).first()
    assert (v.label, v.drive, v.options) == ("(no label)", "(no drive)", "(none)")
