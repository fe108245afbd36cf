"""Writing a catalogue: tables, CSV export, and the content store."""

from __future__ import annotations

import gzip
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfmark.functions.scalars import drop_drive
from shelfmark.operators.tree import preorder_key
from shelfmark.schema import TABLES, conform, empty

VERSIONS = T.StructType([T.StructField("number", T.LongType()), T.StructField("version", T.StringType())])


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet; items lie by volume, so that a search in few volumes reads few files.

    The tables go to a new version beside those that are there, and only when all are written is it made
    the current one: a save that fails changes nothing, and tables may be saved to where they were opened.
    Tables that aren't given are taken over.
    """
    spark = next(iter(tables.values())).sparkSession
    number, _ = current(spark, folder)
    version = f"{number + 1}-{uuid.uuid4().hex}"
    for name, df in (open_database(spark, folder) | tables).items():
        writer = conform(df, TABLES[name]).write
        (writer.partitionBy("volume_id") if name == "items" else writer).parquet(f"{folder}/{version}/{name}")
    spark.createDataFrame([(number + 1, version)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{folder}/versions")


def current(spark: SparkSession, folder: str) -> tuple[int, str]:
    """Number and folder of the current version; tables without versions lie in the folder itself."""
    try:
        row = spark.read.schema(VERSIONS).parquet(f"{folder}/versions").orderBy(F.desc("number"), "version").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    return (row.number, f"{folder}/{row.version}") if row else (0, folder)


def open_database(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables; columns that older files lack are null, and tables that they lack are empty."""
    out, place = {}, current(spark, folder)[1]
    for name, schema in TABLES.items():
        try:
            out[name] = conform(spark.read.option("mergeSchema", "true").parquet(f"{place}/{name}"), schema)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            out[name] = empty(spark, schema)
    return out


def load_csv(spark: SparkSession, path: str, table: str, names: dict[str, str] | None = None) -> DataFrame:
    """A table of the catalogue from CSV with a header (as export_csv and older programs write it).

    names leads from a column of the file to one of the table, whatever the case; columns of the table's own
    name are taken as they are, others are left out, and missing ones are null. A value that isn't of its
    column's type is null.
    """
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    known = {k.lower(): v for k, v in (names or {}).items()}
    kinds, chosen = {f.name: f.dataType for f in TABLES[table]}, {}
    for c in rows.columns:
        name = known.get(c.lower(), c.lower())
        if name in kinds and not isinstance(kinds[name], T.ArrayType):
            chosen[name] = F.col(f"`{c}`").try_cast(kinds[name]).alias(name)
    return conform(rows.select(*chosen.values()), TABLES[table])


def quoted(c: Column) -> Column:
    """A CSV field: quoted if it holds a comma, a quote or a line end; null is ''."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(rows: DataFrame, columns: list[str], name: str = "line") -> DataFrame:
    return rows.withColumn(name, F.concat_ws(",", *(quoted(F.col(c)) for c in columns)))


EXPORT = ["kind", "name", "path", "extension", "length", "creation_time", "keywords", "description"]
VOLUME_EXPORT = ["drive_format", "drive_type", "total_free_space", "total_size", "volume_label", "guid"]


def export_rows(items: DataFrame, volumes: DataFrame) -> DataFrame:
    """item_id, preorder and the exported columns: those of the volume stand on its own row."""
    drives = volumes.select(F.col("volume_id").alias("_v"), *VOLUME_EXPORT)
    rows = items.join(drives, (F.col("volume_id") == F.col("_v")) & (F.col("kind") == "Volume"), "left")
    return rows.join(preorder_key(items), "item_id").select("item_id", "preorder", *EXPORT, *VOLUME_EXPORT)


def export_csv(items: DataFrame, volumes: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header, in the order of a walk. The order is a range partitioning: the files follow each other."""
    rows = export_rows(items, volumes)
    rows = rows.repartitionByRange(files, "preorder").sortWithinPartitions("preorder") if files else rows.orderBy("preorder")
    rows.drop("item_id", "preorder").write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def store_content(files: DataFrame, guid: str, root: str) -> None:
    """File contents (columns full_name, content) below root, by the volume's guid, at their path without its drive."""
    files.select(F.lit(guid).alias("guid"), drop_drive(F.col("full_name")).alias("path"), "content").write.mode("append").partitionBy("guid").parquet(root)


def read_content(spark: SparkSession, root: str, guid: str) -> DataFrame:
    return spark.read.parquet(root).where(F.col("guid") == guid).select("path", "content")


def _each_file(files: DataFrame, target: Callable[[str], str | None], copy: Callable[[str, str], None]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                out, error = target(path) if path else None, None
                if out:
                    try:
                        copy(path, f"{out}.part-{uuid.uuid4().hex}")
                    except OSError as e:
                        out, error = None, str(e)
                rows.append({"path": path, "written": out, "error": error})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("written", pa.string()), ("error", pa.string())]))

    return files.select("path").mapInArrow(run, "path string, written string, error string")


def _copied(opened: Callable, closed: Callable, source: str, part: str) -> None:
    """A stream from file to file. The part gets its name when it is whole, so a task that runs again does no harm."""
    try:
        with opened(source, "rb") as a, closed(part, "wb") as b:
            shutil.copyfileobj(a, b, 1 << 20)
        os.replace(part, part[: part.rindex(".part-")])
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise


def gzip_files(files: DataFrame) -> DataFrame:
    """Compresses each file of a column path beside itself, as its name with .gz. Hidden files and .gz files are skipped (written is null).

    Rows are path, written, error; files are written when the rows are taken. Paths must be reachable from the executors.
    """
    target = lambda p: None if os.path.basename(p).startswith(".") or p.lower().endswith(".gz") else p + ".gz"
    return _each_file(files, target, lambda a, b: _copied(open, gzip.open, a, b))


def gunzip_files(files: DataFrame) -> DataFrame:
    """Unpacks each .gz file of a column path beside itself, as its name without .gz; others are skipped. Rows as in gzip_files."""
    target = lambda p: p[:-3] if p.lower().endswith(".gz") and not os.path.basename(p).startswith(".") else None
    return _each_file(files, target, lambda a, b: _copied(gzip.open, open, a, b))


def save_gzip(rows: DataFrame, path: str) -> None:
    """Text lines (column value), compressed; reading them again needs no option."""
    rows.select("value").write.mode("overwrite").option("compression", "gzip").text(path)
