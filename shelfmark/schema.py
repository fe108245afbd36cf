"""The catalogue's four tables and helpers that bring frames to their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


_KINDS = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "ARRAY<BIGINT>": T.ArrayType(T.LongType())}


def _struct(spec: str) -> T.StructType:
    """Columns as "name KIND, ...", without the session that a DDL parser needs."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in spec.split(","))])


#: One row per volume, folder and file. ancestors lists the ids from the root to the parent.
ITEMS = _struct(
    "item_id BIGINT, volume_id BIGINT, parent_id BIGINT, kind STRING, is_container BOOLEAN, name STRING, full_name STRING, extension STRING, "
    "path STRING, depth INT, ancestors ARRAY<BIGINT>, length BIGINT, attributes INT, creation_time TIMESTAMP_NTZ, last_access_time TIMESTAMP_NTZ, "
    "last_write_time TIMESTAMP_NTZ, is_read_only BOOLEAN, keywords STRING, description STRING, comments STRING, company_name STRING, "
    "legal_copyright STRING, product_name STRING, file_description STRING, file_version STRING, crc BIGINT, scan_error STRING"
)
VOLUMES = _struct(
    "volume_id BIGINT, name STRING, drive_format STRING, drive_type STRING, total_free_space BIGINT, total_size BIGINT, volume_label STRING, "
    "guid STRING, scanned TIMESTAMP_NTZ, scanned_crc BOOLEAN, scanned_zip BOOLEAN, scanned_file_version BOOLEAN, serial_number STRING, "
    "physical_location STRING, from_drive STRING, keywords STRING, description STRING"
)
LOGICAL_FOLDERS = _struct("folder_id BIGINT, parent_id BIGINT, name STRING, folder_type STRING, max_size_selected INT, max_size BIGINT, description STRING")
#: A bag: an item tagged twice has two rows.
ITEM_TAGS = _struct("item_id BIGINT, folder_id BIGINT")
ARCHIVE_ENTRIES = _struct(
    "file_name STRING, packed_size BIGINT, unpacked_size BIGINT, file_crc BIGINT, file_time TIMESTAMP_NTZ, file_attributes INT, "
    "is_directory BOOLEAN, continued_from_previous BOOLEAN, continued_on_next BOOLEAN"
)

TABLES = {"items": ITEMS, "volumes": VOLUMES, "logical_folders": LOGICAL_FOLDERS, "item_tags": ITEM_TAGS}

#: The folder types in the order of their numbers, with their labels.
FOLDER_TYPES = {
    "GeneralFolder": "General Folder",
    "PhysicalLocation": "Physical Location",
    "Flag": "Flag",
    "DiscCatalog": "Disc Catalog",
    "VolumeType": "Volume Type",
    "Person": "Person",
    "Disc": "Disc",
}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns: missing ones are null, others go."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def required(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
