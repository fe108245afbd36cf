"""Tables of other kinds, seen as catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Where the ids of nations, customers and orders start, so that all items have ids of their own.
NATION, CUSTOMER, ORDER = 1_000, 1_000_000, 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: brands are volumes, sizes are lengths, brand and type are keywords."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("bigint").alias("volume_id"),
        F.lit("File").alias("kind"),
        F.col("p_name").alias("name"),
        F.col("p_size").cast("bigint").alias("length"),
        F.concat_ws(";", "p_brand", "p_type").alias("keywords"),
        F.lit(None).cast("bigint").alias("crc"),
    )


def docs_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: characters are lengths, sources and languages are folders."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("item_id"),
        F.lit("File").alias("kind"),
        F.concat_ws("", F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.concat_ws("/", "source", "lang").alias("path"),
        F.col("n_chars").alias("length"),
        F.crc32(F.col("text").cast("binary")).alias("crc"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        F.concat_ws(";", "lang", "source").alias("keywords"),
        "lang",
        "source",
    )


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files below their customers."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_orderkey") + ORDER).alias("item_id"),
        (F.col("o_custkey") + CUSTOMER).alias("parent_id"),
        F.lit("File").alias("kind"),
        F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("name"),
        F.round("o_totalprice").cast("bigint").alias("length"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("creation_time"),
        F.col("o_orderpriority").alias("keywords"),
    )


def order_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as volumes, nations and customers as folders, with ancestors."""
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    region = F.col("r_regionkey").cast("bigint")
    nation, none = F.col("n_nationkey").cast("bigint") + NATION, F.lit(None).cast("bigint")
    volumes = r.select(region.alias("item_id"), none.alias("parent_id"), region.alias("volume_id"), F.lit("Volume").alias("kind"), F.col("r_name").alias("name"), F.array().cast("array<bigint>").alias("ancestors"))
    own = F.col("n_regionkey").cast("bigint")
    nations = n.select(nation.alias("item_id"), own.alias("parent_id"), own.alias("volume_id"), F.lit("Folder").alias("kind"), F.col("n_name").alias("name"), F.array(own).alias("ancestors"))
    held = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    customers = held.select((F.col("c_custkey") + CUSTOMER).alias("item_id"), nation.alias("parent_id"), own.alias("volume_id"), F.lit("Folder").alias("kind"), F.col("c_name").alias("name"), F.array(own, nation).alias("ancestors"))
    return volumes.unionAll(nations).unionAll(customers)


def orders_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree of regions, nations, customers and orders."""
    folders = order_folders(spark, sf_dir)
    above = folders.where("kind = 'Folder'").select(F.col("item_id").alias("_folder"), "volume_id", F.concat("ancestors", F.array("item_id")).alias("ancestors"))
    files = order_files(spark, sf_dir).join(above, F.col("parent_id") == F.col("_folder")).drop("_folder")
    return folders.unionByName(files, allowMissingColumns=True)


def region_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as logical folders: even regions are discs, the others places; nations are general folders."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    key = F.col("r_regionkey").cast("bigint")
    regions = r.select(key.alias("folder_id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 0, "Disc").otherwise("PhysicalLocation").alias("folder_type"))
    nations = n.select((F.col("n_nationkey").cast("bigint") + NATION).alias("folder_id"), F.col("n_regionkey").cast("bigint").alias("parent_id"), F.col("n_name").alias("name"), F.lit("GeneralFolder").alias("folder_type"))
    return regions.unionAll(nations)


def customer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders tagged with the nation of their customer."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select((F.col("o_orderkey") + ORDER).alias("item_id"), (F.col("c_nationkey").cast("bigint") + NATION).alias("folder_id"))
