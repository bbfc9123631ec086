"""Listings in, typed `files` rows out."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.functions import paths

#: Scheme and authority in front of a path, as in `s3a://bucket/key`.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"

FILES_COLUMNS = [field.name for field in S.FILES.fields]


def read_manifest(spark: SparkSession, path: str, fmt: str = "parquet", schema=S.MANIFEST) -> DataFrame:
    """A folder of listing exports in Parquet, ORC, CSV (with header) or JSON lines."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def derive_columns(listing: DataFrame, root: str = "/") -> DataFrame:
    """Complete listing rows to `files` rows: name, extension, depth, clean sizes."""
    is_dir = F.coalesce("is_dir", F.lit(False))
    name = paths.base_name("path")
    return listing.select(
        "path",
        name.alias("name"),
        F.when(~is_dir, paths.extension(name)).alias("ext"),
        F.when(is_dir, F.lit(0)).otherwise(F.coalesce("size", F.lit(0))).cast("long").alias("size"),
        F.when(~is_dir, F.col("physical_size")).alias("physical_size"),
        F.when(F.col("mtime") >= 0, F.col("mtime")).alias("mtime"),
        is_dir.alias("is_dir"),
        paths.depth_below("path", root).alias("depth"),
        "snapshot_id",
    )


def missing_directories(files: DataFrame, root: str = "/", mtime: int | None = None) -> DataFrame:
    """Directory rows a flat listing lacks: every ancestor of an entry, from `root` down.

    Directories are made distinct before their ancestors are exploded, so the
    explosion costs directories times depth rather than files times depth.
    Directories that are listed already are left out.
    """
    own = files.select("snapshot_id", paths.parent_dir("path").alias("path"))
    found = paths.explode_ancestors(own.distinct(), "path", "path", include_self=True)
    top = root.rstrip("/")
    if top:
        found = found.where((F.col("path") == top) | F.startswith("path", F.lit(f"{top}/")))
    marked = found.withColumn("listed", F.lit(False)).unionByName(
        files.where("is_dir").select("snapshot_id", "path", F.lit(True).alias("listed"))
    )
    lacking = marked.groupBy("snapshot_id", "path").agg(F.max("listed").alias("listed")).where("NOT listed")
    none = F.lit(None).cast("long")
    bare = lacking.select(
        "snapshot_id",
        "path",
        none.alias("size"),
        none.alias("physical_size"),
        F.lit(mtime).cast("long").alias("mtime"),
        F.lit(True).alias("is_dir"),
    )
    return derive_columns(bare, root).select(FILES_COLUMNS)


def derive_directories(files: DataFrame, root: str = "/", mtime: int | None = None) -> DataFrame:
    """`files` and the directory rows it lacks.

    The input is read twice; to read a costly source once, let
    `SnapshotStore.write` add the directories from what it stored.
    """
    return files.select(FILES_COLUMNS).unionByName(missing_directories(files, root, mtime))


def ingest_manifest(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    root: str = "/",
    directories: bool = False,
) -> DataFrame:
    """Listing exports as `files` rows, with directory rows added on request."""
    files = derive_columns(read_manifest(spark, path, fmt), root)
    return derive_directories(files, root) if directories else files


def ingest_listing(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    """List a folder, given by its absolute path, through the file source; contents are never read.

    Spark holds such a listing on the driver and skips names that begin with
    `_` or `.`, so manifests are the way to ingest a large store.
    """
    entries = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            F.lit(snapshot_id).alias("snapshot_id"),
            F.regexp_replace("path", _SCHEME, "").alias("path"),
            F.col("length").alias("size"),
            F.lit(None).cast("long").alias("physical_size"),
            F.unix_timestamp("modificationTime").alias("mtime"),
            F.lit(False).alias("is_dir"),
        )
    )
    inside = re.sub(_SCHEME, "", root)
    return derive_directories(derive_columns(entries, inside), inside)
