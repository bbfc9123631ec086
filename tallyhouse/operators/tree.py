"""Totals of whole subtrees."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.paths import base_name, explode_ancestors, parent_dir
from tallyhouse.operators.sweep import path_sweep
from tallyhouse.session import written

_SUMS = ("files", "bytes", "physical_bytes")


def directory_tree(usage: DataFrame, files: DataFrame) -> DataFrame:
    """The numbered directory tree of each snapshot, one row per directory, empty ones included.

    `usage` is the roll-up of the snapshots, `files` their entries, of which only the
    directory rows are read.  Columns: snapshot_id, path, depth (NULL for a directory
    that holds files but has no row), pre and last (the places of the first and the last
    directory of its subtree in path order: another directory lies below it exactly if
    its pre is between them), own_files, own_bytes, own_physical_bytes of the files
    directly in it, and files, bytes, physical_bytes of all below it.
    """
    none = [F.lit(0).cast("long").alias(c) for c in _SUMS]
    listed = files.where("is_dir").select("snapshot_id", "path", "depth", *none)
    own = usage.select("snapshot_id", F.col("dir").alias("path"), F.lit(None).cast("int").alias("depth"), *_SUMS)
    rows = listed.unionByName(own).groupBy("snapshot_id", "path").agg(
        F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in _SUMS), F.lit(1).alias("dirs"), F.lit(True).alias("opens")
    )
    # depths are carried as a measure of their own that starts at 1
    rows = rows.withColumn("level", F.coalesce(F.col("depth") + 1, F.lit(0)))
    # counted, sampled and sorted by the sweep: summed once
    swept = path_sweep(written(rows, "directories"), ["dirs", "level", *_SUMS])
    return swept.select(
        "snapshot_id",
        "path",
        F.when(F.col("own_level") > 0, F.col("own_level") - 1).cast("int").alias("depth"),
        "pre",
        (F.col("pre") + F.col("dirs") - 1).alias("last"),
        *(f"own_{c}" for c in _SUMS),
        *_SUMS,
    )


def tree_sizes(tree: DataFrame, physical: bool = False) -> DataFrame:
    """What `subtree_sizes` tells, and snapshot_id, read off the numbered tree without an aggregation.

    Directories without any file below them are left out, as there.
    """
    size = F.col("physical_bytes" if physical else "bytes")
    return tree.where("files > 0").select("snapshot_id", "path", size.alias("bytes"), "files")


def tree_children(tree: DataFrame, files: DataFrame, parent: str, limit: int | None = 500) -> DataFrame:
    """What `children` tells, from the numbered tree; of `files` only those directly in `parent` count."""
    base = parent.rstrip("/")
    below = F.startswith("path", F.lit(f"{base}/")) & (F.col("path") != f"{base}/")
    direct = F.substring_index("path", "/", base.count("/") + 2) == F.col("path")
    dirs = tree.where(below & direct & F.col("depth").isNotNull()).select("path", F.lit(True).alias("is_dir"), "depth", F.col("bytes").alias("size"))
    own = files.where(below & ~F.col("is_dir") & (parent_dir("path") == (base or "/") if base else direct)).select("path", "is_dir", "depth", "size")
    rows = dirs.unionByName(own).select("path", base_name("path").alias("name"), "is_dir", "size", "depth").orderBy(F.desc("size"), "path")
    return rows if limit is None else rows.limit(limit)


def subtree_sizes(usage: DataFrame, physical: bool = False) -> DataFrame:
    """Bytes and files below each directory at any depth, as (path, bytes, files).

    Give it the stored roll-up or `dir_usage(files)`: exploding directories
    instead of files divides the work by the files per directory.  The top
    directories receive a row from everywhere; sums combine before the shuffle,
    so each task sends one row for them.
    """
    size = F.col("physical_bytes" if physical else "bytes")
    own = usage.select("dir", size.alias("bytes"), "files")
    return (
        explode_ancestors(own, "dir", "path", include_self=True)
        .groupBy("path")
        .agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))
    )


def children(files: DataFrame, parent: str, limit: int | None = 500) -> DataFrame:
    """Direct children of `parent`, directories with their subtree total, largest first.

    Only rows below `parent` are read (a prefix filter the Parquet scan takes
    over) and each counts towards the one child it belongs to.
    """
    base = parent.rstrip("/")
    child = F.expr(f"substring_index(path, '/', {base.count('/') + 2})")
    own = F.col("path") == F.col("child")
    listed = (
        files.where(F.startswith("path", F.lit(f"{base}/")))
        .withColumn("child", child)
        .where(F.col("child") != f"{base}/")
        .groupBy("child")
        .agg(
            F.max(F.when(own, F.col("is_dir"))).alias("is_dir"),
            F.max(F.when(own, F.col("depth"))).alias("depth"),
            F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size"))), F.lit(0)).alias("size"),
        )
        .where(F.col("is_dir").isNotNull())
        .select(F.col("child").alias("path"), base_name("child").alias("name"), "is_dir", "size", "depth")
        .orderBy(F.desc("size"), "path")
    )
    return listed if limit is None else listed.limit(limit)


def scan_roots(files: DataFrame) -> DataFrame:
    """(snapshot_id, root): the directory at depth 0 of each snapshot that has one."""
    tops = files.where((F.col("depth") == 0) & F.col("is_dir"))
    return tops.groupBy("snapshot_id").agg(F.min("path").alias("root"))


def root_total(files: DataFrame) -> DataFrame:
    """The root of one snapshot and the bytes of all its files, as one row."""
    root = scan_roots(files).agg(F.min("root"))
    total = files.where(~F.col("is_dir")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
    return total.select(F.coalesce(root.scalar(), F.lit("/")).alias("root"), "total_bytes")
