"""Directories that could be cleaned up, and what that would free."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.functions.paths import base_name, contains_any, explode_ancestors, parent_dir
from tallyhouse.session import written


def category_names(categories=None) -> dict[str, str]:
    """Directory name -> category; unknown categories are ignored, None means all."""
    chosen = S.CLEANUP_CATEGORIES if categories is None else categories
    return {name: c for c in chosen for name in S.CLEANUP_CATEGORIES.get(c, ())}


def protected(path: Column | str) -> Column:
    """True for paths that are never cleanup candidates."""
    return contains_any(path, S.PROTECTED_SUBSTRINGS)


def _category(names: dict[str, str]) -> Column:
    pairs = ", ".join(f"'{part}'" for pair in names.items() for part in pair)
    return F.expr(f"element_at(map({pairs}), substring_index(path, '/', -1))")


def cleanup_targets(files: DataFrame, categories=None) -> DataFrame:
    """(category, path) of every candidate directory."""
    names = category_names(categories)
    named = files.where(F.col("is_dir") & F.col("name").isin(list(names)) & ~protected("path"))
    return named.select(_category(names).alias("category"), "path")


def outermost(targets: DataFrame) -> DataFrame:
    """Targets that lie in no other target."""
    above = explode_ancestors(targets.select("path"), "path", "above")
    # Common ancestors such as the root have no candidate name and go at once.
    above = above.where(base_name("above").isin(list(category_names())))
    nested = above.join(targets.select(F.col("path").alias("above")), "above", "left_semi")
    return targets.join(nested.select("path").distinct(), "path", "left_anti")


def cleanup_totals(files: DataFrame, categories=None, usage: DataFrame | None = None) -> DataFrame:
    """(category, path, bytes, files) of every candidate directory, empty ones included.

    The usage of a directory is credited to the candidate names above it and
    the candidates join in as rows of zero bytes, so that one aggregation takes
    the place of the prefix join of files and targets; names that turn out not
    to be candidates have no such row.  A file in nested candidates counts for
    each.
    """
    names = category_names(categories)
    if not names:
        none = "category string, path string, bytes long, files long"
        return files.sparkSession.createDataFrame([], none)
    if usage is None:
        return _totals_of_files(files, names)
    inside = usage.where(contains_any("dir", names)).select("dir", "bytes", "files")
    above = explode_ancestors(inside, "dir", "path", include_self=True)
    credits = above.where(base_name("path").isin(list(names)))
    targets = cleanup_targets(files, categories).select(
        "path", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("files"), F.lit(True).alias("listed")
    )
    return (
        credits.select("path", "bytes", "files", F.lit(False).alias("listed"))
        .unionByName(targets)
        .groupBy("path")
        .agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.max("listed").alias("listed"))
        .where("listed")
        .select(_category(names).alias("category"), "path", "bytes", "files")
    )


def _totals_of_files(files: DataFrame, names: dict[str, str]) -> DataFrame:
    """`cleanup_totals` in one read of the entries.

    A file stands for its directory, a directory row for itself; sums per directory come
    first, so that only directories are exploded, into the candidate names above them.
    """
    target = F.col("is_dir") & F.col("name").isin(list(names)) & ~protected("path")
    inside = ~F.col("is_dir") & contains_any("path", [f"{name}/" for name in names])
    zero = F.lit(0).cast("long")
    own = (
        files.where(target | inside)
        .groupBy(F.when(F.col("is_dir"), F.col("path")).otherwise(parent_dir("path")).alias("dir"))
        .agg(
            F.sum(F.when(F.col("is_dir"), zero).otherwise(F.col("size"))).alias("bytes"),
            F.count_if(~F.col("is_dir")).alias("files"),
            F.max("is_dir").alias("target"),
        )
    )
    credits = explode_ancestors(own, "dir", "path", include_self=True).where(base_name("path").isin(list(names)))
    return (
        credits.select("path", "bytes", "files", (F.col("target") & (F.col("path") == F.col("dir"))).alias("listed"))
        .groupBy("path")
        .agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.max("listed").alias("listed"))
        .where("listed")
        .select(_category(names).alias("category"), "path", "bytes", "files")
    )


def tree_targets(tree: DataFrame, categories=None) -> DataFrame:
    """(category, path, bytes, files) of every candidate directory, read off its row in the numbered tree."""
    names = category_names(categories)
    if not names:
        return tree.sparkSession.createDataFrame([], "category string, path string, bytes long, files long")
    named = tree.where(F.col("depth").isNotNull() & base_name("path").isin(list(names)) & ~protected("path"))
    return named.select(_category(names).alias("category"), "path", "bytes", "files")


def cleanup_scan(
    files: DataFrame,
    categories=None,
    limit: int = 100,
    usage: DataFrame | None = None,
    outermost_only: bool = False,
    tree: DataFrame | None = None,
) -> DataFrame:
    """The candidate directories that hold the most bytes.

    Given the numbered `tree` of the snapshot, neither files nor usage are read.
    """
    hits = cleanup_totals(files, categories, usage) if tree is None else tree_targets(tree, categories)
    if outermost_only:
        hits = outermost(hits)
    return hits.orderBy(F.desc("bytes"), "path").limit(limit).select("category", "path", "bytes", "files")


def cleanup_summary(hits: DataFrame, total: bool = False) -> DataFrame:
    """Paths, bytes and files per category; with `total`, a row with category NULL for all."""
    grouped = hits.rollup("category") if total else hits.groupBy("category")
    return grouped.agg(
        F.count("path").alias("paths"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
    ).orderBy(F.desc("bytes"), F.asc_nulls_last("category"))


def after_cleanup(files: DataFrame, hits: DataFrame) -> DataFrame:
    """The inventory as it would be without the trees in `hits`.

    Whether a row goes depends on its directory alone, so the ancestors of
    distinct directories are looked up, not those of every file.  The
    directories to drop are written to a working folder first: their true size
    then decides whether Spark broadcasts them, which leaves the files where
    they are, or shuffles both sides.  That write is a job of its own.
    """
    own = F.when(F.col("is_dir"), F.col("path")).otherwise(parent_dir("path"))
    placed = files.withColumn("_own", own)
    above = explode_ancestors(placed.select("_own").distinct(), "_own", "path", include_self=True)
    if "category" in hits.columns:
        above = above.where(base_name("path").isin(list(category_names())))
    doomed = above.join(hits.select("path"), "path", "left_semi").select("_own").distinct()
    return placed.join(written(doomed, "doomed"), "_own", "left_anti").drop("_own")
