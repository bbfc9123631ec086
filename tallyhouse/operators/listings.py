"""What uses the space in one snapshot."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.functions.predicates import all_of, glob
from tallyhouse.functions.scalars import rfc3339, size_of
from tallyhouse.operators.usage import bytes_column


def files_only(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_dir"))


def _file_rows(files: DataFrame, size="size") -> DataFrame:
    """(path, size, ext, mtime) with a readable mtime; applied after the limit."""
    return files.select("path", F.col(size).alias("size"), "ext", rfc3339("mtime").alias("mtime"))


def top_files(files: DataFrame, limit: int = 50, min_size: int = 0, physical: bool = False) -> DataFrame:
    """The largest files."""
    sized = files_only(files).select("path", size_of(physical).alias("size"), "ext", "mtime")
    top = sized.where(F.col("size") >= min_size).orderBy(F.desc("size"), "path").limit(limit)
    return _file_rows(top)


def find_files(files: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Files whose name matches a `*`/`?` glob, largest first."""
    found = files_only(files).where(glob("name", pattern))
    return _file_rows(found.orderBy(F.desc("size"), "path").limit(limit))


def empty_files(files: DataFrame, limit: int = 100) -> DataFrame:
    """Files of size 0, by path."""
    found = files_only(files).where(F.col("size") == 0)
    return _file_rows(found.orderBy("path").limit(limit))


def old_files(files: DataFrame, cutoff: int, limit: int = 100) -> DataFrame:
    """Files last changed before `cutoff`, oldest first; placeholder mtimes do not count."""
    found = files_only(files).where((F.col("mtime") > S.MTIME_FLOOR) & (F.col("mtime") < cutoff))
    return _file_rows(found.orderBy("mtime", "path").limit(limit))


def by_extension(files: DataFrame, limit: int = 30, physical: bool = False) -> DataFrame:
    """Files and bytes per extension; files without one count as `(none)`."""
    return (
        files_only(files)
        .groupBy("ext")
        .agg(F.count("*").alias("files"), F.sum(size_of(physical)).alias("total_size"))
        .select(F.coalesce("ext", F.lit("(none)")).alias("ext"), "files", "total_size")
        .orderBy(F.desc("total_size"), "ext")
        .limit(limit)
    )


def top_dirs(usage: DataFrame, limit: int = 30, physical: bool = False) -> DataFrame:
    """Directories by the bytes lying directly in them.

    `usage` has one row per directory of one snapshot: the stored roll-up, which
    needs no shuffle at all, or `dir_usage(files)`.
    """
    sized = usage.select(F.col("dir").alias("path"), bytes_column(physical).alias("total_size"))
    return sized.orderBy(F.desc("total_size"), "path").limit(limit)


def stats(files: DataFrame, physical: bool = False) -> DataFrame:
    """Counts and sizes, one row per snapshot."""
    size = size_of(physical)
    is_file = ~F.col("is_dir")
    return files.groupBy("snapshot_id").agg(
        F.count_if(is_file).alias("files"),
        F.count_if(F.col("is_dir")).alias("dirs"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.max(size), F.lit(0)).alias("largest_bytes"),
        F.coalesce(F.floor(F.avg(F.when(is_file & (size > 0), size))), F.lit(0))
        .cast("long")
        .alias("avg_bytes"),
    )


def with_scan_meta(stats_rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Complete `stats` with what is known about the scan.

    A snapshot without scan data counts as complete.  Both sides have one row
    per snapshot, so the join is far below any broadcast threshold.
    """
    scans = meta.select(
        "snapshot_id",
        F.col("root").alias("scan_root"),
        # greatest() alone would make a scan without an end last 0 seconds
        F.when(F.col("ended_at").isNotNull(), F.greatest(F.col("ended_at") - F.col("started_at"), F.lit(0))).alias("scan_duration_s"),
        "started_at",
        (~F.col("completed")).alias("partial"),
    )
    return stats_rows.join(scans, "snapshot_id", "left").select(
        *stats_rows.columns,
        F.coalesce("partial", F.lit(False)).alias("partial"),
        "scan_root",
        "scan_duration_s",
        rfc3339("started_at").alias("scanned_at"),
    )


def stats_scalar(stats_rows: DataFrame) -> DataFrame:
    """Only the two totals."""
    return stats_rows.select("snapshot_id", F.col("total_bytes").alias("bytes"), "files")


def scan_bundle(
    files: DataFrame,
    usage: DataFrame,
    top: int | None = None,
    dirs: int | None = None,
    ext: int | None = None,
) -> DataFrame:
    """Stats and, on request, the leading files, directories and extensions in one result.

    Rows are tagged by `section`; `label` is the path or extension.  Each part
    reads only its own columns of the stored snapshot, so nothing is cached.
    """
    none = F.lit(None).cast("long")
    bundle = stats(files).select(
        F.lit("stats").alias("section"),
        F.col("snapshot_id").alias("label"),
        "files",
        "dirs",
        F.col("total_bytes").alias("bytes"),
    )
    parts = []
    if top is not None:
        parts.append(top_files(files, top).select(
            F.lit("top"), "path", none.alias("files"), none.alias("dirs"), "size"))
    if dirs is not None:
        parts.append(top_dirs(usage, dirs).select(
            F.lit("dirs"), "path", none.alias("files"), none.alias("dirs"), "total_size"))
    if ext is not None:
        parts.append(by_extension(files, ext).select(
            F.lit("ext"), "ext", "files", none.alias("dirs"), "total_size"))
    for part in parts:
        bundle = bundle.union(part)
    return bundle


def filter_where(rows: DataFrame, where, limit: int = 1000, order_by=()) -> DataFrame:
    """Rows of any result that meet `where`, at most `limit` of them.

    `where` is text such as `size > 1GB AND ext = 'log'`, or (field, operator,
    value) triples.  Without `order_by` any `limit` rows may be returned.
    """
    kept = rows.where(all_of(rows, where))
    return (kept.orderBy(*order_by) if order_by else kept).limit(limit)
