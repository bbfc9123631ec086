"""What changed between two snapshots.

Both comparisons are an outer join on a key that is unique per side, so they
are written as one aggregation over the two partitions: one scan, one shuffle,
no sort, and the rows of a side that is missing need no special case.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.functions.scalars import dir_change_kind, file_change_kind


def diff(files: DataFrame, a: str, b: str, limit: int | None = 100) -> DataFrame:
    """Files whose size differs between snapshots `a` and `b`, or that only one has.

    The largest changes come first; without a limit all come, in no order.  A
    path that is a directory on either side is left out.
    """
    def on(side):
        return F.max(F.when(F.col("snapshot_id") == side, F.col("size")))

    size_a, size_b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    changed = (
        files.where(F.col("snapshot_id").isin(a, b))
        .groupBy("path")
        .agg(on(a).alias("a"), on(b).alias("b"), F.max("is_dir").alias("any_dir"))
        .where(~F.col("any_dir") & ~F.col("a").eqNullSafe(F.col("b")))
        .select("path", size_a.alias("size_a"), size_b.alias("size_b"))
    )
    kind = file_change_kind(F.col("size_a"), F.col("size_b")).alias("kind")
    delta = (F.col("size_b") - F.col("size_a")).alias("delta")
    rows = changed.select("path", kind, "size_a", "size_b", delta)
    return rows if limit is None else rows.orderBy(F.desc(F.abs("delta")), "path").limit(limit)


def days_between(meta: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the days from scan `a` to scan `b`; 1.0 when unknown or not positive."""
    def start(side):
        return F.max(F.when(F.col("snapshot_id") == side, F.col("started_at")))

    span = start(b) - start(a)
    return meta.where(F.col("snapshot_id").isin(a, b)).agg(
        F.when(span > 0, span / F.lit(float(S.SECONDS_PER_DAY)))
        .otherwise(F.lit(1.0))
        .alias("days_between")
    )


def growth(usage: DataFrame, meta: DataFrame, a: str, b: str, limit: int = 50) -> DataFrame:
    """Directories whose direct bytes differ between `a` and `b`, with the daily rate."""
    def on(side):
        return F.coalesce(F.sum(F.when(F.col("snapshot_id") == side, F.col("bytes"))), F.lit(0))

    changed = (
        usage.where(F.col("snapshot_id").isin(a, b))
        .groupBy(F.col("dir").alias("path"))
        .agg(on(a).alias("size_a"), on(b).alias("size_b"))
        .where(F.col("size_a") != F.col("size_b"))
    )
    days = days_between(meta, a, b).scalar()
    delta = F.col("size_b") - F.col("size_a")
    # All columns come before the limit: two projections behind one would turn
    # the top-k into a full sort.
    return (
        changed.select(
            "path",
            dir_change_kind(F.col("size_a"), F.col("size_b")).alias("kind"),
            "size_a",
            "size_b",
            delta.alias("delta_bytes"),
            (delta / days).alias("rate_bytes_per_day"),
            days.alias("days_between"),
        )
        .orderBy(F.desc(F.abs("delta_bytes")), "path")
        .limit(limit)
    )
