"""Bytes per directory, the common input of every directory question.

`dir_usage(files)` and the roll-up a store keeps have one row per directory and
snapshot.  `usage_rows(files)` has the same columns ungrouped, one row per file,
for operators that sum by directory anyway: they then need one shuffle from
files, and from the roll-up never touch files at all.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.paths import parent_dir


def usage_rows(files: DataFrame) -> DataFrame:
    """Each file as a contribution to the directory it lies in."""
    return files.where(~F.col("is_dir")).select(
        "snapshot_id",
        parent_dir("path").alias("dir"),
        F.lit(1).cast("long").alias("files"),
        F.col("size").alias("bytes"),
        F.coalesce("physical_size", "size").alias("physical_bytes"),
    )


def dir_usage(files: DataFrame) -> DataFrame:
    """Totals of the files directly in each directory, per snapshot."""
    return (
        usage_rows(files)
        .groupBy("snapshot_id", "dir")
        .agg(
            F.sum("files").alias("files"),
            F.sum("bytes").alias("bytes"),
            F.sum("physical_bytes").alias("physical_bytes"),
        )
    )


def bytes_column(physical: bool):
    return F.col("physical_bytes" if physical else "bytes")
