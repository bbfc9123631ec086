"""Where files were changed lately."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.paths import parent_dir
from tallyhouse.functions.scalars import safe_ratio


def churn(files: DataFrame, cutoff: int, limit: int = 50) -> DataFrame:
    """Directories by the bytes of their files changed after `cutoff`."""
    recent = F.col("mtime") > cutoff
    return (
        files.where(~F.col("is_dir"))
        .groupBy(parent_dir("path").alias("path"))
        .agg(
            F.count_if(recent).alias("recent_files"),
            F.coalesce(F.sum(F.when(recent, F.col("size"))), F.lit(0)).alias("recent_bytes"),
            F.count("*").alias("total_files"),
            F.sum("size").alias("total_bytes"),
        )
        .where(F.col("recent_files") > 0)
        .withColumn("churn_score", safe_ratio("recent_bytes", "total_bytes"))
        .orderBy(F.desc("recent_bytes"), "path")
        .limit(limit)
    )
