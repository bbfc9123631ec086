"""Numbering and running sums over tables of any size, without one task for all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task sorts, about.
BUCKET_ROWS = 4_000


def hash_bucket(keys: list[str], rows: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-rows // BUCKET_ROWS))))


def running(frame: DataFrame, name: str, value: Column, bucket: Column, order: list[str], group: list[str] = ()) -> DataFrame:
    """`frame` with the sum of `value` over all earlier rows as `name`, within each `group`.

    Rows are ordered by `bucket`, then by `order`; rows equal in both follow each other
    in any order.  The sums within buckets and the sums of buckets are taken apart.
    """
    group = list(group)
    frame = frame.withColumns({"_bucket": bucket, "_value": value})
    starts = frame.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        frame.withColumn(name, F.coalesce(F.sum("_value").over(inner), F.lit(0)))
        .join(starts, [*group, "_bucket"])
        .withColumn(name, F.col(name) + F.col("_start"))
        .drop("_bucket", "_value", "_start")
    )
