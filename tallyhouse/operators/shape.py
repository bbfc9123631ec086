"""The shape of a directory's growth.

Works on series as ordered arrays of (ts, bytes), one sample per snapshot.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.functions import fit
from tallyhouse.operators.trend import directory_trends


def stride_list(samples: str = "samples") -> Column:
    """Signed differences between neighbouring samples; empty for fewer than two."""
    sizes = F.transform(samples, lambda s: s["bytes"])
    n = F.size(samples)
    return F.when(
        n >= 2,
        F.zip_with(F.slice(sizes, 2, n - 1), F.slice(sizes, 1, n - 1), lambda later, earlier: later - earlier),
    ).otherwise(F.array().cast("array<bigint>"))


def strides(series: DataFrame) -> DataFrame:
    """Rows (path, idx, stride) of a series; idx counts from 0."""
    return series.select("path", F.posexplode(stride_list()).alias("idx", "stride"))


def median(values: Column) -> Column:
    """Middle of a sorted copy, or the mean of the middle two; NULL when empty."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low.cast("double") + high.cast("double")) / 2


def with_strides(series: DataFrame) -> DataFrame:
    """Add n_strides, stride_median, max_stride and max_stride_index (the last of equals)."""
    sized = series.withColumn("_strides", F.transform(stride_list(), lambda d: F.abs(d)))
    largest = F.array_max(F.transform("_strides", lambda d, i: F.struct(d.alias("size"), i.alias("idx"))))
    return (
        sized.withColumn("_largest", largest)
        .select(
            *series.columns,
            F.size("_strides").alias("n_strides"),
            median(F.col("_strides")).alias("stride_median"),
            F.col("_largest.size").alias("max_stride"),
            F.col("_largest.idx").alias("max_stride_index"),
        )
    )


def _mean_step_days() -> Column:
    first, last = F.get("samples", F.lit(0))["ts"], F.element_at("samples", -1)["ts"]
    span = (last - first) / F.lit(float(S.SECONDS_PER_DAY))
    # Without a span the step is one second, the unit timestamps are kept in.
    return F.when(span > 0, span / (F.col("_n") - 1)).otherwise(1.0 / S.SECONDS_PER_DAY)


def classify(trends: DataFrame) -> DataFrame:
    """Add `pattern` to the output of `directory_trends`.

    declining   the fitted line falls by 1 % of the mean per step, fitting well
    stable      no change at all, or no stride stands out
    log_shaped  one stride dominates, early in the series
    burst       one stride dominates, later
    unknown     too few samples, or in between
    """
    per_step = F.try_divide(fit.slope() * _mean_step_days(), F.col("_mean_y"))
    falling = per_step <= S.DECLINING_SLOPE_SHARE
    declining = (F.col("_mean_y") > 0) & falling & (fit.r2() >= S.DECLINING_R2)
    early = F.col("max_stride_index") < F.floor(F.col("n_strides") / S.EARLY_SPIKE_DIVISOR)
    spike = F.when(early, "log_shaped").otherwise("burst")
    ratio = F.try_divide(F.col("max_stride").cast("double"), F.col("stride_median"))
    pattern = (
        F.when(F.col("_n") < S.MIN_SHAPE_SAMPLES, "unknown")
        .when(declining, "declining")
        .when(F.col("max_stride") == 0, "stable")
        .when(F.col("stride_median") == 0, spike)
        .when(ratio > S.SPIKE_RATIO, spike)
        .when(ratio < S.STABLE_RATIO, "stable")
        .otherwise("unknown")
    )
    return with_strides(trends).withColumn("pattern", pattern)


def classify_pattern(series: DataFrame, snapshots) -> DataFrame:
    """(path, n_samples, pattern) for rows of `dir_series`."""
    return classify(directory_trends(series, snapshots)).select(
        "path", F.col("_n").alias("n_samples"), "pattern"
    )
