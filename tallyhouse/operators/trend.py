"""Least-squares trends over many snapshots.

A directory's series has one sample per snapshot, so it is at most as long as
the list of snapshots; sums per (snapshot, directory) come first.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.functions import fit
from tallyhouse.functions.scalars import fill_second, rfc3339, size_of, snapshot_ts
from tallyhouse.operators.usage import bytes_column

#: Up to so many snapshots their bytes are columns of one aggregation.
WIDE_SNAPSHOTS = 64


def dir_series(usage: DataFrame, physical: bool = False) -> DataFrame:
    """(snapshot_id, dir, bytes), one row for each directory of each snapshot."""
    return usage.groupBy("snapshot_id", "dir").agg(F.sum(bytes_column(physical)).alias("bytes"))


def timed(rows: DataFrame, snapshots) -> DataFrame:
    """Keep rows of `snapshots` and add `ts`, given as (id, second) pairs."""
    pairs = [part for one, ts in snapshots for part in (F.lit(one), F.lit(ts))]
    second = F.element_at(F.create_map(*pairs), F.col("snapshot_id")).cast("long")
    return rows.where(F.col("snapshot_id").isin([one for one, _ in snapshots])).withColumn("ts", second)


def in_order(snapshots) -> list[tuple[str, int]]:
    """(id, second) pairs by second, then id; the last one is the newest."""
    return sorted(snapshots, key=lambda pair: (pair[1], pair[0]))


def _by_directory(series: DataFrame, snapshots):
    return timed(series, snapshots).groupBy(F.col("dir").alias("path"))


def _moments(snapshots) -> list[Column]:
    """Moments and newest bytes, all in fixed-width buffers; x is days before the newest snapshot."""
    newest_id, newest = snapshots[-1]
    days = (F.col("ts") - F.lit(newest)) / F.lit(float(S.SECONDS_PER_DAY))
    latest = F.max(F.when(F.col("snapshot_id") == newest_id, F.col("bytes"))).alias("latest_bytes")
    return [*fit.moments(F.col("bytes"), days), latest]


def ordered_samples() -> Column:
    """The samples of a directory in order, as an aggregate."""
    gathered = F.sort_array(F.collect_list(F.struct("ts", "snapshot_id", "bytes")))
    return F.transform(gathered, lambda s: F.struct(s["ts"].alias("ts"), s["bytes"].alias("bytes"))).alias("samples")


def directory_trends(series: DataFrame, snapshots) -> DataFrame:
    """Moments, newest bytes and ordered samples per directory.

    `series` has one row per (snapshot_id, dir); snapshots of the same second are
    samples of their own.  A sample list is at most as long as `snapshots`.
    """
    snapshots = in_order(snapshots)
    return _by_directory(series, snapshots).agg(*_moments(snapshots), ordered_samples())


def latest_only(trends: DataFrame) -> DataFrame:
    """Only the directories the newest snapshot still has."""
    return trends.where(F.col("latest_bytes").isNotNull())


def _wide_trends(usage: DataFrame, snapshots, limit: int) -> DataFrame:
    """The `limit` steepest directories with their samples, from a column of bytes for each of `snapshots`.

    Written as SQL expressions, since their number grows with the snapshots and each
    function called on a column costs the driver a round trip.
    """
    places, newest = range(len(snapshots)), len(snapshots) - 1
    days = [(ts - snapshots[-1][1]) / S.SECONDS_PER_DAY for _, ts in snapshots]
    ids = [one.replace("\\", "\\\\").replace("'", "\\'") for one, _ in snapshots]
    own = [F.expr(f"sum(CASE WHEN snapshot_id = '{one}' THEN bytes END) AS _y{i}") for i, one in enumerate(ids)]
    kept = usage.where("snapshot_id IN ({})".format(", ".join(f"'{one}'" for one in ids)))
    wide = kept.groupBy(F.col("dir").alias("path")).agg(*own).where(f"_y{newest} IS NOT NULL")

    def total(value):
        return " + ".join(f"CASE WHEN _y{i} IS NOT NULL THEN {value(i)} ELSE 0 END" for i in places)

    x, y = (lambda i: f"({days[i]!r}D - _mean_x)"), (lambda i: f"(CAST(_y{i} AS DOUBLE) - _mean_y)")
    wide = wide.selectExpr("*", f"CAST({total(lambda i: 1)} AS BIGINT) AS _n").where("_n >= 3")
    wide = wide.selectExpr("*", f"({total(lambda i: f'{days[i]!r}D')}) / _n AS _mean_x", f"({total(lambda i: f'CAST(_y{i} AS DOUBLE)')}) / _n AS _mean_y")
    spreads = [f"{total(lambda i: f'{a(i)} * {b(i)}')} AS {name}" for name, a, b in (("_sxx", x, x), ("_sxy", x, y), ("_syy", y, y))]
    wide = wide.selectExpr("*", *spreads).withColumn("per_day", fit.slope())
    samples = ", ".join(f"CASE WHEN _y{i} IS NOT NULL THEN named_struct('ts', {ts}L, 'bytes', _y{i}) END" for i, (_, ts) in enumerate(snapshots))
    return (
        wide.withColumn("slope_bytes_per_day", F.col("per_day").cast("long"))
        .orderBy(F.desc("slope_bytes_per_day"), "path")
        .limit(limit)
        .select("path", "per_day", "slope_bytes_per_day", fit.r2().alias("r2"), F.expr(f"_y{newest} AS latest_bytes"), F.expr("_n AS n_snapshots"), F.expr(f"array_compact(array({samples})) AS samples"))
    )


def growth_over_n(usage: DataFrame, snapshots, limit: int = 50, fill_target: int | None = None) -> DataFrame:
    """Fastest-growing directories over three or more snapshots.

    `usage` is the stored roll-up, `dir_usage(files)` or `usage_rows(files)`.
    `snapshots` are (id, second) pairs.  A snapshot without the directory is a
    gap in its series, not a zero; directories with fewer than three samples or
    gone from the newest snapshot are left out.

    One aggregation holds a directory's bytes in each snapshot, and the fit is taken
    from those columns: one scan, one shuffle, whether given files or the roll-up.
    Beyond WIDE_SNAPSHOTS the moments of all directories decide which `limit` are
    listed, and only those have their samples gathered.
    """
    if len(snapshots) < 3:
        raise ValueError(f"a trend needs at least 3 snapshots, got {len(snapshots)}")
    snapshots = in_order(snapshots)
    if len(snapshots) <= WIDE_SNAPSHOTS:
        return dated_rows(_wide_trends(usage, snapshots, limit), snapshots, fill_target)
    series = dir_series(usage)
    per_day = fit.slope()
    top = (
        latest_only(_by_directory(series, snapshots).agg(*_moments(snapshots)))
        .where(F.col("_n") >= 3)
        .select(
            "path",
            per_day.alias("per_day"),
            per_day.cast("long").alias("slope_bytes_per_day"),
            fit.r2().alias("r2"),
            "latest_bytes",
            F.col("_n").alias("n_snapshots"),
        )
        .orderBy(F.desc("slope_bytes_per_day"), "path")
        .limit(limit)
    )
    # at most `limit` rows
    chosen = series.join(F.broadcast(top.select(F.col("path").alias("dir"))), "dir", "left_semi")
    return dated_rows(top.join(F.broadcast(_by_directory(chosen, snapshots).agg(ordered_samples())), "path"), snapshots, fill_target)


def dated_rows(top: DataFrame, snapshots, fill_target: int | None) -> DataFrame:
    """The listed directories in order, with the date at which they reach `fill_target`."""
    fill = fill_second(F.lit(snapshots[-1][1]), F.lit(fill_target).cast("long"), F.col("per_day"))
    return (
        top.orderBy(F.desc("slope_bytes_per_day"), "path")
        .select(
            "path",
            "slope_bytes_per_day",
            "r2",
            "latest_bytes",
            "n_snapshots",
            F.col("samples").alias("sample_paths_ts"),
            rfc3339(fill).alias("projected_fill_date"),
        )
    )


def snapshot_totals(files: DataFrame, physical: bool = False) -> DataFrame:
    """(snapshot_id, bytes) over all entries of each snapshot."""
    return files.groupBy("snapshot_id").agg(F.coalesce(F.sum(size_of(physical)), F.lit(0)).alias("bytes"))


def predict(totals: DataFrame, free_bytes: int | None = None) -> DataFrame:
    """When the space runs out, as one row.

    `totals` has (snapshot_id, bytes); `scan_meta` of a store will do for
    logical sizes, so that no file is read.  Snapshots whose id names no time
    are left out, partial ones are not.
    """
    dated = totals.withColumn("ts", snapshot_ts("snapshot_id")).where(F.col("ts").isNotNull())
    summed = dated.agg(
        *fit.moments(F.col("bytes"), F.col("ts") / F.lit(float(S.SECONDS_PER_DAY))),
        F.max_by("bytes", "ts").alias("latest_bytes"),
        F.max("ts").alias("latest_ts"),
    )
    enough = F.col("_n") >= 2
    rate = F.when(enough, fit.slope()).otherwise(F.lit(0.0))
    free = F.lit(free_bytes).cast("long")
    fills = (F.col("rate") > 0) & F.col("free").isNotNull()
    return (
        summed.select(
            "_n",
            "latest_ts",
            F.when(enough, F.col("latest_bytes")).otherwise(0).alias("current_bytes"),
            rate.alias("rate"),
            F.when(enough, fit.r2()).otherwise(0.0).alias("confidence_r2"),
            F.when(enough, free).alias("free"),
        )
        .select(
            "current_bytes",
            F.col("rate").alias("growth_rate_bytes_per_day"),
            F.col("free").alias("free_bytes_now"),
            F.when(fills, rfc3339(fill_second(F.col("latest_ts"), F.col("free"), F.col("rate")))).alias("fill_at"),
            F.when(fills, F.col("free") / F.col("rate")).alias("days_until_fill"),
            "confidence_r2",
            F.when(enough, F.col("_n")).otherwise(0).cast("long").alias("samples"),
            F.when(F.col("_n") == 0, "no snapshots")
            .when(~enough, "insufficient history: at least 2 snapshots with a parseable id needed")
            .when(F.col("rate") <= 0, "usage is flat or shrinking")
            .when(F.col("free").isNull(), "free bytes not given")
            .alias("reason"),
        )
    )


def ols_fit(points: DataFrame, key, x: str, y: str) -> DataFrame:
    """Slope, intercept and r2 of y on x for each key."""
    return points.groupBy(key).agg(*fit.moments(F.col(y), F.col(x))).select(
        key,
        F.col("_n").alias("n"),
        fit.slope().alias("slope"),
        fit.intercept().alias("intercept"),
        fit.r2().alias("r2"),
    )
