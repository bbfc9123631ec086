"""Trend moments kept per directory, so that a trend over N snapshots reads one row per directory.

    <root>/moments/generation=<n>/       one row per directory: n and the sums of x, y, xx, xy, yy
    <root>/moments_of/generation=<n>/    the snapshots they were taken over, one row each
    <root>/moments_heads/<n>             an empty file, made last

x is the second of a snapshot and y the bytes of the directory.  The sums are whole
numbers in decimals, so they can be added when a snapshot is committed and subtracted
when retention drops one, in any order and any number of times, without drifting from
what a full pass would find.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import fit
from tallyhouse.functions.scalars import snapshot_ts
from tallyhouse.operators.trend import dated_rows, in_order, ordered_samples, timed
from tallyhouse.sources.store import SnapshotStore

SUMS = ("n", "sx", "sy", "sxx", "sxy", "syy")
_EXACT = "decimal(38,0)"


def moments_of(usage: DataFrame, sign: int = 1) -> DataFrame:
    """The sums of `usage` (snapshot_id, dir, bytes) per directory; with `sign` -1 to be taken back.

    Snapshots whose id names no time have no place on the axis and are left out.
    """
    dated = usage.withColumn("ts", snapshot_ts("snapshot_id")).where("ts IS NOT NULL")
    series = dated.groupBy("dir", "snapshot_id", "ts").agg(F.sum("bytes").alias("bytes"))
    x, y = F.col("ts").cast("decimal(12,0)"), F.col("bytes").cast("decimal(19,0)")
    parts = {"n": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}
    return series.groupBy("dir").agg(*(F.sum(v.cast(_EXACT) * sign).cast(_EXACT).alias(k) for k, v in parts.items()))


def merged(*moments: DataFrame) -> DataFrame:
    """Sums of sums, without the directories of which nothing is left."""
    rows = moments[0]
    for more in moments[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("dir").agg(*(F.sum(c).cast(_EXACT).alias(c) for c in SUMS)).where("n > 0")


def _spread(a: str, b: str, ab: str) -> Column:
    """Sum of (a - mean a)(b - mean b), exact up to the last division."""
    return F.expr(f"CAST(n * {ab} - CAST({a} * {b} AS {_EXACT}) AS DOUBLE) / CAST(n AS DOUBLE)")


def fitted(moments: DataFrame) -> DataFrame:
    """dir, n_snapshots, per_day and r2 of each directory."""
    day = 86_400.0
    spread = moments.select(
        "dir",
        F.col("n").cast("long").alias("_n"),
        (_spread("sx", "sx", "sxx") / (day * day)).alias("_sxx"),
        (_spread("sx", "sy", "sxy") / day).alias("_sxy"),
        _spread("sy", "sy", "syy").alias("_syy"),
    )
    return spread.select("dir", F.col("_n").alias("n_snapshots"), fit.slope().alias("per_day"), fit.r2().alias("r2"))


class TrendTable:
    """The moments beside a store, over a set of its snapshots.

    Products of sums must stay below 1e38: snapshots times the bytes of the files
    directly in one directory below 1e19; beyond that a read fails, it never wraps.
    """

    def __init__(self, store: SnapshotStore):
        self.store, self.spark, self.root = store, store.spark, store.root

    def _current(self) -> int:
        system, path = self.store._path("moments_heads/*")
        return max((int(s.getPath().getName()) for s in system.globStatus(path) or []), default=0)

    def ids(self) -> list[str]:
        """The snapshots that the moments are over."""
        now = self._current()
        if not now:
            return []
        rows = self.spark.read.schema("snapshot_id string").parquet(f"{self.root}/moments_of/generation={now}")
        return sorted(r["snapshot_id"] for r in rows.collect())

    def moments(self) -> DataFrame:
        now = self._current()
        schema = ", ".join(["dir string", *(f"{c} {_EXACT}" for c in SUMS)])
        if not now:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/moments/generation={now}")

    def refresh(self, ids: list[str] | None = None) -> list[str]:
        """Bring the moments to the snapshots `ids` (all committed ones) and return what changed.

        Reads the moments and the roll-ups of the snapshots that come or go, no others;
        call it after a commit, and before retention removes what it lets go.  A snapshot
        that was replaced must be let go before it is replaced.  Two that refresh at
        once cannot mix: the second to end is refused.
        """
        wanted = set(self.store.ids() if ids is None else (self.store.resolve(one) for one in ids))
        now, have = self._current(), set(self.ids())
        come, go = sorted(wanted - have), sorted(have - wanted)
        if not come and not go:
            return []
        parts = [self.moments()] if now else []
        parts += [moments_of(self.store.usage(*some), sign) for some, sign in ((come, 1), (go, -1)) if some]
        new = now + 1
        if not self.store._mark(f"moments_claims/{new:08d}"):
            raise RuntimeError("the moments are being refreshed by another writer, or one has died: see release")
        merged(*parts).write.mode("overwrite").parquet(f"{self.root}/moments/generation={new}")
        listed = self.spark.createDataFrame([(one,) for one in sorted(wanted)], "snapshot_id string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/moments_of/generation={new}")
        self.store._mark(f"moments_heads/{new:08d}")
        return come + go

    def release(self) -> None:
        """Let the next refresh take the claim of a writer that is known to have died."""
        system, path = self.store._path(f"moments_claims/{self._current() + 1:08d}")
        system.delete(path, False)

    def growth_over_n(self, limit: int = 50, fill_target: int | None = None) -> DataFrame:
        """What `trend.growth_over_n` tells of the snapshots the moments are over.

        One row per directory is read from the moments and one from the newest roll-up,
        however many snapshots there are; the samples are looked up for the listed
        directories only.
        """
        rows = self.spark.createDataFrame([(one,) for one in self.ids()], "snapshot_id string").withColumn("ts", snapshot_ts("snapshot_id"))
        snapshots = in_order([(r["snapshot_id"], r["ts"]) for r in rows.where("ts IS NOT NULL").collect()])
        if len(snapshots) < 3:
            raise ValueError(f"a trend needs at least 3 snapshots, got {len(snapshots)}")
        newest = self.store.usage(snapshots[-1][0]).select("dir", F.col("bytes").alias("latest_bytes"))
        top = (
            fitted(self.moments().where("n >= 3"))
            .join(newest, "dir")
            .withColumn("slope_bytes_per_day", F.col("per_day").cast("long"))
            .orderBy(F.desc("slope_bytes_per_day"), "dir")
            .limit(limit)
        )
        usage = self.store.usage(*(one for one, _ in snapshots)).select("snapshot_id", "dir", "bytes")
        # at most `limit` rows
        chosen = timed(usage.join(F.broadcast(top.select("dir")), "dir", "left_semi"), snapshots).groupBy("dir").agg(ordered_samples())
        return dated_rows(top.join(F.broadcast(chosen), "dir").withColumnRenamed("dir", "path"), snapshots, fill_target)
