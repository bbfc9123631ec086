"""Totals of subtrees by one sweep over rows in path order.

Sorted so that `/` comes before everything else, all rows below a directory follow its
own row directly.  Rows are range-partitioned by that order, and each partition is
walked once with a stack of the directories that are open: a row adds to the top only,
and a directory that closes adds its total to the one below it.  A directory may go on
in the next partitions.  They know it from the path of their first row, whose ancestors
they open as well, and tell their part of it; those few parts are summed afterwards.
So the work is in proportion to the rows, whatever the depth, and a directory that holds
everything is no hot key.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.session import written

#: Rows of a partition, about.
PARTITION_ROWS = 200_000


def path_order(path: Column | str) -> Column:
    """A key under which a directory's subtree is contiguous, right after its own row."""
    return F.translate(F.col(path) if isinstance(path, str) else path, "/", "\x01")


def _above(path: str) -> list[str]:
    """Proper ancestors of a path, the shortest first; the root of an absolute path is "/"."""
    cuts = [i for i, c in enumerate(path) if c == "/"]
    return [path[:i] or "/" for i in cuts if i < len(path) - 1]


def _under(path: str, above: str) -> bool:
    return path.startswith(above if above.endswith("/") else above + "/")


class _Walk:
    """The walk of one partition: rows in, closed directories out."""

    def __init__(self, measures: int):
        self.zero = [0] * measures
        self.stack, self.out = [], []
        self.snapshot, self.index = None, 0

    def close(self, whole: bool) -> None:
        path, sums, index, own, foreign = self.stack.pop()
        if self.stack:
            below = self.stack[-1][1]
            for k, v in enumerate(sums):
                below[k] += v
        self.out.append((self.snapshot, path, index, own, foreign or not whole, sums))

    def row(self, snapshot: str, path: str, opens: bool, values: list[int]) -> None:
        if snapshot != self.snapshot:
            self.end(whole=True)
            first, self.snapshot = self.snapshot is None, snapshot
            if first:
                self.stack = [[above, self.zero.copy(), None, None, True] for above in _above(path)]
        while self.stack and self.stack[-1][0] != path and not _under(path, self.stack[-1][0]):
            self.close(whole=True)
        if opens and not (self.stack and self.stack[-1][0] == path):
            self.stack.append([path, self.zero.copy(), self.index, values, False])
            self.index += 1
        if self.stack:
            sums = self.stack[-1][1]
            for k, v in enumerate(values):
                sums[k] += v

    def end(self, whole: bool) -> None:
        while self.stack:
            self.close(whole)


def path_sweep(rows: DataFrame, measures: list[str], partitions: int | None = None) -> DataFrame:
    """Totals of `measures` over each opening row and all rows below it.

    `rows` has snapshot_id, path, a boolean `opens` and whole-number measures; at most
    one opening row for each snapshot and path, which comes with the measures of its own.
    Returns snapshot_id, path, pre (its place among the snapshot's opening rows in path
    order, from 0), own_<measure> and <measure> of every opening row.  Rows outside any
    opening row count nowhere; null measures count as 0; no rows give none.
    """
    rows = rows.select("snapshot_id", "path", "opens", *(F.coalesce(F.col(m).cast("long"), F.lit(0)).alias(m) for m in measures))
    if partitions is None:
        partitions = max(1, -(-rows.count() // PARTITION_ROWS))
    order = [F.col("snapshot_id"), path_order("path")]
    ranged = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order, F.desc("opens"))
    long = [T.StructField(n, T.LongType()) for n in ("task", "index", *(f"own_{m}" for m in measures), *measures)]
    text = [T.StructField(n, T.StringType()) for n in ("snapshot_id", "path")]
    schema = T.StructType([*text, *long, T.StructField("border", T.BooleanType())])
    kinds = [*[pa.string()] * 2, *[pa.int64()] * len(long), pa.bool_()]

    def batch_of(task, done):
        columns = [[r[0] for r in done], [r[1] for r in done], [task] * len(done), [r[2] for r in done]]
        columns += [[r[3] and r[3][k] for r in done] for k in range(len(measures))]
        columns += [[r[5][k] for r in done] for k in range(len(measures))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, [r[4] for r in done]], kinds)], names=schema.names)

    def run(batches):
        walk, task = _Walk(len(measures)), None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            if task is None and batch.num_rows:
                task = columns[3][0]
            for snapshot, path, opens, _, *values in zip(*columns):
                walk.row(snapshot, path, opens, values)
            if walk.out:
                yield batch_of(task, walk.out)
                walk.out = []
        # what is still open may go on in the next partition
        walk.end(whole=False)
        if walk.out:
            yield batch_of(task, walk.out)

    numbered = ranged.select("snapshot_id", "path", "opens", F.spark_partition_id().cast("long").alias("task"), *measures)
    swept = written(numbered.mapInArrow(run, schema), "swept")
    # a few directories for each partition go over its borders
    parts = swept.where("border").groupBy("snapshot_id", "path").agg(
        *(F.max(c).alias(c) for c in ("task", "index", *(f"own_{m}" for m in measures))), *(F.sum(m).alias(m) for m in measures)
    )
    parts = swept.where("border AND index IS NOT NULL").select("snapshot_id", "path", "task", "index", *(f"own_{m}" for m in measures)).join(
        parts.select("snapshot_id", "path", *measures), ["snapshot_id", "path"]
    )
    whole = swept.where("NOT border").drop("border").unionByName(parts)
    # places in a task, after those of the snapshot's earlier tasks
    first = whole.groupBy("snapshot_id", "task").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("least"))
    earlier = Window.partitionBy("snapshot_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("snapshot_id", "task", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).alias("shift"))
    # one row for each task and snapshot in it
    return whole.join(F.broadcast(first), ["snapshot_id", "task"]).select(
        "snapshot_id", "path", (F.col("index") + F.col("shift")).alias("pre"), *(f"own_{m}" for m in measures), *measures
    )
