"""Landing listing exports as they arrive.

Rows land exactly once in a Parquet folder that only the stream writes.
`stream_commit` commits a snapshot from there as soon as its end mark has come
and all its entries are in; `stream_counts` keeps live counts without entries
that were sent again.
"""

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyhouse import schema as S
from tallyhouse.functions import paths
from tallyhouse.functions.hashes import hash_test
from tallyhouse.session import NO_SHUFFLE_KEPT, PACKED, hadoop_path, settings, unsorted_partitions
from tallyhouse.sources.manifest import FILES_COLUMNS, derive_columns
from tallyhouse.sources.store import SnapshotStore, TooFewRows

#: An end mark: the snapshot is complete when so many different paths are in; without a number, at once.
END_MARK = "snapshot_id string, entries long, started_at long, ended_at long"

_COUNTS = "snapshot_id string, entries long, bytes long, batch long"
#: A path that has come, and the microsecond it did.
_SEEN = "snapshot_id string, path string, size long, arrived long"
#: Beyond so many folders of paths that have come they are made one.
MOST_FOLDERS = 100

_ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
#: State in files instead of the heap: an executor holds part of it in bounded memory, and a batch saves its changes only.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKSDB}.changelogCheckpointing.enabled": "true",
    f"{_ROCKSDB}.boundedMemoryUsage": "true",
    f"{_ROCKSDB}.trackTotalNumberOfRows": "false",
}


def stream_manifest(
    spark: SparkSession, path: str, fmt: str = "parquet", root: str = "/", files_per_trigger: int | None = None
) -> DataFrame:
    """New listing exports below `path` as a stream of `files` rows."""
    reader = spark.readStream.schema(S.MANIFEST).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return derive_columns(reader.load(path), root)


def stream_ingest(entries: DataFrame, landing: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of entries to `landing`, taking what is there now and stopping.

    Runs again from `checkpoint`: exports already taken are not taken twice.
    """
    writer = (
        entries.writeStream.format("parquet")
        .partitionBy("snapshot_id")
        .options(**PACKED)
        .option("path", landing)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    with unsorted_partitions(entries.sparkSession):
        return writer.start()


def running_counts(entries: DataFrame) -> DataFrame:
    """Entries and bytes per snapshot so far; on a stream use update or complete mode.

    State is one row per snapshot.
    """
    return entries.groupBy("snapshot_id").agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("size"))), F.lit(0)).alias("bytes"),
    )


def landed(spark: SparkSession, landing: str) -> DataFrame:
    """The rows landed so far, ready to be committed."""
    return spark.read.schema(S.FILES).parquet(landing)


def stream_counts(entries: DataFrame, folder: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """Write running counts of a stream to `folder` as they change, taking what is there now and stopping.

    A path that comes again for its snapshot within `delay` of its first arrival
    is not counted again; the first counts, also in a batch.  The time is that of
    arrival, so that no entry is ever too late to count.  Two streams follow each
    other, each started again from where it was: the first, which is over when
    this returns, keeps the entries that are new and counts them by batch, the
    second adds these counts up.
    Below `checkpoint` lie the paths of the last `delay`, in Parquet, and one row
    of state per snapshot.  Each batch replaces what an attempt before it wrote.
    """
    spark, fresh = entries.sparkSession, f"{checkpoint}/fresh"
    _arrival(spark, delay)
    system, path = hadoop_path(spark, fresh)
    system.mkdirs(path)

    def take(rows: DataFrame, batch: int) -> None:
        with settings(rows.sparkSession, {"spark.sql.adaptive.enabled": "true", **NO_SHUFFLE_KEPT}):
            new = _keep_new(rows, batch, f"{checkpoint}/seen", delay)
            running_counts(new).coalesce(1).write.mode("overwrite").parquet(f"{fresh}/batch={batch}")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    arriving = entries.select("snapshot_id", "path", "size").writeStream.option("checkpointLocation", f"{checkpoint}/arrivals")
    arriving.foreachBatch(take).trigger(availableNow=True).start().awaitTermination()
    # one file, and so one batch, for each batch of the first stream
    counted = spark.readStream.schema(_COUNTS).option("maxFilesPerTrigger", 1).parquet(fresh)
    totals = counted.groupBy("snapshot_id").agg(F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"))
    writer = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True)
    with settings(spark, STATE_ON_DISK):
        return writer.start()


def _arrival(spark: SparkSession, delay: str) -> tuple[int, int]:
    """Now and `delay` before, in microseconds."""
    return tuple(spark.sql("SELECT unix_micros(now()), unix_micros(now() - CAST(:delay AS INTERVAL))", args={"delay": delay}).first())


def _keep_new(rows: DataFrame, batch: int, seen: str, delay: str) -> DataFrame:
    """Add the entries of a batch that have not come within `delay` to the folders below `seen`, and return them.

    One aggregation holds the batch and those earlier paths that pass a bitmap of
    the batch's, so what is shuffled grows with the batch; the others are scanned.
    """
    spark = rows.sparkSession
    now, earliest = _arrival(spark, delay)
    system, path = hadoop_path(spark, f"{seen}/*-*-*")
    found = [f.getPath() for f in system.globStatus(path) or []]
    # <batch>-<last arrival in it>-<any>, so that a merge and what it merges can stand side by side
    parts = {f: [int(x) for x in f.getName().split("-")[:2]] for f in found}
    for f, (n, last) in parts.items():
        if n >= batch or last < earliest:
            system.delete(f, True)
    kept = [f for f, (n, last) in parts.items() if n < batch and last >= earliest]

    def put(made: DataFrame, n: int, last: int) -> str:
        folder = f"{seen}/{n}-{last}-{uuid.uuid4().hex}"
        made.write.options(**PACKED).parquet(folder)
        return folder

    def read(*folders: str) -> DataFrame:
        return spark.read.schema(_SEEN).parquet(*folders)

    if len(kept) > MOST_FOLDERS:
        before = read(*(f.toString() for f in kept)).where(F.col("arrived") >= earliest)
        merged = put(before, max(parts[f][0] for f in kept), max(parts[f][1] for f in kept))
        for f in kept:
            system.delete(f, True)
        kept = [hadoop_path(spark, merged)[1]]
    both = rows.select("snapshot_id", "path", "size", F.lit(False).alias("again"))
    if kept:
        came = hash_test(rows.select("snapshot_id", "path"), rows.count())
        before = read(*(f.toString() for f in kept)).where((F.col("arrived") >= earliest) & came("snapshot_id", "path"))
        both = both.unionByName(before.select("snapshot_id", "path", F.lit(None).cast("long").alias("size"), F.lit(True).alias("again")))
    once = both.groupBy("snapshot_id", "path").agg(F.first("size").alias("size"), F.max("again").alias("again")).where("NOT again")
    return read(put(once.select("snapshot_id", "path", "size", F.lit(now).alias("arrived")), batch, now))


def latest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The last counts of each snapshot that `stream_counts` wrote."""
    written = spark.read.schema(_COUNTS).parquet(folder)
    last = written.groupBy("snapshot_id").agg(F.max(F.struct("batch", "entries", "bytes")).alias("last"))
    return last.select("snapshot_id", "last.entries", "last.bytes")


def stream_marks(spark: SparkSession, path: str) -> DataFrame:
    """New end marks, JSON lines in files below `path`, as a stream."""
    return spark.readStream.schema(END_MARK).json(path)


def stream_commit(
    entries: DataFrame, marks: DataFrame, store: SnapshotStore, landing: str, checkpoint: str, **options
) -> StreamingQuery:
    """Land a stream of entries and of end marks and commit each snapshot when it is complete.

    A snapshot is committed once: when a mark of it has come and so many of its
    paths are in as the mark says, whichever comes last.  Of a path that came
    several times the last batch counts, in a batch the greatest size.  What
    comes after the commit stays in `landing`.  A batch that is run again after
    a failure replaces what it landed, and finds committed what it committed.
    `options` go to `SnapshotStore.write`.

    The rows of a snapshot are shuffled once, by ranges of paths.  That their
    paths are too few is only known when they are in the store; then they are
    taken out again, and tried again once as many rows as were lacking have come.
    Names and extensions that follow from their path are not landed, but made again.
    """
    spark = store.spark
    none = [F.lit(None).cast(S.FILES[c].dataType).alias(c) for c in FILES_COLUMNS if c != "snapshot_id"]
    marked = marks.select("snapshot_id", *none, F.struct("entries", "started_at", "ended_at").alias("mark"))
    empty = F.lit(None).cast("struct<entries:bigint,started_at:bigint,ended_at:bigint>")
    both = entries.select(FILES_COLUMNS).withColumn("mark", empty).unionByName(marked)
    short = {}

    def take(rows: DataFrame, batch: int) -> None:
        follows = F.coalesce(reduce(and_, (F.col(c).eqNullSafe(made) for c, made in _of_path().items())), F.lit(False))
        own = {c: F.when(~follows, F.col(c)) for c in _of_path()}
        kind = rows.withColumns({"is_mark": F.col("mark").isNotNull(), "follows": follows, **own})
        with unsorted_partitions(kind.sparkSession):
            kind.write.mode("overwrite").partitionBy("is_mark", "snapshot_id").options(**PACKED).parquet(f"{landing}/batch={batch}")
        _commit_complete(spark, store, landing, options, short)

    return both.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()


def _of_path() -> dict[str, Column]:
    """Name and extension as `derive_columns` makes them."""
    name = paths.base_name("path")
    return {"name": name, "ext": F.when(~F.col("is_dir"), paths.extension(name))}


def _commit_complete(spark: SparkSession, store: SnapshotStore, landing: str, options: dict, short: dict[str, int]) -> None:
    """Commit the snapshots that are marked, complete and not committed yet.

    `short` holds, by snapshot that was tried, how many rows there must be before it can be complete.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.FILES.fields)
    came = spark.read.schema(f"{schema}, follows boolean, mark struct<entries:bigint,started_at:bigint,ended_at:bigint>, is_mark boolean, batch long")
    came = came.parquet(landing)
    # one row per snapshot that waits
    waiting = came.where("is_mark").where(~F.col("snapshot_id").isin(store.ids())) if store.ids() else came.where("is_mark")
    for one in waiting.groupBy("snapshot_id").agg(F.max(F.struct("batch", "mark")).alias("last")).collect():
        mark, rest = one["last"]["mark"], [c for c in FILES_COLUMNS if c not in ("snapshot_id", "path")]
        own = came.where(~F.col("is_mark") & (F.col("snapshot_id") == one["snapshot_id"]))
        wanted = mark["entries"]
        if wanted is not None:
            rows = own.count()
            if rows < max(wanted, short.get(one["snapshot_id"], 0)):
                continue
        # by ranges of paths, so that rows of a directory stay together; the sort comes after the shuffle
        dealt = own.drop("snapshot_id", "mark", "is_mark").repartitionByRange("path")
        named = dealt.withColumns({c: F.when(F.col("follows"), made).otherwise(F.col(c)) for c, made in _of_path().items()})
        last = named.groupBy("path").agg(F.max(F.struct("batch", "size", *(c for c in rest if c != "size"))).alias("last"))
        whole = last.select(F.lit(one["snapshot_id"]).cast("string").alias("snapshot_id"), "path", *(f"last.{c}" for c in rest)).select(FILES_COLUMNS)
        try:
            store.write(whole, one["snapshot_id"], started_at=mark["started_at"], ended_at=mark["ended_at"], at_least=wanted, **options)
        except TooFewRows as few:
            short[one["snapshot_id"]] = rows + wanted - few.found
