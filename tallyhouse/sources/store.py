"""The snapshot table: immutable partitions, some small side tables, and commit marks.

    <root>/files/snapshot_id=<id>/generation=<n>/   one row per entry
    <root>/usage/snapshot_id=<id>/generation=<n>/   one row per directory, rolled up at write time
    <root>/tree/snapshot_id=<id>/generation=<n>/    one row per directory with its place and subtree totals, if asked for
    <root>/meta/snapshot_id=<id>/generation=<n>/    one row
    <root>/claims/snapshot_id=<id>/<n>              an empty file: a writer has taken this generation
    <root>/heads/snapshot_id=<id>/<n>               an empty file, made last: this generation is committed

A write claims the next generation of its snapshot, which only one writer can, and fills
folders that no one else reads or writes.  The head it makes at the end is the commit;
readers take the greatest one.  So a replaced snapshot stays readable, also by the job
that replaces it, until the new one stands, and a write that dies changes nothing.

Directory questions (`growth`, trends, subtree totals) read `usage` or `tree`, which are
smaller than `files` by the number of files per directory.
"""

import re
import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.functions.scalars import file_stem, rfc3339, snapshot_ts
from tallyhouse.operators.tree import directory_tree, scan_roots
from tallyhouse.operators.usage import dir_usage
from tallyhouse.session import PACKED, unsorted_partitions
from tallyhouse.sources.manifest import missing_directories


def scan_meta(
    files: DataFrame,
    root: str | None = None,
    started_at: int | None = None,
    ended_at: int | None = None,
    completed: bool = True,
) -> DataFrame:
    """One row per snapshot: entries and bytes from the rows, the rest as given.

    Without `root` it is the path at depth 0, without `started_at` the moment
    named by the snapshot id.
    """
    counted = files.groupBy("snapshot_id").agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("size"))), F.lit(0)).alias("bytes"),
    )
    if root is None:
        # Kept apart from the counts: a string aggregate would sort every entry.
        counted = counted.join(scan_roots(files), "snapshot_id", "left")
    else:
        counted = counted.withColumn("root", F.lit(root))
    return counted.select(
        "snapshot_id",
        F.coalesce("root", F.lit("/")).alias("root"),
        F.coalesce(F.lit(started_at).cast("long"), snapshot_ts("snapshot_id"), F.lit(0)).alias("started_at"),
        F.lit(ended_at).cast("long").alias("ended_at"),
        F.lit(completed).alias("completed"),
        "entries",
        "bytes",
    )


def duration() -> Column:
    """Seconds from start to end, never negative; NULL without an end."""
    return F.when(F.col("ended_at").isNotNull(), F.greatest(F.col("ended_at") - F.col("started_at"), F.lit(0)))


def with_duration(meta: DataFrame) -> DataFrame:
    """Add `duration_s`, never negative, NULL for a scan without an end."""
    return meta.withColumn("duration_s", duration())


def catalog_from(meta: DataFrame) -> DataFrame:
    """(snapshot_id, ts): the snapshots a reference can point at; ts NULL for odd ids."""
    return meta.select("snapshot_id", snapshot_ts("snapshot_id").alias("ts"))


def resolve(catalog: DataFrame, spec: str) -> DataFrame:
    """The snapshot named by `@latest`, `@latest~N` or an id, as at most one row.

    `@latest` follows the order of ids, as file names do.
    """
    back = _steps_back(spec)
    if back is None:
        return catalog.select("snapshot_id").where(F.col("snapshot_id") == spec)
    newest = catalog.select("snapshot_id").orderBy(F.desc("snapshot_id"))
    return newest.offset(back).limit(1)


def _steps_back(spec: str) -> int | None:
    """0 for `@latest`, N for `@latest~N`, None for an id."""
    if not spec.startswith("@"):
        return None
    back = re.fullmatch(r"@latest(?:~([0-9]+))?", spec)
    if not back:
        raise ValueError(f"not a snapshot reference: {spec!r}")
    return int(back[1] or 0)


def at_age(catalog: DataFrame, now: int, age_seconds: int) -> DataFrame:
    """The newest snapshot taken at or before `now - age_seconds`, as at most one row."""
    old = catalog.where(F.col("ts") <= now - age_seconds)
    return old.orderBy(F.desc("ts"), F.desc("snapshot_id")).limit(1)


def last_n(catalog: DataFrame, n: int) -> DataFrame:
    """The `n` newest snapshots with a parseable id, oldest first."""
    if n < 3:
        raise ValueError(f"a trend needs at least 3 snapshots, got {n}")
    newest = catalog.where(F.col("ts").isNotNull()).orderBy(F.desc("ts"), F.desc("snapshot_id"))
    return newest.limit(n).orderBy("ts", "snapshot_id")


def new_snapshot_id(now: float | None = None) -> str:
    """An id for a snapshot taken now, in UTC."""
    return time.strftime("%Y-%m-%d_%H-%M", time.gmtime(now))


def _folder(one: str, generation: int) -> str:
    return f"snapshot_id={one}/generation={generation}"


class TooFewRows(LookupError):
    """A write was given fewer rows than it was to have at least."""

    def __init__(self, found: int, wanted: int):
        super().__init__(f"{found} rows of at least {wanted}; nothing is committed")
        self.found = found


class SnapshotStore:
    """Snapshots below one folder.

    Methods that return a DataFrame are lazy once the snapshots they cover are
    known; finding those reads only the `meta` table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- writing ----------------------------------------------------------

    def write(
        self,
        files: DataFrame,
        snapshot_id: str | None = None,
        *,
        snapshot_ids: list[str] | None = None,
        root: str | None = None,
        started_at: int | None = None,
        ended_at: int | None = None,
        completed: bool = True,
        directories: bool = False,
        dir_mtime: int | None = None,
        replace: bool = False,
        sort_by_path: bool = False,
        tree: bool = False,
        at_least: int | None = None,
    ) -> list[str]:
        """Commit `files` as new snapshots and return their ids.

        With `snapshot_id` all rows become that snapshot; otherwise they carry
        their own, and naming them in `snapshot_ids` saves a pass that looks for
        them.  The write fails on rows of snapshots that are not named, and on
        named snapshots without rows.  Committed snapshots are immutable unless
        `replace` is set; a reader then sees the old snapshot until the new one is
        committed, and `files` may read the snapshot it replaces.  Of two writers
        that replace a snapshot the later claim wins as a whole.  Replacing by an
        empty listing leaves none.
        `directories` adds the directory rows a flat listing lacks.
        With fewer rows in `files` than `at_least` the write fails with `TooFewRows`
        and removes what it stored.
        `sort_by_path` range-partitions the rows by path, one extra shuffle that
        lets subtree reads skip most row groups.  `tree` also stores the numbered
        directory tree.

        A run that lost its driver half way has committed nothing and can be
        repeated; `expire` removes what it and replaced snapshots leave.
        """
        if snapshot_id is not None:
            files = files.withColumn("snapshot_id", F.lit(snapshot_id))
            ids = [snapshot_id]
        elif snapshot_ids is not None:
            other = F.raise_error(F.concat(F.lit("row of a snapshot that is not named: "), F.coalesce("snapshot_id", F.lit("NULL"))))
            named = F.when(F.col("snapshot_id").isin(snapshot_ids), F.col("snapshot_id")).otherwise(other)
            files = files.withColumn("snapshot_id", named)
            ids = sorted(set(snapshot_ids))
        else:
            ids = sorted(r[0] for r in files.select("snapshot_id").distinct().toLocalIterator())
        for one in ids:
            if not re.fullmatch(r"[A-Za-z0-9._-]+", one):
                raise ValueError(f"snapshot id {one!r} may hold letters, digits, '.', '_' and '-' only")
        taken = set(ids) & set(self.ids())
        if taken and not replace:
            raise ValueError(f"snapshots exist and are immutable: {sorted(taken)}")
        claimed = {one: self._claim(one) for one in ids}
        if sort_by_path:
            files = files.repartitionByRange("snapshot_id", "path").sortWithinPartitions(
                "snapshot_id", "path"
            )
        self._put("files", files.select([f.name for f in S.FILES.fields]), claimed)
        found = [one for one in ids if self._exists(f"files/{_folder(one, claimed[one])}")]
        if at_least is not None:
            rows = self._partitions("files", {one: claimed[one] for one in found}).count()
            if rows < at_least:
                for one in found:
                    self._remove(f"files/{_folder(one, claimed[one])}")
                raise TooFewRows(rows, at_least)
        if snapshot_ids is not None and found != ids:
            raise LookupError(f"no rows for {sorted(set(ids) - set(found))}; nothing is committed")
        for one in taken - set(found):
            self._commit(one, claimed[one], replace, gone=True)
        if not found:
            return []
        new = {one: claimed[one] for one in found}
        # The rest is computed from what was stored, not from `files` again: the
        # stored columns are cheap to re-read, the source may not be.
        if directories:
            self._put("files", missing_directories(self._partitions("files", new), root or "/", dir_mtime), new)
        stored = self._partitions("files", new)
        meta = scan_meta(stored, root, started_at, ended_at, completed)
        # A snapshot without files has one row, its root, so that no partition is missing.
        bare = stored.groupBy("snapshot_id").agg(F.count_if(~F.col("is_dir")).alias("n")).where("n = 0")
        none = [F.lit(0).cast("long").alias(c) for c in ("files", "bytes", "physical_bytes")]
        bare = bare.select("snapshot_id", F.lit(root or "/").alias("dir"), *none)
        self._put("usage", dir_usage(stored).unionByName(bare), new)
        if tree:
            self._put("tree", directory_tree(self._partitions("usage", new), stored), new)
        self._put("meta", meta.join(self._stored_sizes(new), "snapshot_id", "left").coalesce(1), new)
        for one, generation in new.items():
            self._commit(one, generation, replace)
        return found

    def expire(self, older_than: float = 86_400.0) -> list[str]:
        """Remove generations that are not current and were claimed more than so many seconds ago.

        Their folders are returned.  Leave enough time for readers and writers at work.
        """
        heads, gone = self._heads(committed=False), []
        for path, at in self._files("claims"):
            one, generation = path.rsplit("/", 2)[-2].removeprefix("snapshot_id="), int(path.rsplit("/", 1)[-1])
            if generation != heads.get(one) and time.time() - at > older_than:
                for table in ("files", "usage", "tree", "meta"):
                    folder = f"{table}/{_folder(one, generation)}"
                    if self._exists(folder):
                        self._remove(folder)
                        gone.append(folder)
        return gone

    def _path(self, below: str):
        """Hadoop's file system and path of something below the root; a job cannot make or remove a mark."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, below: str) -> bool:
        system, path = self._path(below)
        return system.exists(path)

    def _remove(self, below: str) -> None:
        system, path = self._path(below)
        system.delete(path, True)

    def _mark(self, below: str) -> bool:
        """Make an empty file; False if it is there already, which one of two that try is told."""
        system, path = self._path(below)
        try:
            system.create(path, False).close()
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception) and not system.exists(path):
                raise
            return False
        return True

    def _files(self, table: str) -> list[tuple[str, float]]:
        """(path, second of last change) of the marks in `claims` or `heads`."""
        system, path = self._path(f"{table}/snapshot_id=*/*")
        return [(s.getPath().toString(), s.getModificationTime() / 1000) for s in system.globStatus(path) or []]

    def _claim(self, one: str) -> int:
        marks = [path.rsplit("/", 1)[-1] for path, _ in self._files("claims") if f"/snapshot_id={one}/" in path]
        generation = max(map(int, marks), default=0) + 1
        while not self._mark(f"claims/snapshot_id={one}/{generation:08d}"):
            generation += 1
        return generation

    def _commit(self, one: str, generation: int, replace: bool, gone: bool = False) -> None:
        current = self._heads().get(one)
        if current is not None and not replace:
            raise ValueError(f"snapshots exist and are immutable: {[one]}")
        self._mark(f"heads/snapshot_id={one}/{generation:08d}{'-none' if gone else ''}")

    def _heads(self, committed: bool = True) -> dict[str, int]:
        """Current generation by snapshot; with `committed` False also of those replaced by nothing."""
        marks = {}
        for path, _ in self._files("heads"):
            one, mark = path.rsplit("/", 2)[-2].removeprefix("snapshot_id="), path.rsplit("/", 1)[-1]
            marks[one] = max(marks.get(one, ""), mark)
        return {one: int(mark[:8]) for one, mark in sorted(marks.items()) if not (committed and mark.endswith("-none"))}

    def _stored_sizes(self, new: dict[str, int]) -> DataFrame:
        """Bytes and number of the data files of new snapshots; none is opened."""
        data = (
            self.spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.parquet")
            .load([f"{self.root}/files/{_folder(*pair)}" for pair in new.items()])
            .select(F.regexp_extract("path", r"/snapshot_id=([^/]+)/", 1).alias("snapshot_id"), "length")
        )
        return data.groupBy("snapshot_id").agg(F.sum("length").alias("stored_bytes"), F.count(F.lit(1)).alias("stored_files"))

    def _put(self, table: str, rows: DataFrame, generations: dict[str, int]) -> None:
        pairs = [F.lit(part) for pair in generations.items() for part in pair]
        generation = F.element_at(F.create_map(*pairs), F.col("snapshot_id")) if pairs else F.lit(0)
        made = rows.withColumn("generation", generation)
        with unsorted_partitions(rows.sparkSession):
            made.write.partitionBy("snapshot_id", "generation").mode("append").options(**PACKED).parquet(f"{self.root}/{table}")

    # -- finding snapshots --------------------------------------------------

    def meta(self) -> DataFrame:
        """`scan_meta` of every committed snapshot."""
        return self._partitions("meta", self._heads())

    def ids(self) -> list[str]:
        """Committed snapshots in order, read off the names of the heads without a job."""
        return list(self._heads())

    def listing(self) -> DataFrame:
        """(id, path, bytes stored, created) of every committed snapshot, by id, from the scan records alone."""
        return (
            self._partitions("meta", self._heads(), S.STORED_META)
            .select(
                F.col("snapshot_id").alias("id"),
                F.concat(F.lit(f"{self.root}/files/snapshot_id="), "snapshot_id").alias("path"),
                F.col("stored_bytes").alias("bytes"),
                rfc3339(snapshot_ts("snapshot_id")).alias("created"),
            )
            .orderBy("id")
        )

    def resolve(self, spec: str = "@latest") -> str:
        """The id behind `@latest`, `@latest~N`, an id or the path of a snapshot."""
        return self._resolve(spec, self.ids())

    def _resolve(self, spec: str, ids: list[str]) -> str:
        if "/" in spec:
            spec = spec.rstrip("/").rsplit("/", 1)[-1].removeprefix("snapshot_id=")
        back = _steps_back(spec)
        found = ids[len(ids) - 1 - back :] if back is not None and back < len(ids) else []
        if back is None and spec in ids:
            found = [spec]
        if not found:
            raise LookupError(f"snapshot not found: {spec} ({len(ids)} committed)")
        return found[0]

    def at_age(self, duration_seconds: int, now: int | None = None) -> str:
        moment = int(time.time()) if now is None else now
        found = at_age(catalog_from(self.meta()), moment, duration_seconds).collect()
        if not found:
            raise LookupError(f"no snapshot {duration_seconds} s before {moment}")
        return found[0]["snapshot_id"]

    def last_n(self, n: int) -> list[tuple[str, int]]:
        """(id, second) of the `n` newest snapshots, oldest first."""
        rows = [(r["snapshot_id"], r["ts"]) for r in last_n(catalog_from(self.meta()), n).collect()]
        if len(rows) < n:
            raise LookupError(f"{n} snapshots wanted, {len(rows)} found")
        return rows

    # -- reading ------------------------------------------------------------

    def files(self, *specs: str) -> DataFrame:
        """Entries of the named snapshots (all committed ones without arguments)."""
        return self._partitions("files", self._named(specs))

    def usage(self, *specs: str) -> DataFrame:
        """Directory roll-ups of the named snapshots."""
        return self._partitions("usage", self._named(specs))

    def tree(self, *specs: str) -> DataFrame:
        """Numbered directory trees of the named snapshots, which must have been written with `tree`."""
        return self._partitions("tree", self._named(specs))

    def _named(self, specs) -> dict[str, int]:
        """Generations of the named snapshots, resolved once: what is read does not change under a reader."""
        heads = self._heads()
        return {one: heads[one] for one in (self._resolve(spec, list(heads)) for spec in specs)} if specs else heads

    def _partitions(self, table: str, generations: dict[str, int], schema=None) -> DataFrame:
        """Only the folders of these generations are listed, however many snapshots exist; each must be there."""
        schema = schema or {"files": S.FILES, "usage": S.USAGE, "tree": S.TREE, "meta": S.SCAN_META}[table]
        if not generations:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}"
        folders = [f"{base}/{_folder(*pair)}" for pair in generations.items()]
        try:
            return self.spark.read.schema(schema).option("basePath", base).parquet(*folders).select([f.name for f in schema])
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise LookupError(f"the store is damaged or holds no {table}: {error}") from error


def ids_from_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """Add `snapshot_id`, the stem of each snapshot file's name."""
    return paths.withColumn("snapshot_id", file_stem(column))

