"""Sources, the snapshot table and JSON."""

from pyspark.sql import functions as F

from tallyhouse.functions.scalars import seconds_in
from tallyhouse.operators import listings, sqlview
from tallyhouse.operators.usage import dir_usage, usage_rows
from tallyhouse.plans import inventory as I
from tallyhouse.plans.registry import entries, export, landing_folder, query, store
from tallyhouse.schema import MANIFEST, SCHEMA_VERSION
from tallyhouse.session import hadoop_path, unsorted_partitions, working_folder
from tallyhouse.sources import envelope, manifest
from tallyhouse.sources import store as snapshots
from tallyhouse.sources.store import SnapshotStore
from tallyhouse.streaming import ingest as streaming

L = f"snapshot_id = '{I.LATEST}'"
PARENT = "regexp_replace(path, '/[^/]+$', '')"


def profile(files):
    """Totals per kind of entry; every column of `files` takes part."""
    return files.groupBy("snapshot_id", "is_dir", "depth", "ext").agg(
        F.count("*").alias("entries"),
        F.sum("size").alias("size"),
        F.sum("physical_size").alias("physical_size"),
        F.sum("mtime").alias("mtime"),
        F.sum(F.length("path")).alias("path_chars"),
        F.sum(F.length("name")).alias("name_chars"),
    )


def profile_sql(rel, mtime="mtime"):
    return f"""SELECT snapshot_id, is_dir, depth, ext, count(*) AS entries,
      CAST(sum(size) AS BIGINT) AS size, CAST(sum(physical_size) AS BIGINT) AS physical_size,
      CAST(sum({mtime}) AS BIGINT) AS mtime, CAST(sum(length(path)) AS BIGINT) AS path_chars,
      CAST(sum(length(name)) AS BIGINT) AS name_chars
    FROM {rel} GROUP BY snapshot_id, is_dir, depth, ext"""


_NO_DIR_MTIME = "CASE WHEN NOT is_dir THEN mtime END"


@query("ingest_manifest", I.inventory_sql(profile_sql("inv", _NO_DIR_MTIME)))
def ingest_manifest(spark, sf_dir):
    folder = landing_folder(spark, I.listing_export(spark, sf_dir), "json")
    return profile(manifest.ingest_manifest(spark, folder, "json", I.ROOT, directories=True))


@query("ingest_manifest_csv", I.inventory_sql(profile_sql("inv_files"), files_only=True))
def ingest_manifest_csv(spark, sf_dir):
    folder = landing_folder(spark, I.listing_export(spark, sf_dir), "csv")
    return profile(manifest.ingest_manifest(spark, folder, "csv", I.ROOT))


@query("ingest_manifest_parquet", I.inventory_sql(profile_sql("inv_files"), files_only=True))
def ingest_manifest_parquet(spark, sf_dir):
    folder = landing_folder(spark, I.listing_export(spark, sf_dir), "parquet")
    return profile(manifest.ingest_manifest(spark, folder, "parquet", I.ROOT))


@query(
    "ingest_listing",
    """SELECT 'lang=' || lang AS name, CAST(1 AS INTEGER) AS depth,
         CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes
       FROM documents GROUP BY lang""",
)
def ingest_listing(spark, sf_dir):
    """List a folder tree of text files; their sizes are known from the texts."""
    folder = working_folder(spark, "texts")
    I.table(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(folder)
    files = manifest.ingest_listing(spark, folder, I.LATEST)
    directories = files.where("is_dir").select(F.col("path").alias("dir"), "name", "depth")
    usage = usage_rows(files).groupBy("dir").agg(F.sum("bytes").alias("bytes"))
    return usage.join(directories, "dir").select("name", "depth", "bytes")


@query(
    "derive_columns",
    I.inventory_sql(
        "SELECT snapshot_id, path, name, ext, size, physical_size, mtime, is_dir, depth FROM inv_files",
        files_only=True,
    ),
)
def derive_columns(spark, sf_dir):
    return manifest.derive_columns(I.listing_export(spark, sf_dir), I.ROOT)


@query(
    "derive_directories",
    I.inventory_sql("SELECT snapshot_id, path, name, ext, size, physical_size, mtime, is_dir, depth FROM inv WHERE is_dir"),
)
def derive_directories(spark, sf_dir):
    return I.inventory(spark, sf_dir).where("is_dir")


@query(
    "scan_meta",
    I.inventory_sql("""SELECT snapshot_id, '/vol' AS root, snap_ts AS started_at,
        CAST(1706800000 AS BIGINT) AS ended_at, true AS completed, count(*) AS entries,
        CAST(sum(CASE WHEN size > 0 THEN size ELSE 0 END) AS BIGINT) AS bytes,
        CAST(greatest(1706800000 - snap_ts, 0) AS BIGINT) AS duration_s
      FROM inv GROUP BY snapshot_id, snap_ts"""),
)
def scan_meta(spark, sf_dir):
    files = entries(spark, sf_dir)
    return snapshots.with_duration(snapshots.scan_meta(files, ended_at=1706800000))


@query(
    "scan_meta_unfinished",
    I.inventory_sql(f"""SELECT snapshot_id, '/vol' AS root, snap_ts AS started_at,
        CASE WHEN NOT {L} THEN CAST(1706800000 AS BIGINT) END AS ended_at, NOT {L} AS completed, count(*) AS entries,
        CAST(sum(CASE WHEN size > 0 THEN size ELSE 0 END) AS BIGINT) AS bytes,
        CASE WHEN NOT {L} THEN CAST(greatest(1706800000 - snap_ts, 0) AS BIGINT) END AS duration_s
      FROM inv GROUP BY snapshot_id, snap_ts"""),
)
def scan_meta_unfinished(spark, sf_dir):
    """The newest scan has no end yet."""
    done = snapshots.scan_meta(entries(spark, sf_dir, *I.IDS[:-1]), ended_at=1706800000)
    running = snapshots.scan_meta(entries(spark, sf_dir, I.LATEST), completed=False)
    return snapshots.with_duration(done.unionByName(running))


@query("snapshot_write", I.inventory_sql(profile_sql("inv")))
def snapshot_write(spark, sf_dir):
    return profile(store(spark, sf_dir).files())


@query(
    "snapshot_usage",
    I.inventory_sql(
        f"""SELECT snapshot_id, {PARENT} AS dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
          CAST(sum(COALESCE(physical_size, size)) AS BIGINT) AS physical_bytes
        FROM inv_files GROUP BY 1, 2""",
        files_only=True,
    ),
)
def snapshot_usage(spark, sf_dir):
    return store(spark, sf_dir).usage()


@query(
    "snapshot_list",
    I.inventory_sql(
        """SELECT DISTINCT snapshot_id AS id, true AS has_bytes,
          strftime(make_timestamp(snap_ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created FROM inv_files""",
        files_only=True,
    ),
)
def snapshot_list(spark, sf_dir):
    listed = store(spark, sf_dir).listing()
    return listed.select("id", (F.col("bytes") > 0).alias("has_bytes"), "created")


_RANKED = "ranked AS (SELECT snapshot_id, snap_ts, row_number() OVER (ORDER BY snapshot_id DESC) - 1 AS back FROM (SELECT DISTINCT snapshot_id, snap_ts FROM inv_files))"


@query(
    "snapshot_resolve",
    I.inventory_sql(
        """SELECT '@latest' AS spec, snapshot_id FROM ranked WHERE back = 0
        UNION ALL SELECT '@latest~1', snapshot_id FROM ranked WHERE back = 1
        UNION ALL SELECT '@latest~4', snapshot_id FROM ranked WHERE back = 4
        UNION ALL SELECT '2024-01-09_06-00', snapshot_id FROM ranked WHERE snapshot_id = '2024-01-09_06-00'""",
        _RANKED,
        files_only=True,
    ),
)
def snapshot_resolve(spark, sf_dir):
    catalog = snapshots.catalog_from(store(spark, sf_dir).meta())
    found = None
    for spec in ("@latest", "@latest~1", "@latest~4", "2024-01-09_06-00"):
        one = snapshots.resolve(catalog, spec).select(F.lit(spec).alias("spec"), "snapshot_id")
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "snapshot_at_age",
    I.inventory_sql(
        "SELECT snapshot_id, snap_ts AS ts FROM ranked WHERE snap_ts <= 1706900000 - 7 * 86400 ORDER BY snap_ts DESC LIMIT 1",
        _RANKED,
        files_only=True,
    ),
)
def snapshot_at_age(spark, sf_dir):
    catalog = snapshots.catalog_from(store(spark, sf_dir).meta())
    return snapshots.at_age(catalog, 1706900000, seconds_in("7d"))


@query(
    "snapshot_last_n",
    I.inventory_sql("SELECT snapshot_id, snap_ts AS ts FROM ranked WHERE back < 3", _RANKED, files_only=True),
)
def snapshot_last_n(spark, sf_dir):
    return snapshots.last_n(snapshots.catalog_from(store(spark, sf_dir).meta()), 3)


_BY_EXT = f"""by_ext AS (SELECT COALESCE(ext, '(none)') AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size
  FROM inv_files WHERE {L} GROUP BY inv_files.ext ORDER BY total_size DESC, ext LIMIT 30)"""
_BY_DIR = f"""by_dir AS (SELECT {PARENT} AS path, CAST(sum(size) AS BIGINT) AS total_size
  FROM inv_files WHERE {L} GROUP BY 1 ORDER BY total_size DESC, path LIMIT 30)"""


@query(
    "envelope_json",
    I.inventory_sql(
        """SELECT CAST(to_json({'schema_version': 1, 'kind': 'ext',
            'records': list({'ext': ext, 'files': files, 'total_size': total_size} ORDER BY total_size DESC, ext)}) AS VARCHAR) AS json
        FROM by_ext""",
        _BY_EXT,
        files_only=True,
    ),
)
def envelope_json(spark, sf_dir):
    rows = listings.by_extension(entries(spark, sf_dir, "@latest"))
    return envelope.envelope_json(rows, "ext", [F.desc("total_size"), F.asc("ext")], 30)


@query(
    "records_ndjson",
    I.inventory_sql(
        "SELECT CAST(to_json({'path': path, 'total_size': total_size}) AS VARCHAR) AS value FROM by_dir",
        _BY_DIR,
        files_only=True,
    ),
)
def records_ndjson(spark, sf_dir):
    rows = listings.top_dirs(dir_usage(entries(spark, sf_dir, "@latest")))
    return envelope.records_ndjson(rows)


@query(
    "envelope_read",
    I.inventory_sql(
        f"""SELECT 'dirs' AS kind, path, total_size FROM (
          SELECT snapshot_id, path, total_size,
            row_number() OVER (PARTITION BY snapshot_id ORDER BY total_size DESC, path) AS nth
          FROM (SELECT snapshot_id, {PARENT} AS path, CAST(sum(size) AS BIGINT) AS total_size
                FROM inv_files GROUP BY 1, 2)) WHERE nth <= 30""",
        files_only=True,
    ),
)
def envelope_read(spark, sf_dir):
    """One document per snapshot, written and read back."""
    snaps = store(spark, sf_dir)
    folder = working_folder(spark, "documents")
    for one in I.IDS:
        rows = listings.top_dirs(snaps.usage(one))
        document = envelope.envelope_json(rows, "dirs", [F.desc("total_size"), F.asc("path")], 30)
        document.write.mode("append").text(folder)
    return envelope.envelope_read(spark, folder, "path string, total_size long")


@query(
    "filter_untyped",
    I.inventory_sql(
        f"""SELECT 'find' AS kind, path, size FROM inv_files
          WHERE {L} AND size >= 40 * 1024 AND (ext <> 'log' OR ext IS NULL) ORDER BY path LIMIT 2000""",
        files_only=True,
    ),
)
def filter_untyped(spark, sf_dir):
    """Each file's record lies in one document with a number, a text and a record whose size is a text."""
    files = listings.files_only(entries(spark, sf_dir, "@latest"))
    record, other = F.to_json(F.struct("path", "size", "ext")), F.to_json(F.struct("path", F.col("size").cast("string").alias("size")))
    head = F.lit('{"schema_version":%d,"kind":"find","records":[7,"size",' % SCHEMA_VERSION)
    folder = working_folder(spark, "documents")
    files.select(F.concat(head, other, F.lit(","), record, F.lit("]}"))).write.text(folder, compression="gzip")
    found = envelope.filter_untyped(envelope.read_untyped(spark, folder), "size >= 40KB AND ext != 'log'", 2000, ["path"])
    path, size = F.try_variant_get("record", "$.path", "string"), F.try_variant_get("record", "$.size", "long")
    return found.select("kind", path.alias("path"), size.alias("size"))


@query(
    "scan_bundle",
    I.inventory_sql(
        f"""SELECT 'stats' AS section, snapshot_id AS label, count(*) FILTER (WHERE NOT is_dir) AS files,
          count(*) FILTER (WHERE is_dir) AS dirs, CAST(sum(size) AS BIGINT) AS bytes FROM inv WHERE {L} GROUP BY snapshot_id
        UNION ALL (SELECT 'top', path, NULL, NULL, size FROM inv WHERE {L} AND NOT is_dir ORDER BY size DESC, path LIMIT 10)
        UNION ALL (SELECT 'dirs', path, NULL, NULL, total_size FROM by_dir ORDER BY total_size DESC, path LIMIT 10)
        UNION ALL (SELECT 'ext', ext, files, NULL, total_size FROM by_ext ORDER BY total_size DESC, ext LIMIT 10)""",
        _BY_EXT,
        _BY_DIR,
    ),
)
def scan_bundle(spark, sf_dir):
    files = entries(spark, sf_dir, "@latest")
    return listings.scan_bundle(files, dir_usage(files), top=10, dirs=10, ext=10)


@query(
    "rows_as_json",
    """SELECT CAST(to_json({'order': l_orderkey, 'line': l_linenumber,
         'price': CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS VARCHAR),
         'quantity': CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END,
         'shipped': epoch_us(l_shipdate), 'day': CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT),
         'flag': '<blob:' || length(l_returnflag) || ' bytes>',
         'parts': [{'key': 'part', 'value': l_partkey}],
         'wait': {'months': 0, 'days': l_linenumber, 'nanos': 0},
         'list': [l_suppkey, l_partkey]}) AS VARCHAR) AS value
       FROM lineitem""",
)
def rows_as_json(spark, sf_dir):
    line = F.col("l_linenumber")
    return envelope.rows_as_json(
        I.table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("order"),
            line.alias("line"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
            F.when(line % 2 == 0, F.col("l_quantity")).otherwise(float("nan")).alias("quantity"),
            F.col("l_shipdate").alias("shipped"),
            F.col("l_shipdate").cast("date").alias("day"),
            F.col("l_returnflag").cast("binary").alias("flag"),
            F.create_map(F.lit("part"), "l_partkey").alias("parts"),
            F.make_dt_interval(line).alias("wait"),
            F.array("l_suppkey", "l_partkey").alias("list"),
        )
    )


_FREE_SQL = """SELECT ext, count(*) AS n, max(depth) AS deepest, max(entries) AS scanned
    FROM files JOIN scan_meta ON files.snapshot_id = scan_meta.snapshot_id
    WHERE size > 10000 GROUP BY ext ORDER BY ext"""


@query(
    "sql_query",
    I.inventory_sql(
        _FREE_SQL,
        f"files AS (SELECT * FROM inv WHERE {L})",
        "scan_meta AS (SELECT snapshot_id, count(*) AS entries FROM files GROUP BY snapshot_id)",
    ),
)
def sql_query(spark, sf_dir):
    snaps = store(spark, sf_dir)
    newest = snaps.resolve("@latest")
    return sqlview.sql_query(spark, _FREE_SQL, snaps.files(newest), snaps.meta(), snapshot_ids=[newest])


@query(
    "stream_ingest",
    I.inventory_sql(
        """SELECT snapshot_id, count(*) AS entries,
          CAST(sum(CASE WHEN size > 0 THEN size ELSE 0 END) AS BIGINT) AS bytes FROM inv_files GROUP BY snapshot_id""",
        files_only=True,
    ),
)
def stream_ingest(spark, sf_dir):
    """Take an export of several files in several batches, then count what landed."""
    folder = landing_folder(spark, I.listing_export(spark, sf_dir), "parquet")
    landing, checkpoint = working_folder(spark, "landing"), working_folder(spark, "progress")
    arriving = streaming.stream_manifest(spark, folder, root=I.ROOT, files_per_trigger=2)
    streaming.stream_ingest(arriving, landing, checkpoint).awaitTermination()
    return streaming.running_counts(streaming.landed(spark, landing))


_LANDED = I.inventory_sql(
    """SELECT snapshot_id, count(*) AS entries,
      CAST(sum(CASE WHEN size > 0 THEN size ELSE 0 END) AS BIGINT) AS bytes FROM inv_files GROUP BY snapshot_id""",
    files_only=True,
)


def _sent_in_parts(spark, sf_dir):
    """(folder, a function that sends the rest, all rows once): an export of which a part comes first, and a part of that again later.

    The files are derived once, for both parts; those of the rest wait beside the folder and are moved there.
    """
    first = F.pmod(F.xxhash64("path"), F.lit(3)) == 0
    sent = F.when(first & (F.col("mtime") % 2 == 0), F.array(F.lit(0), F.lit(1))).when(first, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    made = working_folder(spark, "export")
    with unsorted_partitions(spark):
        export(I.listing_export(spark, sf_dir).select("*", F.explode(sent).alias("part")), "parquet").partitionBy("part").save(made)
    rows = spark.read.schema(MANIFEST).option("basePath", made)
    once = rows.parquet(f"{made}/part=0").unionByName(rows.parquet(f"{made}/part=1").where(~first))

    def send():
        system, waiting = hadoop_path(spark, f"{made}/part=1/*.parquet")
        for one in system.globStatus(waiting) or []:
            # a task names its files of both parts alike
            if not system.rename(one.getPath(), hadoop_path(spark, f"{made}/part=0/rest-{one.getPath().getName()}")[1]):
                raise OSError(f"not sent: {one.getPath()}")

    return f"{made}/part=0", send, once


@query("stream_counts", _LANDED)
def stream_counts(spark, sf_dir):
    """Counts from the stream's own output, over several batches and a restart, entries sent again left out."""
    folder, send, _ = _sent_in_parts(spark, sf_dir)
    counts, checkpoint = working_folder(spark, "counts"), working_folder(spark, "progress")

    def run():
        arriving = streaming.stream_manifest(spark, folder, root=I.ROOT, files_per_trigger=8)
        streaming.stream_counts(arriving, counts, checkpoint).awaitTermination()

    run()
    send()
    run()
    return streaming.latest_counts(spark, counts)


@query("stream_commit", _LANDED)
def stream_commit(spark, sf_dir):
    """Snapshots that a stream commits when their end marks have come and all entries are in."""
    folder, send, once = _sent_in_parts(spark, sf_dir)
    names = ("marks", "landing", "progress", "stream-store")
    marks, landing, checkpoint, root = (working_folder(spark, n) for n in names)
    none = F.lit(None).cast("long")
    ends = once.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("entries"))
    ends.withColumns({"started_at": none, "ended_at": none}).write.mode("append").json(marks)
    made = SnapshotStore(spark, root)

    def run():
        arriving = streaming.stream_manifest(spark, folder, root=I.ROOT)
        streaming.stream_commit(arriving, streaming.stream_marks(spark, marks), made, landing, checkpoint, root=I.ROOT).awaitTermination()

    run()
    if made.ids():
        raise AssertionError("committed before all entries came")
    send()
    run()
    return made.meta().select("snapshot_id", "entries", "bytes")
