"""A file inventory derived from the `lineitem` table.

Each line item is a file whose path, size and age follow from its keys, in five
snapshots between which files grow, shrink, come and go.  The SQL text of the
same derivation is in `inventory_sql`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.paths import slash_count
from tallyhouse.sources.manifest import FILES_COLUMNS, derive_directories

ROOT = "/vol"
#: Line items of a task, each up to five files.
TASK_ROWS = 1_000_000
DIR_MTIME = 1700000000

#: (k, id, second the scan began), oldest first.
SNAPSHOTS = [
    (0, "2024-01-01_06-00", 1704088800),
    (1, "2024-01-02_06-00", 1704175200),
    (2, "2024-01-09_06-00", 1704780000),
    (3, "2024-02-01_06-00", 1706767200),
    (4, "2024-02-01_18-00", 1706810400),
]
IDS = [one for _, one, _ in SNAPSHOTS]
TIMES = [(one, ts) for _, one, ts in SNAPSHOTS]
LATEST, PREVIOUS, OLDEST = IDS[4], IDS[3], IDS[0]

_FOLDERS = (
    "web/node_modules",
    "web/node_modules/pkg/dist",
    "svc/target",
    "py/__pycache__",
    "py/.venv/lib",
    "lib/site-packages/x/build",
    "var/log",
    "src",
    "app/.next",
    "data",
)
_SUFFIXES = (".log", ".BIN", ".tar.gz", "", ".", ".txt", ".png")
_EXTENSIONS = ("log", "bin", "gz", None, None, "txt", "png")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: str, values):
    """The value at position `index`, a SQL expression."""
    texts = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return F.expr(f"elt(CAST({index} AS INT) + 1, {texts})")


def _tasks(lines: DataFrame) -> int:
    """Tasks for so many line items: few rows each, so that their memory does not grow with the table."""
    rows = lines.count()
    return max(1, -(-rows // TASK_ROWS), min(lines.sparkSession.sparkContext.defaultParallelism, rows // 20_000))


def file_rows(spark: SparkSession, sf_dir: str, ids=None) -> DataFrame:
    """File entries of the snapshots in `ids` (all five by default)."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_extendedprice").alias("price"),
    )
    # Directory by directory, as a walk lists them, so that sums by directory combine before
    # they are shuffled; the order numbers last part a directory that holds very many rows.
    items = (
        lines.repartitionByRange(_tasks(lines), "sk", "pk", "ok", "ln")
        .groupBy("ok", "ln", "pk", "sk")
        .agg(F.max("price").alias("price"))
        .sortWithinPartitions("sk", F.col("pk") % 10, "ok", "ln", "pk")
    )
    ok, ln, pk, sk = (F.col(c) for c in ("ok", "ln", "pk", "sk"))
    folder = F.concat(F.lit("/vol/s"), sk.cast("string"), F.lit("/"), _pick("pk % 10", _FOLDERS))
    name = F.concat(F.lit("f"), F.concat_ws("_", ok.cast("string"), ln.cast("string"), pk.cast("string")), _pick("ok % 7", _SUFFIXES))
    base = items.select(
        "ok",
        "ln",
        (sk % 4).alias("cls"),
        F.concat(folder, F.lit("/"), name).alias("path"),
        name.alias("name"),
        _pick("ok % 7", _EXTENSIONS).alias("ext"),
        F.when(ok % 97 == 0, F.lit(0)).otherwise(F.floor("price")).cast("long").alias("size0"),
        F.when(ln % 5 == 0, F.lit(None).cast("long"))
        .when(ok % 89 == 0, F.lit(1))
        .otherwise(DIR_MTIME + (ok * 7919 + pk) % 4000000)
        .alias("mtime"),
    )
    chosen = [s for s in SNAPSHOTS if ids is None or s[1] in ids]
    moments = F.array(*(
        F.struct(F.lit(k).cast("long").alias("k"), F.lit(one).alias("snapshot_id")) for k, one, _ in chosen
    ))
    k, cls, size0 = F.col("k"), F.col("cls"), F.col("size0")
    size = (
        F.when(cls == 0, size0)
        .when(cls == 1, size0 + k * 1000)
        .when(cls == 2, F.greatest(size0 - k * 5000, F.lit(0)))
        .otherwise(size0 + F.when(k == 4, 50000).otherwise(0))
    )
    return (
        base.select("*", F.inline(moments))
        .where((cls == 0) | ((F.col("ok") + F.col("ln")) % 11 != k))
        .withColumn("size", size.cast("long"))
        .withColumn(
            "physical_size",
            F.when(F.col("ln") % 3 != 0, (F.floor((F.col("size") + 4095) / 4096) * 4096).cast("long")),
        )
        .withColumn("is_dir", F.lit(False))
        .withColumn("depth", (slash_count("path") - 1).cast("int"))
        .select(FILES_COLUMNS)
    )


def inventory(spark: SparkSession, sf_dir: str, ids=None) -> DataFrame:
    """File and directory entries of the snapshots in `ids`."""
    return derive_directories(file_rows(spark, sf_dir, ids), ROOT, DIR_MTIME)


def listing_export(spark: SparkSession, sf_dir: str, ids=None) -> DataFrame:
    """The same files as a raw listing, as an exporter would write it."""
    return file_rows(spark, sf_dir, ids).select(
        "snapshot_id", "path", "size", "physical_size", "mtime", "is_dir"
    )


FILES_SQL = """
li AS (
  SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
         max(l_extendedprice) AS price
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
kk AS (
  SELECT CAST(0 AS BIGINT) AS k, '2024-01-01_06-00' AS snapshot_id, CAST(1704088800 AS BIGINT) AS snap_ts
  UNION ALL SELECT 1, '2024-01-02_06-00', 1704175200
  UNION ALL SELECT 2, '2024-01-09_06-00', 1704780000
  UNION ALL SELECT 3, '2024-02-01_06-00', 1706767200
  UNION ALL SELECT 4, '2024-02-01_18-00', 1706810400),
base AS (
  SELECT ok, ln, sk % 4 AS cls,
    '/vol/s' || CAST(sk AS STRING) || '/' || CASE pk % 10
      WHEN 0 THEN 'web/node_modules' WHEN 1 THEN 'web/node_modules/pkg/dist'
      WHEN 2 THEN 'svc/target' WHEN 3 THEN 'py/__pycache__' WHEN 4 THEN 'py/.venv/lib'
      WHEN 5 THEN 'lib/site-packages/x/build' WHEN 6 THEN 'var/log' WHEN 7 THEN 'src'
      WHEN 8 THEN 'app/.next' ELSE 'data' END AS dir,
    'f' || CAST(ok AS STRING) || '_' || CAST(ln AS STRING) || '_' || CAST(pk AS STRING) || CASE ok % 7
      WHEN 0 THEN '.log' WHEN 1 THEN '.BIN' WHEN 2 THEN '.tar.gz' WHEN 3 THEN ''
      WHEN 4 THEN '.' WHEN 5 THEN '.txt' ELSE '.png' END AS name,
    CASE ok % 7 WHEN 0 THEN 'log' WHEN 1 THEN 'bin' WHEN 2 THEN 'gz'
      WHEN 5 THEN 'txt' WHEN 6 THEN 'png' END AS ext,
    CASE WHEN ok % 97 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(price) AS BIGINT) END AS size0,
    CASE WHEN ln % 5 = 0 THEN CAST(NULL AS BIGINT) WHEN ok % 89 = 0 THEN CAST(1 AS BIGINT)
      ELSE CAST(1700000000 + (ok * 7919 + pk) % 4000000 AS BIGINT) END AS mtime
  FROM li),
sized AS (
  SELECT snapshot_id, snap_ts, k, dir || '/' || name AS path, dir, name, ext, mtime, ln,
    CASE cls WHEN 0 THEN size0 WHEN 1 THEN size0 + k * 1000
      WHEN 2 THEN greatest(size0 - k * 5000, CAST(0 AS BIGINT))
      ELSE size0 + CASE WHEN k = 4 THEN 50000 ELSE 0 END END AS size
  FROM base CROSS JOIN kk
  WHERE cls = 0 OR (ok + ln) % 11 <> k),
inv_files AS (
  SELECT snapshot_id, snap_ts, k, path, name, ext, size,
    CASE WHEN ln % 3 = 0 THEN CAST(NULL AS BIGINT)
         ELSE CAST(floor((size + 4095) / 4096) AS BIGINT) * 4096 END AS physical_size,
    mtime, CAST(false AS BOOLEAN) AS is_dir,
    CAST(length(path) - length(replace(path, '/', '')) - 1 AS INTEGER) AS depth
  FROM sized)"""

_LEVELS = ["d1 AS (SELECT DISTINCT snapshot_id, snap_ts, k, regexp_replace(path, '/[^/]+$', '') AS p FROM inv_files)"] + [
    f"d{i + 1} AS (SELECT DISTINCT snapshot_id, snap_ts, k, regexp_replace(p, '/[^/]+$', '') AS p FROM d{i} WHERE p <> '')"
    for i in range(1, 6)
]

DIRS_SQL = (
    ",\n".join(_LEVELS)
    + ",\ndirs AS ("
    + " UNION ".join(f"SELECT * FROM d{i}" for i in range(1, 7))
    + """),
inv AS (
  SELECT * FROM inv_files
  UNION ALL
  SELECT snapshot_id, snap_ts, k, p AS path, regexp_replace(p, '^.*/', '') AS name,
    CAST(NULL AS STRING) AS ext, CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS physical_size,
    CAST(1700000000 AS BIGINT) AS mtime, CAST(true AS BOOLEAN) AS is_dir,
    CAST(length(p) - length(replace(p, '/', '')) - 1 AS INTEGER) AS depth
  FROM dirs WHERE p <> '')"""
)


def inventory_sql(query: str, *extra: str, files_only: bool = False) -> str:
    """`query` over the CTEs `inv_files`, `inv` and any `extra` ones."""
    parts = [FILES_SQL] if files_only else [FILES_SQL, DIRS_SQL]
    return "WITH " + ",\n".join([*parts, *extra]) + "\n" + query
