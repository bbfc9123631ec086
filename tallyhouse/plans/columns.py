"""Column functions over whole tables."""

from pyspark.sql import functions as F

from tallyhouse.functions import paths, scalars
from tallyhouse.operators.listings import files_only
from tallyhouse.operators.usage import dir_usage, usage_rows
from tallyhouse.plans import inventory as I
from tallyhouse.plans.ingest import PARENT
from tallyhouse.plans.registry import entries, query
from tallyhouse.plans.single import CHURN_CUTOFF, files_sql


@query("parent_dir", I.inventory_sql(f"SELECT snapshot_id, {PARENT} AS parent, count(*) AS entries FROM inv GROUP BY 1, 2"))
def parent_dir(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return rows.groupBy("snapshot_id", paths.parent_dir("path").alias("parent")).agg(F.count("*").alias("entries"))


@query("base_name", I.inventory_sql("SELECT snapshot_id, path, regexp_replace(path, '^.*/', '') AS name FROM inv"))
def base_name(spark, sf_dir):
    return entries(spark, sf_dir).select("snapshot_id", "path", paths.base_name("path").alias("name"))


@query(
    "extension",
    files_sql("""SELECT lower(nullif(regexp_extract(name, '\\.([^.]+)$', 1), '')) AS ext, snapshot_id, count(*) AS files
      FROM inv_files GROUP BY 1, 2"""),
)
def extension(spark, sf_dir):
    rows = files_only(entries(spark, sf_dir)).select("snapshot_id", paths.extension("name").alias("ext"))
    return rows.groupBy("ext", "snapshot_id").agg(F.count("*").alias("files"))


@query(
    "rfc3339",
    files_sql("""SELECT snapshot_id, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS text, count(*) AS files
      FROM inv_files GROUP BY 1, 2"""),
)
def rfc3339(spark, sf_dir):
    rows = files_only(entries(spark, sf_dir)).select("snapshot_id", scalars.rfc3339("mtime").alias("text"))
    return rows.groupBy("snapshot_id", "text").agg(F.count("*").alias("files"))


def _unit(key, units):
    """A unit text picked by `key`; one text past the end is no unit."""
    return " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(units)), len(units)


_DURATIONS = ("s", "m", "h", "d", "w", "mo", "y", "", "x", " days")
_DURATION_CASE, _DURATION_N = _unit("o_orderkey", _DURATIONS)
_DURATION_TEXT = f"' ' || CAST(o_orderkey AS VARCHAR) || CASE o_custkey % {_DURATION_N} {_DURATION_CASE} END || ' '"


@query(
    "parse_duration",
    f"""SELECT text, CAST(CASE WHEN regexp_full_match(trim(text), '[0-9]+(s|m|h|d|w|mo|y)') THEN
          CAST(regexp_extract(text, '[0-9]+') AS BIGINT) * CASE regexp_extract(text, '[0-9]+([a-z]*)', 1)
            WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'w' THEN 604800
            WHEN 'mo' THEN 2592000 WHEN 'y' THEN 31536000 END END AS BIGINT) AS seconds
       FROM (SELECT {_DURATION_TEXT} AS text FROM orders)""",
)
def parse_duration(spark, sf_dir):
    text = F.expr(_DURATION_TEXT.replace("VARCHAR", "STRING"))
    rows = I.table(spark, sf_dir, "orders").select(text.alias("text"))
    return rows.select("text", scalars.duration_seconds("text").alias("seconds"))


_SIZES = ("", "B", "kb", "KiB", "MB", "mib", " GB", "GiB", "TB", "TiB", "XB", "K", "i b")
_SIZE_CASE, _SIZE_N = _unit("o_orderkey", _SIZES)
_SIZE_TEXT = f"CAST(o_orderkey AS VARCHAR) || CASE o_custkey % {_SIZE_N} {_SIZE_CASE} END"


@query(
    "parse_size",
    f"""SELECT text, CAST(CASE WHEN regexp_full_match(upper(text), '[0-9]+ *([KMGT]I?B|B|)') THEN
          CAST(regexp_extract(text, '[0-9]+') AS BIGINT) * CASE substr(regexp_extract(upper(text), '[0-9]+ *([A-Z]*)', 1), 1, 1)
            WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 WHEN 'T' THEN 1099511627776 ELSE 1 END
          END AS BIGINT) AS bytes
       FROM (SELECT {_SIZE_TEXT} AS text FROM orders)""",
)
def parse_size(spark, sf_dir):
    text = F.expr(_SIZE_TEXT.replace("VARCHAR", "STRING"))
    rows = I.table(spark, sf_dir, "orders").select(text.alias("text"))
    return rows.select("text", scalars.size_bytes("text").alias("bytes"))


_HUMAN = """CASE WHEN bytes < 1024 THEN bytes || ' B'
  WHEN bytes < 1048576 THEN CASE WHEN bytes % 1024 = 0 THEN (bytes // 1024) || ' KiB' ELSE printf('%.2f KiB', bytes / 1024) END
  WHEN bytes < 1073741824 THEN CASE WHEN bytes % 1048576 = 0 THEN (bytes // 1048576) || ' MiB' ELSE printf('%.2f MiB', bytes / 1048576) END
  ELSE CASE WHEN bytes % 1073741824 = 0 THEN (bytes // 1073741824) || ' GiB' ELSE printf('%.2f GiB', bytes / 1073741824) END END"""


@query(
    "human_size",
    I.inventory_sql(
        f"SELECT snapshot_id, path, bytes, {_HUMAN} AS shown FROM sums UNION ALL SELECT snapshot_id, path, size, {_HUMAN.replace('bytes', 'size')} FROM inv_files",
        f"""sums AS (SELECT snapshot_id, {PARENT} AS path, CAST(sum(size) AS BIGINT) AS bytes FROM inv_files GROUP BY 1, 2)""",
    ),
)
def human_size(spark, sf_dir):
    files = files_only(entries(spark, sf_dir))
    sums = dir_usage(files).select("snapshot_id", F.col("dir").alias("path"), "bytes")
    both = sums.unionByName(files.select("snapshot_id", "path", F.col("size").alias("bytes")))
    return both.withColumn("shown", scalars.human_size("bytes"))


@query(
    "truncate_path",
    I.inventory_sql("SELECT snapshot_id, path, CASE WHEN length(path) <= 30 THEN path ELSE '...' || right(path, 27) END AS shown FROM inv"),
)
def truncate_path(spark, sf_dir):
    return entries(spark, sf_dir).select("snapshot_id", "path", scalars.truncate_path("path", 30).alias("shown"))


_ID_TEXT = """strftime(o_orderdate, '%Y-%m-%d') || '_' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0')
    || '-' || lpad(CAST(o_custkey % 70 AS VARCHAR), 2, '0')"""


@query(
    "snapshot_ts",
    f"""SELECT id, CAST(epoch(try_strptime(id, '%Y-%m-%d_%H-%M')) AS BIGINT) AS ts
       FROM (SELECT {_ID_TEXT} AS id FROM orders)""",
)
def snapshot_ts(spark, sf_dir):
    """Ids made of dates and numbers, some of which are no time of day."""
    two = lambda value: F.lpad(value.cast("string"), 2, "0")
    made = F.concat(
        F.col("o_orderdate").cast("date").cast("string"),
        F.lit("_"),
        two(F.col("o_orderkey") % 30),
        F.lit("-"),
        two(F.col("o_custkey") % 70),
    )
    rows = I.table(spark, sf_dir, "orders").select(made.alias("id"))
    return rows.select("id", scalars.snapshot_ts("id").alias("ts"))


@query("file_stem", files_sql("SELECT snapshot_id, path, regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') AS stem FROM inv_files"))
def file_stem(spark, sf_dir):
    return files_only(entries(spark, sf_dir)).select("snapshot_id", "path", scalars.file_stem("path").alias("stem"))


@query(
    "safe_ratio",
    files_sql(
        f"""SELECT snapshot_id, {PARENT} AS path, round(CASE WHEN sum(size) > 0 THEN
            CAST(sum(CASE WHEN mtime > {CHURN_CUTOFF} THEN size ELSE 0 END) AS DOUBLE) / CAST(sum(size) AS DOUBLE) ELSE 0.0 END, 9) AS ratio
          FROM inv_files GROUP BY 1, 2""",
    ),
)
def safe_ratio(spark, sf_dir):
    recent = F.sum(F.when(F.col("mtime") > CHURN_CUTOFF, F.col("size")).otherwise(0))
    rows = files_only(entries(spark, sf_dir)).groupBy("snapshot_id", paths.parent_dir("path").alias("path")).agg(
        recent.alias("recent"), F.sum("size").alias("total")
    )
    return rows.select("snapshot_id", "path", F.round(scalars.safe_ratio("recent", "total"), 9).alias("ratio"))


_BUDGET = 50_000_000_000


@query(
    "fill_date",
    files_sql(f"""SELECT snapshot_id, path, CASE WHEN bytes > 0 THEN strftime(make_timestamp(
          CAST(trunc(1706810400 + CAST({_BUDGET} AS DOUBLE) / bytes * 86400) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS fill_at
      FROM (SELECT snapshot_id, {PARENT} AS path, CAST(sum(size) AS BIGINT) AS bytes FROM inv_files GROUP BY 1, 2)"""),
)
def fill_date(spark, sf_dir):
    rows = usage_rows(files_only(entries(spark, sf_dir))).groupBy("snapshot_id", F.col("dir").alias("path")).agg(F.sum("bytes").alias("bytes"))
    second = scalars.fill_second(F.lit(I.TIMES[-1][1]), F.lit(_BUDGET), F.col("bytes"))
    return rows.select("snapshot_id", "path", scalars.rfc3339(second).alias("fill_at"))
