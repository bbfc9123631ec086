"""Questions about one snapshot."""

from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.functions.predicates import like
from tallyhouse.functions.scalars import size_of
from tallyhouse.operators import activity, ignore, listings, reclaim, tree
from tallyhouse.operators.usage import dir_usage
from tallyhouse.plans import inventory as I
from tallyhouse.plans.ingest import PARENT, L
from tallyhouse.plans.registry import entries, query, store
from tallyhouse.sources import envelope
from tallyhouse.sources.store import scan_meta

MTIME = "strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS mtime"
PHYSICAL = "COALESCE(physical_size, size)"


def files_sql(sql, *extra):
    return I.inventory_sql(sql, *extra, files_only=True)


def latest(spark, sf_dir):
    """Files and directories of the newest snapshot."""
    return entries(spark, sf_dir, "@latest")


# -- projections, filters, predicates ---------------------------------------


@query(
    "size_expr",
    files_sql(f"""SELECT snapshot_id, ext, CAST(sum(size) AS BIGINT) AS logical,
      CAST(sum({PHYSICAL}) AS BIGINT) AS physical FROM inv_files GROUP BY snapshot_id, ext"""),
)
def size_expr(spark, sf_dir):
    return listings.files_only(entries(spark, sf_dir)).groupBy("snapshot_id", "ext").agg(
        F.sum(size_of()).alias("logical"), F.sum(size_of(physical=True)).alias("physical")
    )


@query(
    "files_only",
    I.inventory_sql("""SELECT snapshot_id, depth, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
      FROM inv WHERE NOT is_dir GROUP BY snapshot_id, depth"""),
)
def files_only(spark, sf_dir):
    return listings.files_only(entries(spark, sf_dir)).groupBy("snapshot_id", "depth").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )


@query("empty_files", files_sql(f"SELECT path, size, ext, {MTIME} FROM inv_files WHERE {L} AND size = 0 ORDER BY path LIMIT 100"))
def empty_files(spark, sf_dir):
    return listings.empty_files(latest(spark, sf_dir))


@query(
    "old_files",
    files_sql(f"""SELECT path, size, ext, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS mtime
      FROM (SELECT path, size, ext, mtime AS t FROM inv_files
            WHERE {L} AND mtime > 946684800 AND mtime < 1702000000 ORDER BY mtime, path LIMIT 100)"""),
)
def old_files(spark, sf_dir):
    return listings.old_files(latest(spark, sf_dir), 1702000000)


@query(
    "find_files",
    files_sql(f"SELECT path, size, ext, {MTIME} FROM inv_files WHERE {L} AND name LIKE 'f%_1__%.png' ORDER BY size DESC, path LIMIT 50"),
)
def find_files(spark, sf_dir):
    return listings.find_files(latest(spark, sf_dir), "f*_1_?*.png")


@query(
    "top_files",
    files_sql(f"SELECT path, size, ext, {MTIME} FROM inv_files WHERE {L} AND size >= 0 ORDER BY size DESC, path LIMIT 50"),
)
def top_files(spark, sf_dir):
    return listings.top_files(latest(spark, sf_dir))


@query(
    "top_files_physical",
    files_sql(f"""SELECT path, {PHYSICAL} AS size, ext, {MTIME} FROM inv_files
      WHERE {L} AND {PHYSICAL} >= 5000 ORDER BY {PHYSICAL} DESC, path LIMIT 200"""),
)
def top_files_physical(spark, sf_dir):
    return listings.top_files(latest(spark, sf_dir), limit=200, min_size=5000, physical=True)


@query(
    "filter_where",
    files_sql(f"""SELECT path, size, ext FROM inv_files
      WHERE {L} AND size >= 40 * 1024 AND ext = 'log' AND path LIKE '/vol/s1%/src/%' AND (mtime <> 1 OR mtime IS NULL)
      ORDER BY path LIMIT 1000"""),
)
def filter_where(spark, sf_dir):
    where = "size >= 40KB AND ext = 'log' and path LIKE '/vol/s1%/src/%' AND mtime != 1 AND owner != 'root'"
    kept = listings.filter_where(latest(spark, sf_dir), where, 1000, ["path"])
    return kept.select("path", "size", "ext")


@query(
    "like_match",
    I.inventory_sql("""SELECT snapshot_id, count(*) AS entries, CAST(sum(length(path)) AS BIGINT) AS path_chars
      FROM inv WHERE is_dir AND path LIKE '/vol/s_/%' GROUP BY snapshot_id
      UNION ALL SELECT snapshot_id, count(*), CAST(sum(length(path)) AS BIGINT)
      FROM inv WHERE NOT is_dir AND path LIKE '%/data/f1_%_2%' GROUP BY snapshot_id"""),
)
def like_match(spark, sf_dir):
    inv = entries(spark, sf_dir)

    def matching(is_dir, pattern):
        found = inv.where((F.col("is_dir") == is_dir) & like("path", pattern))
        return found.groupBy("snapshot_id").agg(
            F.count("*").alias("entries"), F.sum(F.length("path")).alias("path_chars")
        )

    return matching(True, "/vol/s_/%").unionByName(matching(False, "%/data/f1_%_2%"))


@query(
    "ignore_patterns",
    r"""WITH lines AS (
      SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line,
        generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) - 1 AS line_no FROM documents),
    trimmed AS (
      SELECT doc_id, line_no, regexp_replace(line, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g') AS pattern FROM lines),
    usable AS (
      SELECT * FROM trimmed WHERE pattern <> '' AND pattern NOT LIKE '#%' AND pattern NOT LIKE '!%'
        AND NOT contains(pattern, '*') AND NOT contains(pattern, '?')),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY doc_id, line_no) AS nth FROM usable)
    SELECT pattern, doc_id AS source, CAST(line_no AS INTEGER) AS line_no FROM ranked WHERE nth = 1""",
)
def ignore_patterns(spark, sf_dir):
    """Every document taken as an ignore file."""
    return ignore.ignore_patterns(ignore.split_lines(I.table(spark, sf_dir, "documents"), "doc_id", "text"))


_IGNORED = " OR ".join(f"contains(name, '{p}')" for p in S.DEFAULT_IGNORES)


@query(
    "ignore_filter",
    I.inventory_sql(f"""SELECT snapshot_id, is_dir, depth, count(*) AS entries, CAST(sum(length(path)) AS BIGINT) AS path_chars
      FROM inv WHERE NOT ({_IGNORED}) GROUP BY snapshot_id, is_dir, depth"""),
)
def ignore_filter(spark, sf_dir):
    kept = ignore.ignore_filter(entries(spark, sf_dir))
    return kept.groupBy("snapshot_id", "is_dir", "depth").agg(
        F.count("*").alias("entries"), F.sum(F.length("path")).alias("path_chars")
    )


@query(
    "ignore_table",
    I.inventory_sql(
        """SELECT snapshot_id, is_dir, depth, count(*) AS entries, CAST(sum(length(path)) AS BIGINT) AS path_chars
          FROM inv WHERE name NOT IN (SELECT name FROM unwanted) GROUP BY snapshot_id, is_dir, depth""",
        """patterns AS (SELECT CASE c_custkey % 3 WHEN 0 THEN '_' || c_custkey || '.' WHEN 1 THEN 'f' || c_custkey || '_'
          ELSE '_7_' || c_custkey END AS pattern FROM customer)""",
        """unwanted AS (SELECT DISTINCT name FROM (SELECT DISTINCT name FROM inv) AS n JOIN patterns ON contains(name, pattern))""",
    ),
)
def ignore_table(spark, sf_dir):
    """Texts made of all customers' keys, taken as a table of patterns."""
    key = F.col("c_custkey").cast("string")
    made = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("_"), key, F.lit(".")))
    made = made.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("f"), key, F.lit("_"))).otherwise(F.concat(F.lit("_7_"), key))
    patterns = I.table(spark, sf_dir, "customer").select(made.alias("pattern"))
    kept = ignore.ignore_by_table(entries(spark, sf_dir), patterns)
    return kept.groupBy("snapshot_id", "is_dir", "depth").agg(
        F.count("*").alias("entries"), F.sum(F.length("path")).alias("path_chars")
    )


_PROTECTED = "(" + " OR ".join(f"contains(path, '{p}')" for p in S.PROTECTED_SUBSTRINGS) + ")"


@query(
    "protected_paths",
    I.inventory_sql(f"""SELECT snapshot_id, {_PROTECTED} AS protected, is_dir, count(*) AS entries,
      CAST(sum(size) AS BIGINT) AS bytes FROM inv GROUP BY 1, 2, 3"""),
)
def protected_paths(spark, sf_dir):
    marked = entries(spark, sf_dir).withColumn("protected", reclaim.protected("path"))
    return marked.groupBy("snapshot_id", "protected", "is_dir").agg(
        F.count("*").alias("entries"), F.sum("size").alias("bytes")
    )


# -- cleanup ------------------------------------------------------------------

_CATEGORY = "CASE name " + " ".join(
    f"WHEN '{n}' THEN '{c}'" for c, names in S.CLEANUP_CATEGORIES.items() for n in names
) + " END"
_NAMES = ", ".join(f"'{n}'" for names in S.CLEANUP_CATEGORIES.values() for n in names)
_TARGETS = f"""targets AS (SELECT {_CATEGORY} AS category, path FROM inv
  WHERE {L} AND is_dir AND name IN ({_NAMES}) AND NOT {_PROTECTED})"""
_CREDITED = f"""credited AS (SELECT t.category, t.path, CAST(COALESCE(sum(f.size), 0) AS BIGINT) AS bytes, count(f.path) AS files
  FROM targets t LEFT JOIN (SELECT * FROM inv_files WHERE {L}) f
    ON f.path >= t.path || '/' AND f.path < t.path || '0'
  GROUP BY t.category, t.path)"""


@query("cleanup_targets", I.inventory_sql("SELECT category, path FROM targets", _TARGETS))
def cleanup_targets(spark, sf_dir):
    return reclaim.cleanup_targets(latest(spark, sf_dir))


@query(
    "target_name_in",
    I.inventory_sql("SELECT snapshot_id, name, count(*) AS dirs FROM inv WHERE is_dir AND name IN ('.venv', 'venv', 'dist') GROUP BY 1, 2"),
)
def target_name_in(spark, sf_dir):
    wanted = reclaim.category_names(["venv", "dist", "no-such-category"])
    named = entries(spark, sf_dir).where(F.col("is_dir") & F.col("name").isin(list(wanted)))
    return named.groupBy("snapshot_id", "name").agg(F.count("*").alias("dirs"))


@query(
    "cleanup_scan",
    I.inventory_sql("SELECT * FROM credited ORDER BY bytes DESC, path LIMIT 1000", _TARGETS, _CREDITED),
)
def cleanup_scan(spark, sf_dir):
    return reclaim.cleanup_scan(latest(spark, sf_dir), limit=1000)


@query(
    "cleanup_scan_stored",
    I.inventory_sql(
        "SELECT * FROM credited WHERE category IN ('node_modules', 'target') ORDER BY bytes DESC, path LIMIT 100",
        _TARGETS,
        _CREDITED,
    ),
)
def cleanup_scan_stored(spark, sf_dir):
    snaps = store(spark, sf_dir)
    categories = ["node_modules", "target"]
    return reclaim.cleanup_scan(snaps.files("@latest"), categories, usage=snaps.usage("@latest"))


@query(
    "cleanup_scan_tree",
    I.inventory_sql("SELECT * FROM credited ORDER BY bytes DESC, path LIMIT 1000", _TARGETS, _CREDITED),
)
def cleanup_scan_tree(spark, sf_dir):
    """From the rows of the candidates in the numbered tree alone."""
    snaps = store(spark, sf_dir)
    return reclaim.cleanup_scan(snaps.files("@latest"), limit=1000, tree=snaps.tree("@latest"))


@query(
    "cleanup_outermost",
    I.inventory_sql(
        """SELECT * FROM credited c WHERE NOT EXISTS (
          SELECT 1 FROM targets t WHERE starts_with(c.path, t.path || '/')) ORDER BY bytes DESC, path LIMIT 100""",
        _TARGETS,
        _CREDITED,
    ),
)
def cleanup_outermost(spark, sf_dir):
    return reclaim.cleanup_scan(latest(spark, sf_dir), outermost_only=True)


@query(
    "cleanup_summary",
    I.inventory_sql(
        """SELECT category, count(*) AS paths, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(files) AS BIGINT) AS files
        FROM (SELECT * FROM credited ORDER BY bytes DESC, path LIMIT 100) GROUP BY ROLLUP (category)""",
        _TARGETS,
        _CREDITED,
    ),
)
def cleanup_summary(spark, sf_dir):
    return reclaim.cleanup_summary(reclaim.cleanup_scan(latest(spark, sf_dir)), total=True)


@query(
    "cleanup_json",
    I.inventory_sql(
        """SELECT CAST(to_json({'schema_version': 1, 'kind': 'cleanup', 'applied': false, 'removed': CAST([] AS VARCHAR[]),
          'records': (SELECT list({'category': category, 'path': path, 'bytes': bytes, 'files': files} ORDER BY bytes DESC, path) FROM top),
          'summary': (SELECT list({'category': category, 'paths': paths, 'bytes': bytes, 'files': files} ORDER BY bytes DESC, category) FROM sums),
          'total_bytes': (SELECT CAST(sum(bytes) AS BIGINT) FROM top)}) AS VARCHAR) AS json""",
        _TARGETS,
        _CREDITED,
        "top AS (SELECT * FROM credited ORDER BY bytes DESC, path LIMIT 100)",
        """sums AS (SELECT category, count(*) AS paths, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(files) AS BIGINT) AS files
          FROM top GROUP BY category)""",
    ),
)
def cleanup_json(spark, sf_dir):
    return envelope.cleanup_json(reclaim.cleanup_scan(latest(spark, sf_dir)))


@query(
    "after_cleanup",
    I.inventory_sql(
        f"""SELECT is_dir, depth, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM inv i
        WHERE {L} AND NOT EXISTS (SELECT 1 FROM hits h WHERE i.path = h.path OR starts_with(i.path, h.path || '/'))
        GROUP BY is_dir, depth""",
        _TARGETS,
        _CREDITED,
        "hits AS (SELECT path FROM credited ORDER BY bytes DESC, path LIMIT 100)",
    ),
)
def after_cleanup(spark, sf_dir):
    files = latest(spark, sf_dir)
    rest = reclaim.after_cleanup(files, reclaim.cleanup_scan(files))
    return rest.groupBy("is_dir", "depth").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


# -- aggregations -------------------------------------------------------------


def _by_ext_sql(size):
    return files_sql(f"""SELECT COALESCE(ext, '(none)') AS ext, count(*) AS files, CAST(sum({size}) AS BIGINT) AS total_size
      FROM inv_files WHERE {L} GROUP BY inv_files.ext ORDER BY total_size DESC, 1 LIMIT 30""")


@query("by_extension", _by_ext_sql("size"))
def by_extension(spark, sf_dir):
    return listings.by_extension(latest(spark, sf_dir))


@query("by_extension_physical", _by_ext_sql(PHYSICAL))
def by_extension_physical(spark, sf_dir):
    return listings.by_extension(latest(spark, sf_dir), physical=True)


def _top_dirs_sql(size):
    return files_sql(f"""SELECT {PARENT} AS path, CAST(sum({size}) AS BIGINT) AS total_size
      FROM inv_files WHERE {L} GROUP BY 1 ORDER BY total_size DESC, path LIMIT 30""")


@query("top_dirs", _top_dirs_sql("size"))
def top_dirs(spark, sf_dir):
    return listings.top_dirs(dir_usage(latest(spark, sf_dir)))


@query("top_dirs_physical", _top_dirs_sql(PHYSICAL))
def top_dirs_physical(spark, sf_dir):
    return listings.top_dirs(dir_usage(latest(spark, sf_dir)), physical=True)


def _stats_sql(size):
    return f"""SELECT snapshot_id, count(*) FILTER (WHERE NOT is_dir) AS files, count(*) FILTER (WHERE is_dir) AS dirs,
      CAST(COALESCE(sum({size}), 0) AS BIGINT) AS total_bytes, COALESCE(max({size}), 0) AS largest_bytes,
      CAST(floor(COALESCE(avg({size}) FILTER (WHERE NOT is_dir AND {size} > 0), 0)) AS BIGINT) AS avg_bytes
    FROM inv GROUP BY snapshot_id"""


@query("stats", I.inventory_sql(_stats_sql("size")))
def stats(spark, sf_dir):
    return listings.stats(entries(spark, sf_dir))


@query("stats_physical", I.inventory_sql(_stats_sql(PHYSICAL)))
def stats_physical(spark, sf_dir):
    return listings.stats(entries(spark, sf_dir), physical=True)


@query("stats_scalar", I.inventory_sql("SELECT snapshot_id, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE NOT is_dir) AS files FROM inv GROUP BY snapshot_id"))
def stats_scalar(spark, sf_dir):
    return listings.stats_scalar(listings.stats(entries(spark, sf_dir)))


@query(
    "snapshot_meta_join",
    I.inventory_sql(
        """SELECT s.*, false AS partial, '/vol' AS scan_root,
          CAST(greatest(1706800000 - t.snap_ts, 0) AS BIGINT) AS scan_duration_s,
          strftime(make_timestamp(t.snap_ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS scanned_at
        FROM stats s JOIN (SELECT DISTINCT snapshot_id, snap_ts FROM inv_files) t ON s.snapshot_id = t.snapshot_id""",
        f"stats AS ({_stats_sql('size')})",
    ),
)
def snapshot_meta_join(spark, sf_dir):
    files = entries(spark, sf_dir)
    return listings.with_scan_meta(listings.stats(files), scan_meta(files, ended_at=1706800000))


CHURN_CUTOFF = 1702500000
_CHURN = f"""churned AS (
  SELECT {PARENT} AS path, count(*) FILTER (WHERE mtime > {CHURN_CUTOFF}) AS recent_files,
    CAST(COALESCE(sum(size) FILTER (WHERE mtime > {CHURN_CUTOFF}), 0) AS BIGINT) AS recent_bytes,
    count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes
  FROM inv_files WHERE {L} GROUP BY 1)"""


@query(
    "churn",
    files_sql(
        """SELECT *, round(CASE WHEN total_bytes > 0 THEN CAST(recent_bytes AS DOUBLE) / total_bytes ELSE 0.0 END, 9) AS churn_score
        FROM churned WHERE recent_files > 0 ORDER BY recent_bytes DESC, path LIMIT 50""",
        _CHURN,
    ),
)
def churn(spark, sf_dir):
    rows = activity.churn(latest(spark, sf_dir), CHURN_CUTOFF)
    return rows.withColumn("churn_score", F.round("churn_score", 9))


@query(
    "subtree_sizes",
    I.inventory_sql(f"""SELECT d.path, CAST(sum(f.size) AS BIGINT) AS bytes, count(f.path) AS files
      FROM (SELECT path FROM inv WHERE {L} AND is_dir) d
      JOIN (SELECT path, size FROM inv_files WHERE {L}) f ON f.path >= d.path || '/' AND f.path < d.path || '0'
      GROUP BY d.path"""),
)
def subtree_sizes(spark, sf_dir):
    return tree.subtree_sizes(dir_usage(latest(spark, sf_dir)))


_CHILDREN = f"""child AS (SELECT c.path, c.name, c.is_dir, c.depth,
    CASE WHEN c.is_dir THEN CAST(COALESCE(sum(f.size), 0) AS BIGINT) ELSE c.size END AS size
  FROM (SELECT * FROM inv WHERE {L} AND {PARENT} = '/vol/s7') c
  LEFT JOIN (SELECT path, size FROM inv_files WHERE {L}) f ON f.path >= c.path || '/' AND f.path < c.path || '0'
  GROUP BY c.path, c.name, c.is_dir, c.depth, c.size)"""


@query("children", I.inventory_sql("SELECT path, name, is_dir, size, depth FROM child ORDER BY size DESC, path LIMIT 500", _CHILDREN))
def children(spark, sf_dir):
    return tree.children(latest(spark, sf_dir), "/vol/s7")


@query("children_tree", I.inventory_sql("SELECT path, name, is_dir, size, depth FROM child ORDER BY size DESC, path LIMIT 500", _CHILDREN))
def children_tree(spark, sf_dir):
    snaps = store(spark, sf_dir)
    return tree.tree_children(snaps.tree("@latest"), snaps.files("@latest"), "/vol/s7")


@query(
    "directory_tree",
    I.inventory_sql(
        """SELECT d.snapshot_id, d.path, d.depth,
          row_number() OVER (PARTITION BY d.snapshot_id ORDER BY replace(d.path, '/', chr(1))) - 1 AS pre,
          row_number() OVER (PARTITION BY d.snapshot_id ORDER BY replace(d.path, '/', chr(1))) - 2 + b.dirs AS last,
          COALESCE(o.files, 0) AS own_files, CAST(COALESCE(o.bytes, 0) AS BIGINT) AS own_bytes,
          CAST(COALESCE(t.files, 0) AS BIGINT) AS files, CAST(COALESCE(t.bytes, 0) AS BIGINT) AS bytes
        FROM (SELECT * FROM inv WHERE is_dir) d
        JOIN below b ON b.snapshot_id = d.snapshot_id AND b.path = d.path
        LEFT JOIN own o ON o.snapshot_id = d.snapshot_id AND o.dir = d.path
        LEFT JOIN total t ON t.snapshot_id = d.snapshot_id AND t.path = d.path""",
        f"own AS (SELECT snapshot_id, {PARENT} AS dir, count(*) AS files, sum(size) AS bytes FROM inv_files GROUP BY 1, 2)",
        """up AS (SELECT snapshot_id, dir, files, bytes, array_to_string(parts[1:k], '/') AS path
          FROM (SELECT *, string_split(dir, '/') AS parts, unnest(range(2, len(string_split(dir, '/')) + 1)) AS k FROM own))""",
        "total AS (SELECT snapshot_id, path, sum(files) AS files, sum(bytes) AS bytes FROM up GROUP BY 1, 2)",
        """below AS (SELECT snapshot_id, path, count(*) AS dirs
          FROM (SELECT snapshot_id, array_to_string(parts[1:k], '/') AS path
            FROM (SELECT snapshot_id, string_split(path, '/') AS parts, unnest(range(2, len(string_split(path, '/')) + 1)) AS k
              FROM inv WHERE is_dir)) GROUP BY 1, 2)""",
    ),
)
def directory_tree(spark, sf_dir):
    """All snapshots: places and totals of every directory."""
    return store(spark, sf_dir).tree().drop("own_physical_bytes", "physical_bytes")


@query("root_total", I.inventory_sql(f"SELECT '/vol' AS root, CAST(sum(size) AS BIGINT) AS total_bytes FROM inv WHERE {L} AND NOT is_dir"))
def root_total(spark, sf_dir):
    return tree.root_total(latest(spark, sf_dir))


# -- order and limit ------------------------------------------------------------


@query("order_limit", I.inventory_sql("SELECT snapshot_id, path, size FROM inv ORDER BY size DESC, snapshot_id, path LIMIT 100"))
def order_limit(spark, sf_dir):
    rows = entries(spark, sf_dir).select("snapshot_id", "path", "size")
    return rows.orderBy(F.desc("size"), "snapshot_id", "path").limit(100)


@query("limit_after_filter", files_sql(f"SELECT path FROM inv_files WHERE {L} AND ext = 'gz' ORDER BY path LIMIT 25"))
def limit_after_filter(spark, sf_dir):
    rows = latest(spark, sf_dir).select("path", "ext")
    return listings.filter_where(rows, [("ext", "=", "gz")], 25, ["path"]).select("path")


@query(
    "multi_key_sort",
    I.inventory_sql(f"SELECT path, is_dir, size FROM inv WHERE {L} ORDER BY is_dir DESC, size DESC, path LIMIT 500"),
)
def multi_key_sort(spark, sf_dir):
    rows = latest(spark, sf_dir).select("path", "is_dir", "size")
    return rows.orderBy(F.desc("is_dir"), F.desc("size"), "path").limit(500)
