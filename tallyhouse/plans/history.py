"""Questions about several snapshots."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.scalars import BUCKETS
from tallyhouse.operators import compare, retention, shape, trend
from tallyhouse.operators.usage import usage_rows
from tallyhouse.plans import inventory as I
from tallyhouse.plans.ingest import PARENT
from tallyhouse.plans.registry import entries, query, store
from tallyhouse.plans.single import PHYSICAL, files_sql
from tallyhouse.sources import envelope
from tallyhouse.sources.store import scan_meta
from tallyhouse.sources.trends import TrendTable

A, B = I.PREVIOUS, I.LATEST
NEWEST = I.TIMES[-1][1]


def usage(spark, sf_dir, *ids):
    """Directory usage straight from the files, without the stored roll-up."""
    return usage_rows(entries(spark, sf_dir, *ids))


# -- two snapshots --------------------------------------------------------------

#: Each path once, with its size in either snapshot where it is a file there.
_DIFF = f"""both_sizes AS (SELECT path,
    max(size) FILTER (WHERE snapshot_id = '{A}') AS old_size, max(size) FILTER (WHERE snapshot_id = '{B}') AS new_size
  FROM inv WHERE snapshot_id IN ('{A}', '{B}') GROUP BY path HAVING NOT bool_or(is_dir)),
changed AS (SELECT path, ifnull(old_size, 0) AS size_a, ifnull(new_size, 0) AS size_b, ifnull(new_size, 0) - ifnull(old_size, 0) AS delta
  FROM both_sizes WHERE (old_size IS NULL) <> (new_size IS NULL) OR old_size <> new_size)"""
FILE_KIND = """CASE WHEN size_a = 0 AND size_b > 0 THEN 'added' WHEN size_a > 0 AND size_b = 0 THEN 'removed'
    WHEN size_b > size_a THEN 'grew' ELSE 'shrank' END"""
DIR_KIND = "CASE WHEN size_a = 0 THEN 'added' WHEN size_b = 0 THEN 'removed' WHEN size_b > size_a THEN 'grew' ELSE 'shrank' END"


@query(
    "diff",
    I.inventory_sql(
        f"SELECT path, {FILE_KIND} AS kind, size_a, size_b, delta FROM changed ORDER BY abs(delta) DESC, path LIMIT 2000", _DIFF
    ),
)
def diff(spark, sf_dir):
    return compare.diff(entries(spark, sf_dir, A, B), A, B, limit=2000)


@query(
    "change_kind",
    I.inventory_sql(
        f"""SELECT {FILE_KIND} AS kind, count(*) AS files, CAST(sum(delta) AS BIGINT) AS delta FROM changed GROUP BY 1""", _DIFF
    ),
)
def change_kind(spark, sf_dir):
    """Every change, counted by kind."""
    changes = compare.diff(entries(spark, sf_dir, A, B), A, B, limit=None)
    return changes.groupBy("kind").agg(F.count("*").alias("files"), F.sum("delta").alias("delta"))


def _grown(a, b):
    return f"""grown AS (SELECT * FROM (SELECT {PARENT} AS path,
      CAST(sum(CASE snapshot_id WHEN '{a}' THEN size ELSE 0 END) AS BIGINT) AS size_a,
      CAST(sum(CASE snapshot_id WHEN '{b}' THEN size ELSE 0 END) AS BIGINT) AS size_b
    FROM inv_files WHERE snapshot_id IN ('{a}', '{b}') GROUP BY 1) WHERE size_a <> size_b)"""


def _growth_sql(a, b, days):
    return files_sql(
        f"""SELECT path, {DIR_KIND} AS kind, size_a, size_b, size_b - size_a AS delta_bytes,
          round((size_b - size_a) / CAST({days} AS DOUBLE), 3) AS rate_bytes_per_day, CAST({days} AS DOUBLE) AS days_between
        FROM grown ORDER BY abs(size_b - size_a) DESC, path LIMIT 50""",
        _grown(a, b),
    )


def _rounded_rate(rows):
    return rows.withColumn("rate_bytes_per_day", F.round("rate_bytes_per_day", 3))


@query("growth", _growth_sql(I.IDS[1], B, "(1706810400 - 1704175200) / 86400"))
def growth(spark, sf_dir):
    pair = [I.IDS[1], B]
    meta = scan_meta(entries(spark, sf_dir, *pair))
    return _rounded_rate(compare.growth(usage(spark, sf_dir, *pair), meta, *pair))


@query("growth_stored", _growth_sql(A, B, "0.5"))
def growth_stored(spark, sf_dir):
    """`@latest~1` to `@latest`, from the stored roll-up."""
    snaps = store(spark, sf_dir)
    a, b = snaps.resolve("@latest~1"), snaps.resolve("@latest")
    return _rounded_rate(compare.growth(snaps.usage(a, b), snaps.meta(), a, b))


# -- trends ---------------------------------------------------------------------

_SERIES = f"""series AS (SELECT snapshot_id, snap_ts, {PARENT} AS dir, CAST(sum(size) AS BIGINT) AS bytes
  FROM inv_files GROUP BY 1, 2, 3)"""
_TREND = f"""trend AS (SELECT dir AS path, count(*) AS n, regr_sxy(bytes, x) AS sxy, regr_sxx(bytes, x) AS sxx,
    regr_syy(bytes, x) AS syy, avg(x) AS mean_x, avg(CAST(bytes AS DOUBLE)) AS mean_y,
    max(CASE WHEN snap_ts = {NEWEST} THEN bytes END) AS latest_bytes,
    list(bytes ORDER BY snap_ts) AS sizes, list(snap_ts ORDER BY snap_ts) AS times
  FROM (SELECT *, CAST(snap_ts - {NEWEST} AS DOUBLE) / 86400 AS x FROM series) GROUP BY dir),
fit AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0.0 END AS slope,
    CASE WHEN sxx > 0 AND syy > 0 THEN sxy * sxy / (sxx * syy) WHEN n = 2 THEN 1.0 ELSE 0.0 END AS r2 FROM trend)"""
_STRIDES = """strided AS (SELECT *, len(ab) AS n_strides,
    CASE WHEN len(ab) > 0 THEN (list_sort(ab)[CAST(floor((len(ab) - 1) / 2) AS BIGINT) + 1]
      + list_sort(ab)[CAST(floor(len(ab) / 2) AS BIGINT) + 1]) / CAST(2 AS DOUBLE) END AS stride_median,
    list_max(ab) AS max_stride,
    len(ab) - list_position(list_reverse(ab), list_max(ab)) AS max_stride_index
  FROM (SELECT *, list_transform(range(1, len(sizes)), lambda i: abs(sizes[i + 1] - sizes[i])) AS ab FROM fit))"""


def _series(spark, sf_dir):
    return trend.dir_series(usage(spark, sf_dir))


def _trends(spark, sf_dir):
    return trend.directory_trends(_series(spark, sf_dir), I.TIMES)


@query("dir_series", files_sql("SELECT snapshot_id, dir, bytes FROM series", _SERIES))
def dir_series(spark, sf_dir):
    return _series(spark, sf_dir)


@query("latest_only", files_sql("SELECT path, n, latest_bytes FROM trend WHERE latest_bytes IS NOT NULL", _SERIES, _TREND))
def latest_only(spark, sf_dir):
    kept = trend.latest_only(_trends(spark, sf_dir))
    return kept.select("path", F.col("_n").alias("n"), "latest_bytes")


_FILL = 1_000_000_000
_GROWTH_N = f"""SELECT path, CAST(trunc(slope) AS BIGINT) AS slope_bytes_per_day, round(r2, 6) AS r2, latest_bytes,
      n AS n_snapshots,
      array_to_string(list_transform(range(1, len(sizes) + 1), lambda i: times[i] || ':' || sizes[i]), ',') AS samples,
      CASE WHEN slope > 0 THEN strftime(make_timestamp(CAST(trunc({NEWEST} + {_FILL} / slope * 86400) AS BIGINT) * 1000000),
        '%Y-%m-%dT%H:%M') END AS fill_minute
    FROM fit WHERE latest_bytes IS NOT NULL AND n >= 3 ORDER BY slope_bytes_per_day DESC, path LIMIT 50"""


def _growth_n_row(rows):
    """Samples as text and the date to the minute, so that last-bit differences do not show."""
    sample = F.transform("sample_paths_ts", lambda s: F.concat_ws(":", s["ts"].cast("string"), s["bytes"].cast("string")))
    return rows.select(
        "path",
        "slope_bytes_per_day",
        F.round("r2", 6).alias("r2"),
        "latest_bytes",
        "n_snapshots",
        F.array_join(sample, ",").alias("samples"),
        F.left("projected_fill_date", F.lit(16)).alias("fill_minute"),
    )


@query("growth_over_n", files_sql(_GROWTH_N, _SERIES, _TREND))
def growth_over_n(spark, sf_dir):
    return _growth_n_row(trend.growth_over_n(usage_rows(entries(spark, sf_dir)), I.TIMES, fill_target=_FILL))


@query("growth_over_n_stored", files_sql(_GROWTH_N, _SERIES, _TREND))
def growth_over_n_stored(spark, sf_dir):
    snaps = store(spark, sf_dir)
    last = snaps.last_n(5)
    rolled_up = snaps.usage(*(one for one, _ in last))
    return _growth_n_row(trend.growth_over_n(rolled_up, last, fill_target=_FILL))


@query("growth_over_n_moments", files_sql(_GROWTH_N, _SERIES, _TREND))
def growth_over_n_moments(spark, sf_dir):
    """From moments that were added to snapshot by snapshot, one of them taken back in between."""
    table = TrendTable(store(spark, sf_dir))
    if set(table.ids()) != set(I.IDS):
        for some in (I.IDS[:3], I.IDS[1:4], I.IDS):
            table.refresh(some)
    return _growth_n_row(table.growth_over_n(fill_target=_FILL))


_FREE = 10_000_000_000


def _predict_sql(size):
    return files_sql(
        f"""SELECT max(CASE WHEN ts = {NEWEST} THEN bytes END) AS current_bytes, round(max(slope), 3) AS growth_rate_bytes_per_day,
          CAST({_FREE} AS BIGINT) AS free_bytes_now,
          strftime(make_timestamp(CAST(trunc({NEWEST} + {_FREE} / max(slope) * 86400) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M') AS fill_minute,
          round({_FREE} / max(slope), 6) AS days_until_fill, round(max(r2), 9) AS confidence_r2, count(*) AS samples,
          CAST(NULL AS VARCHAR) AS reason
        FROM totals CROSS JOIN (SELECT regr_slope(bytes, ts / 86400) AS slope, regr_r2(bytes, ts / 86400) AS r2 FROM totals)""",
        f"totals AS (SELECT snap_ts AS ts, CAST(sum({size}) AS BIGINT) AS bytes FROM inv_files GROUP BY snap_ts)",
    )


def _predict_row(rows):
    return rows.select(
        "current_bytes",
        F.round("growth_rate_bytes_per_day", 3).alias("growth_rate_bytes_per_day"),
        "free_bytes_now",
        F.left("fill_at", F.lit(16)).alias("fill_minute"),
        F.round("days_until_fill", 6).alias("days_until_fill"),
        F.round("confidence_r2", 9).alias("confidence_r2"),
        "samples",
        "reason",
    )


@query("predict", _predict_sql("size"))
def predict(spark, sf_dir):
    totals = trend.snapshot_totals(entries(spark, sf_dir))
    return _predict_row(trend.predict(totals, _FREE))


@query("predict_physical", _predict_sql(PHYSICAL))
def predict_physical(spark, sf_dir):
    totals = trend.snapshot_totals(entries(spark, sf_dir), physical=True)
    return _predict_row(trend.predict(totals, _FREE))


@query("predict_stored", _predict_sql("size"))
def predict_stored(spark, sf_dir):
    """From the scan records alone."""
    return _predict_row(trend.predict(store(spark, sf_dir).meta(), _FREE))


@query(
    "ols_fit",
    files_sql(
        """SELECT path AS dir, n, round(slope, 3) AS slope, round(mean_y - slope * mean_x, 2) AS intercept, round(r2, 6) AS r2
        FROM fit""",
        _SERIES,
        _TREND,
    ),
)
def ols_fit(spark, sf_dir):
    points = trend.timed(_series(spark, sf_dir), I.TIMES)
    days = points.withColumn("x", (F.col("ts") - NEWEST) / F.lit(86400.0))
    return trend.ols_fit(days, "dir", "x", "bytes").select(
        "dir", "n", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2")
    )


# -- shapes -----------------------------------------------------------------------


@query(
    "strides",
    files_sql(
        """SELECT dir AS path, CAST(row_number() OVER w - 2 AS INTEGER) AS idx, bytes - lag(bytes) OVER w AS stride
        FROM series WINDOW w AS (PARTITION BY dir ORDER BY snap_ts) QUALIFY row_number() OVER w > 1""",
        _SERIES,
    ),
)
def strides(spark, sf_dir):
    return shape.strides(_trends(spark, sf_dir))


@query("stride_median", files_sql("SELECT path, stride_median FROM strided", _SERIES, _TREND, _STRIDES))
def stride_median(spark, sf_dir):
    return shape.with_strides(_trends(spark, sf_dir)).select("path", "stride_median")


@query(
    "max_stride",
    files_sql("SELECT path, max_stride, CAST(max_stride_index AS INTEGER) AS max_stride_index FROM strided", _SERIES, _TREND, _STRIDES),
)
def max_stride(spark, sf_dir):
    return shape.with_strides(_trends(spark, sf_dir)).select("path", "max_stride", "max_stride_index")


@query(
    "classify_pattern",
    files_sql(
        """SELECT path, n AS n_samples, CASE WHEN n < 3 THEN 'unknown'
          WHEN mean_y > 0 AND slope * (times[n] - times[1]) / CAST(86400 AS DOUBLE) / (n - 1) / mean_y <= -0.01 AND r2 >= 0.5 THEN 'declining'
          WHEN max_stride = 0 THEN 'stable'
          WHEN stride_median = 0 OR max_stride / stride_median > 4 THEN
            CASE WHEN max_stride_index < floor(n_strides / 3) THEN 'log_shaped' ELSE 'burst' END
          WHEN max_stride / stride_median < 3 THEN 'stable' ELSE 'unknown' END AS pattern FROM strided""",
        _SERIES,
        _TREND,
        _STRIDES,
    ),
)
def classify_pattern(spark, sf_dir):
    return shape.classify_pattern(_series(spark, sf_dir), I.TIMES)


# -- retention --------------------------------------------------------------------

_CATALOG = """catalog AS (SELECT snapshot_id AS id, snap_ts AS ts, CAST(sum(size) AS BIGINT) AS bytes,
    make_timestamp(snap_ts * 1000000) AS made FROM inv_files GROUP BY 1, 2)"""
_SPANS = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def catalog(spark, sf_dir):
    """One row per snapshot with its bytes standing for the stored size."""
    totals = trend.snapshot_totals(entries(spark, sf_dir))
    return totals.select(F.col("snapshot_id").alias("id"), F.concat(F.lit("/"), "snapshot_id").alias("path"), "bytes")


def _kept_sql(rule, n):
    if rule == "last":
        return f"SELECT id, 'last' AS reason FROM (SELECT id FROM catalog ORDER BY ts DESC LIMIT {n})"
    return f"""SELECT id, '{rule}' AS reason FROM (
      SELECT id, row_number() OVER (PARTITION BY bucket ORDER BY ts DESC) AS pos, dense_rank() OVER (ORDER BY bucket DESC) AS nth
      FROM (SELECT *, date_trunc('{_SPANS[rule]}', made) AS bucket FROM catalog)) WHERE pos = 1 AND nth <= {n}"""


def _keeper(rule, n):
    def run(spark, sf_dir):
        return retention.keepers(catalog(spark, sf_dir), rule, n)

    query(f"keep_{rule}", files_sql(_kept_sql(rule, n), _CATALOG))(run)


for _rule, _n in {"last": 2, "daily": 3, "weekly": 2, "monthly": 2, "yearly": 1}.items():
    _keeper(_rule, _n)

_POLICY = retention.Policy(last=1, weekly=2, monthly=2)
_KEPT = "kept AS (" + " UNION ALL ".join(_kept_sql(rule, n) for rule, n in _POLICY.rules().items()) + ")"
_PLAN = """plan AS (SELECT c.id, '/' || c.id AS path, c.bytes,
    strftime(c.made, '%Y-%m-%dT%H:%M:%SZ') AS created, COALESCE(string_agg(k.reason, ',' ORDER BY k.reason), '') AS reasons,
    CASE WHEN count(k.reason) > 0 THEN 'kept' ELSE 'removed' END AS action
  FROM catalog c LEFT JOIN kept k ON c.id = k.id GROUP BY c.id, c.bytes, c.made)"""


@query("retention_plan", files_sql("SELECT * FROM plan", _CATALOG, _KEPT, _PLAN))
def retention_plan(spark, sf_dir):
    plan = retention.retention_plan(catalog(spark, sf_dir), _POLICY)
    return plan.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "forget_json",
    files_sql(
        """SELECT CAST(to_json({'schema_version': 1, 'kind': 'forget', 'applied': false,
          'kept': (SELECT list({'id': id, 'path': path, 'bytes': bytes, 'reasons': string_split(reasons, ',')} ORDER BY id DESC)
            FROM plan WHERE action = 'kept'),
          'removed': (SELECT list({'id': id, 'path': path, 'bytes': bytes, 'created': created} ORDER BY id DESC)
            FROM plan WHERE action = 'removed'),
          'skipped_unparseable': CAST([] AS VARCHAR[]),
          'total_removed_bytes': (SELECT CAST(sum(bytes) AS BIGINT) FROM plan WHERE action = 'removed')}) AS VARCHAR) AS json""",
        _CATALOG,
        _KEPT,
        _PLAN,
    ),
)
def forget_json(spark, sf_dir):
    return envelope.forget_json(retention.retention_plan(catalog(spark, sf_dir), _POLICY))


@query("removed_bytes", files_sql("SELECT CAST(sum(bytes) AS BIGINT) AS total_removed_bytes FROM plan WHERE action = 'removed'", _CATALOG, _KEPT, _PLAN))
def removed_bytes(spark, sf_dir):
    return retention.removed_bytes(retention.retention_plan(catalog(spark, sf_dir), _POLICY))


@query(
    "retained_files",
    I.inventory_sql(
        """SELECT snapshot_id, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM inv
        WHERE snapshot_id IN (SELECT id FROM plan WHERE action = 'kept') GROUP BY snapshot_id""",
        _CATALOG,
        _KEPT,
        _PLAN,
    ),
)
def retained_files(spark, sf_dir):
    plan = retention.retention_plan(catalog(spark, sf_dir), _POLICY)
    kept = retention.retained_files(entries(spark, sf_dir), plan)
    return kept.groupBy("snapshot_id").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


@query(
    "bucket_keys",
    """SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS daily, CAST(date_trunc('week', o_orderdate) AS DATE)::VARCHAR AS weekly,
      CAST(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS monthly, CAST(date_trunc('year', o_orderdate) AS DATE)::VARCHAR AS yearly
    FROM orders""",
)
def bucket_keys(spark, sf_dir):
    seconds = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400
    orders = I.table(spark, sf_dir, "orders").select(seconds.alias("ts"))
    return orders.select(*(bucket("ts").cast("string").alias(rule) for rule, bucket in BUCKETS.items())).distinct()


@query("union_all", files_sql(" UNION ALL ".join(
    f"SELECT '{one}' AS snapshot_id, dir, bytes FROM series WHERE snapshot_id = '{one}'" for one in I.IDS), _SERIES))
def union_all(spark, sf_dir):
    return reduce(DataFrame.unionByName, [trend.dir_series(usage(spark, sf_dir, one)) for one in I.IDS])
