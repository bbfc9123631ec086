import pytest
from conftest import records
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.operators import compare, shape, trend
from tallyhouse.operators.usage import dir_usage, usage_rows
from tallyhouse.sources.store import at_age, catalog_from, last_n, resolve, scan_meta

A, B = "2026-05-14_11-00", "2026-05-16_11-00"
DAY = 86400


@pytest.fixture
def pair(entries):
    def build(rows_a, rows_b):
        return entries(*rows_a, snapshot_id=A).unionByName(entries(*rows_b, snapshot_id=B))

    return build


def test_growth_kinds(pair):
    files = pair(
        [("/t/stable/k", 1024), ("/t/growing/s", 1024), ("/t/going/d", 4096)],
        [("/t/stable/k", 1024), ("/t/growing/s", 1024), ("/t/growing/b", 16384), ("/t/new/h", 2048)],
    )
    for usage in (usage_rows(files), dir_usage(files)):
        rows = {r["path"]: r for r in records(compare.growth(usage, scan_meta(files), A, B))}
        assert {p: r["kind"] for p, r in rows.items()} == {
            "/t/growing": "grew", "/t/going": "removed", "/t/new": "added",
        }
        assert rows["/t/growing"]["delta_bytes"] == 16384
        assert rows["/t/growing"]["days_between"] == 2.0
        assert rows["/t/growing"]["rate_bytes_per_day"] == 8192.0


def test_growth_rate_without_a_span_is_the_change(pair):
    files = pair([("/t/x/a", 1)], [("/t/x/a", 11)])
    for meta in (scan_meta(files).where("false"), scan_meta(files, started_at=5)):
        (row,) = records(compare.growth(usage_rows(files), meta, A, B))
        assert (row["days_between"], row["rate_bytes_per_day"]) == (1.0, 10.0)


def test_diff_kinds_and_edges(pair):
    files = pair(
        [("/stay", 4096), ("/grew", 1024), ("/removed", 2048), ("/gone-empty", 0), ("/filled", 0), ("/swap", 9), ("/shrank", 9)],
        [("/stay", 4096), ("/grew", 8192), ("/added", 512), ("/filled", 3), ("/swap", None), ("/shrank", 2), ("/new-empty", 0)],
    )
    rows = {r["path"]: (r["kind"], r["delta"]) for r in records(compare.diff(files, A, B))}
    assert rows == {
        "/grew": ("grew", 7168), "/removed": ("removed", -2048), "/added": ("added", 512),
        "/filled": ("added", 3), "/shrank": ("shrank", -7),
        "/gone-empty": ("shrank", 0), "/new-empty": ("shrank", 0),
    }
    assert [r["path"] for r in records(compare.diff(files, A, B, limit=1))] == ["/grew"]


def _five(entries, sizes):
    """Directories with one file each, over five daily snapshots."""
    snapshots = [(f"2023-11-{14 + i}_22-13", 1700000000 + i * DAY) for i in range(5)]
    files = None
    for i, (one, _) in enumerate(snapshots):
        rows = [(f"/t/{name}/f", series[i]) for name, series in sizes.items() if series[i] is not None]
        part = entries(*rows, snapshot_id=one)
        files = part if files is None else files.unionByName(part)
    return files, snapshots


def test_growth_over_n(entries):
    files, snapshots = _five(entries, {
        "growing": [1024, 2048, 4096, 8192, 16384],
        "stable": [1024] * 5,
        "gap": [10, None, 30, None, 50],
        "gone": [1, 2, 3, 4, None],
        "short": [None, None, None, 5, 6],
    })
    rows = {r["path"]: r for r in records(trend.growth_over_n(dir_usage(files), snapshots, fill_target=1048576))}
    assert set(rows) == {"/t/growing", "/t/stable", "/t/gap"}
    growing = rows["/t/growing"]
    assert growing["slope_bytes_per_day"] == 3686 and growing["r2"] > 0.8
    assert (growing["n_snapshots"], growing["latest_bytes"]) == (5, 16384)
    assert growing["projected_fill_date"].startswith("2024-08-")
    assert [s["bytes"] for s in growing["sample_paths_ts"]] == [1024, 2048, 4096, 8192, 16384]
    stable = rows["/t/stable"]
    assert (stable["slope_bytes_per_day"], stable["r2"], stable["projected_fill_date"]) == (0, 0.0, None)
    assert rows["/t/gap"]["n_snapshots"] == 3 and rows["/t/gap"]["slope_bytes_per_day"] == 10
    assert records(trend.growth_over_n(dir_usage(files), snapshots))[0]["projected_fill_date"] is None
    with pytest.raises(ValueError, match="at least 3"):
        trend.growth_over_n(dir_usage(files), snapshots[:2])


@pytest.mark.parametrize("n", [3, 64, 65, 200])
def test_histories_of_any_length_are_treated_alike(spark, n):
    snapshots = [(f"s{i:03d}", 1700000000 + i // 2 * DAY) for i in range(n)]
    usage = spark.createDataFrame([(one, "/d", 1, 100 + i, 100 + i) for i, (one, _) in enumerate(snapshots)], S.USAGE)
    for given in (snapshots, snapshots[::-1]):
        (row,) = records(trend.growth_over_n(usage, given))
        assert (row["n_snapshots"], row["latest_bytes"]) == (n, 99 + n)
        assert [(s["ts"], s["bytes"]) for s in row["sample_paths_ts"]] == [(ts, 100 + i) for i, (_, ts) in enumerate(snapshots)]
        (whole,) = records(trend.directory_trends(usage, given))
        assert whole["samples"] == row["sample_paths_ts"] and whole["latest_bytes"] == 99 + n


def test_growth_over_n_sums_rows_of_files(entries):
    files, snapshots = _five(entries, {"growing": [1024, 2048, 4096, 8192, 16384]})
    twice = files.unionByName(files.withColumn("path", F.regexp_replace("path", "f$", "g")))
    assert records(trend.growth_over_n(usage_rows(twice), snapshots)) == records(trend.growth_over_n(dir_usage(twice), snapshots))


@pytest.mark.parametrize("points, slope, intercept, r2", [
    ([(i, 2 * i + 3) for i in range(5)], 2.0, 3.0, 1.0),
    ([(i, 10) for i in range(4)], 0.0, 10.0, 0.0),
    ([(0, 5), (1, 10)], 5.0, 5.0, 1.0),
    ([(0, 5), (1, 5)], 0.0, 5.0, 1.0),
    ([(4, 5), (4, 9), (4, 1)], 0.0, 5.0, 0.0),
])
def test_ols_fit(spark, points, slope, intercept, r2):
    df = spark.createDataFrame([("k", float(x), float(y)) for x, y in points], "k string, x double, y double")
    (row,) = records(trend.ols_fit(df, "k", "x", "y"))
    assert row["slope"] == pytest.approx(slope) and row["intercept"] == pytest.approx(intercept)
    assert row["r2"] == pytest.approx(r2)


def _totals(spark, *rows):
    return spark.createDataFrame(rows, "snapshot_id string, bytes long")


def test_predict(spark):
    totals = _totals(spark, ("2026-05-01_00-00", 100), ("2026-05-02_00-00", 200), ("2026-05-03_00-00", 300), ("odd", 9))
    (row,) = records(trend.predict(totals, 1000))
    assert row["growth_rate_bytes_per_day"] == pytest.approx(100) and row["samples"] == 3
    assert row["days_until_fill"] == pytest.approx(10) and row["fill_at"] == "2026-05-13T00:00:00Z"
    assert (row["current_bytes"], row["confidence_r2"], row["reason"]) == (300, pytest.approx(1.0), None)


def test_predict_reasons(spark):
    one = ("2026-05-01_00-00", 100)
    for rows, free, reason in [
        ([("odd", 1)], 5, "no snapshots"),
        ([one], 5, "insufficient history"),
        ([one, ("2026-05-02_00-00", 50)], 5, "flat or shrinking"),
        ([one, ("2026-05-02_00-00", 150)], None, "not given"),
    ]:
        (row,) = records(trend.predict(_totals(spark, *rows), free))
        assert reason in row["reason"] and row["fill_at"] is None


PATTERNS = {
    "too-few": ([100, 200], "unknown"),
    "log": ([10_000_000, 100_000_000, 101_000_000, 101_500_000, 102_000_000, 102_400_000], "log_shaped"),
    "burst": ([10_000_000, 10_500_000, 11_000_000, 11_500_000, 12_000_000, 500_000_000], "burst"),
    "flat": ([1_000_000, 1_005_000, 1_002_000, 1_004_000, 1_003_000, 1_001_500], "stable"),
    "constant": ([5_000_000] * 6, "stable"),
    "down": ([10_000_000, 9_000_000, 8_000_000, 7_000_000, 6_000_000, 5_000_000], "declining"),
    "noisy-down": ([10_000_000, 9_500_000, 8_800_000, 8_000_000, 7_500_000, 6_900_000], "declining"),
    "five-log": ([10_000_000, 200_000_000, 201_000_000, 201_500_000, 202_000_000], "log_shaped"),
    "five-burst": ([10_000_000, 11_000_000, 200_000_000, 200_500_000, 201_000_000], "burst"),
    "one-step": ([5, 5, 5, 5, 9, 9], "burst"),
    "between": ([0, 100, 0, 350, 250, 350], "unknown"),
    # Of two largest strides the later one decides.
    "two-largest": ([0, 900, 900, 900, 1800, 1800, 1800], "burst"),
}


def test_classify_pattern(spark):
    snapshots = [(f"s{i}", 1000 + 60 * i) for i in range(7)]
    rows = [(f"s{i}", name, b) for name, (sizes, _) in PATTERNS.items() for i, b in enumerate(sizes)]
    series = spark.createDataFrame(rows, "snapshot_id string, dir string, bytes long")
    found = {r["path"]: r["pattern"] for r in records(shape.classify_pattern(series, snapshots))}
    assert found == {name: pattern for name, (_, pattern) in PATTERNS.items()}


def test_strides(spark):
    snapshots = [(f"s{i}", i) for i in range(5)]
    rows = [(f"s{i}", "d", b) for i, b in enumerate([1, 2, 0, 3, 7])] + [("s0", "single", 4)]
    series = spark.createDataFrame(rows, "snapshot_id string, dir string, bytes long")
    trends = trend.directory_trends(series, snapshots)
    assert sorted((r["idx"], r["stride"]) for r in records(shape.strides(trends))) == [(0, 1), (1, -2), (2, 3), (3, 4)]
    found = {r["path"]: r for r in records(shape.with_strides(trends).select("path", "stride_median", "max_stride", "max_stride_index"))}
    assert found["d"] == {"path": "d", "stride_median": 2.5, "max_stride": 4, "max_stride_index": 3}
    assert found["single"]["max_stride"] is None


def test_references(spark):
    ids = ["2026-05-13_10-00", "2026-05-14_10-00", "2026-05-15_10-00", "my-manual-snapshot"]
    meta = spark.createDataFrame([(i,) for i in ids], "snapshot_id string")
    catalog = catalog_from(meta)

    def ref(spec):
        return [r[0] for r in resolve(catalog, spec).collect()]

    assert ref("@latest") == ["my-manual-snapshot"]
    assert ref("@latest~1") == ["2026-05-15_10-00"] and ref("@latest~4") == []
    assert ref("2026-05-14_10-00") == ["2026-05-14_10-00"] and ref("nope") == []
    with pytest.raises(ValueError):
        resolve(catalog, "@latest~x")
    noon = 1778846400  # 2026-05-15 12:00 UTC
    assert [r[0] for r in at_age(catalog, noon, DAY).collect()] == ["2026-05-14_10-00"]
    assert at_age(catalog, noon, 90 * DAY).collect() == []
    assert [r[0] for r in last_n(catalog, 3).collect()] == ids[:3]
    with pytest.raises(ValueError, match="at least 3"):
        last_n(catalog, 2)
