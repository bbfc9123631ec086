import re

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import paths, scalars
from tallyhouse.functions.predicates import all_of, conditions, like


def values(spark, texts, column, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


PATHS = ["/a/b/c.txt", "/a.txt", "plain", "/a/", "/", "", "a/b", "/a//b", "/x/é/ü.txt", "/a/line\nbreak", "//"]


def test_paths(spark):
    assert values(spark, PATHS, paths.parent_dir) == [re.sub(r"/[^/]+\Z", "", p) for p in PATHS]
    assert values(spark, PATHS, paths.base_name) == [p.rsplit("/", 1)[-1] for p in PATHS]
    assert values(spark, PATHS, paths.slash_count) == [p.count("/") for p in PATHS]


def test_extension(spark):
    names = {".bashrc": "bashrc", "x.tar.GZ": "gz", "none": None, "dot.": None, "a..b": "b", "": None}
    assert values(spark, list(names), paths.extension) == list(names.values())


def test_depth(spark):
    assert values(spark, ["/vol", "/vol/a", "/vol/a/b"], lambda c: paths.depth_below(c, "/vol")) == [0, 1, 2]
    assert values(spark, ["/", "/a", "/a/b"], lambda c: paths.depth_below(c, "/")) == [0, 1, 2]


def test_explode_ancestors(spark):
    df = spark.createDataFrame([("/a/b/c", 1), ("x/y", 2), ("top", 3), ("", 4)], "path string, n int")
    found = paths.explode_ancestors(df, "path", "above")
    assert sorted((r["n"], r["above"]) for r in found.collect()) == [(1, "/a"), (1, "/a/b"), (2, "x")]
    own = paths.explode_ancestors(df, "path", "path", include_self=True)
    assert sorted((r["n"], r["path"]) for r in own.collect()) == [
        (1, "/a"), (1, "/a/b"), (1, "/a/b/c"), (2, "x"), (2, "x/y"), (3, "top"),
    ]


DURATIONS = {"30s": 30, "5m": 300, "2h": 7200, "7d": 604800, "1w": 604800, "6mo": 15552000, "1y": 31536000, "  7d  ": 604800}


def test_durations(spark):
    assert values(spark, list(DURATIONS), scalars.duration_seconds) == list(DURATIONS.values())
    assert [scalars.seconds_in(t) for t in DURATIONS] == list(DURATIONS.values())
    bad = ["", "abc", "30", "30x", "30 days", "9" * 30 + "d"]
    assert values(spark, bad, scalars.duration_seconds) == [None] * len(bad)
    for text in bad[:5]:
        with pytest.raises(ValueError):
            scalars.seconds_in(text)


SIZES = {
    "10": 10, "5b": 5, "1KB": 1024, "1KiB": 1024, "2mb": 2 << 20, "3 GiB": 3 << 30, "1TB": 1 << 40, "-1KB": -1024,
    "99999999TB": 2**63 - 1, "x": None, "1XB": None, "1.5GB": None, "1IB": None,
}


def test_sizes(spark):
    assert values(spark, list(SIZES), scalars.size_bytes) == list(SIZES.values())
    assert [scalars.bytes_in(t) for t in SIZES] == list(SIZES.values())


def test_human_size(spark):
    shown = {
        0: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1 KiB", 1536: "1.50 KiB", 16384: "16 KiB", 1152: "1.12 KiB",
        1048575: "1024.00 KiB", 5 << 30: "5 GiB", 3 << 59: "1.50 EiB",
    }
    assert values(spark, list(shown), scalars.human_size, "long") == list(shown.values())


def test_truncate_path(spark):
    assert values(spark, ["hello", "a" * 20, "0123456789"], lambda c: scalars.truncate_path(c, 10)) == [
        "hello", "..." + "a" * 7, "0123456789",
    ]


def test_rfc3339(spark):
    seconds = [None, 0, 1700000000, 253402300800, 8210266876799, 8210266876800]
    assert values(spark, seconds, scalars.rfc3339, "long") == [
        None, "1970-01-01T00:00:00Z", "2023-11-14T22:13:20Z", "+10000-01-01T00:00:00Z", "+262142-12-31T23:59:59Z", None,
    ]


def test_times_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, [1700000000], scalars.rfc3339, "long") == ["2023-11-14T22:13:20Z"]
        assert values(spark, ["2026-03-08_02-30"], scalars.snapshot_ts) == [1772937000]
        weekly = values(spark, [1767225600], lambda c: scalars.BUCKETS["weekly"](c).cast("string"), "long")
        assert weekly == ["2025-12-29"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_snapshot_ids(spark):
    ids = ["2026-05-15_11-56", "not-a-date", "2026-13-99_99-99", "2026-05-15_11-56x", None]
    assert values(spark, ids, scalars.snapshot_ts) == [1778846160, None, None, None, None]
    stems = {"/var/db/2026-05-15_11-56.db": "2026-05-15_11-56", "snap.db": "snap", ".hidden": ".hidden", "/a/b/": "b", "x.": "x"}
    assert values(spark, list(stems), scalars.file_stem) == list(stems.values())


def test_fill_second(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-5.0,), (1e-30,)], "rate double")
    fill = scalars.rfc3339(scalars.fill_second(F.lit(0), F.lit(10), F.col("rate")))
    assert [r[0] for r in df.select(fill).collect()] == ["1970-01-11T00:00:00Z", None, None, None]


@pytest.mark.parametrize("pattern, text, expected", [
    ("%.log", "/var/foo.log", True), ("%.log", "/var/foo.bin", False), ("/Users/%/Library/%", "/Users/me/Library/Caches", True),
    ("a_c", "abc", True), ("a_c", "ac", False), ("a.c", "abc", False), (r"a\_c", r"a\bc", True), ("", "", True), ("%", "", True),
    ("a%a", "a", False),
])
def test_like(spark, pattern, text, expected):
    assert values(spark, [text], lambda c: like(c, pattern)) == [expected]


RECORDS = [("/big.log", 4096, "log", 0.5), ("/big.bin", 4096, "bin", 0.9), ("/small.log", 100, "log", 0.1), ("/none", 5000, None, None)]


@pytest.mark.parametrize("where, kept", [
    ("size > 1024", ["/big.log", "/big.bin", "/none"]),
    ("size >= 4KiB", ["/big.log", "/big.bin", "/none"]),
    ("size > 1GB", []),
    ("ext = 'log'", ["/big.log", "/small.log"]),
    ("ext=log", ["/big.log", "/small.log"]),
    ("size > 1KB AND ext = 'log'", ["/big.log"]),
    ("size > 1KB and ext != \"log\"", ["/big.bin", "/none"]),
    ("path LIKE '%.log'", ["/big.log", "/small.log"]),
    ("missing != 'x'", ["/big.log", "/big.bin", "/small.log", "/none"]),
    ("missing = 'x'", []),
    ("ext = 5", []),
    ("ext != 5", ["/big.log", "/big.bin", "/small.log", "/none"]),
    ("ext > 'a'", []),
    ("size LIKE 4", []),
    ("score >= 0.5", ["/big.log", "/big.bin"]),
    ("", ["/big.log", "/big.bin", "/small.log", "/none"]),
    ("path = '/a AND b LIKE c'", []),
])
def test_filter_conditions(spark, where, kept):
    df = spark.createDataFrame(RECORDS, "path string, size long, ext string, score double")
    assert [r["path"] for r in df.where(all_of(df, where)).collect()] == kept


@pytest.mark.parametrize("text", ["just words", "size >", "= 5", "size > 1 AND", "AND size > 1 AND AND", "size > 1.5GB"])
def test_bad_conditions(text):
    with pytest.raises(ValueError):
        conditions(text)
