import pytest
from conftest import NOW, records

from tallyhouse.operators import activity, listings, tree
from tallyhouse.operators.usage import dir_usage
from tallyhouse.sources.store import scan_meta


def test_top_files_are_sorted_and_limited(seeded):
    assert [r["size"] for r in records(listings.top_files(seeded, 2))] == [16384, 8192]
    assert len(records(listings.top_files(seeded, 10, min_size=5000))) == 2
    assert records(listings.top_files(seeded, 1)) == [
        {"path": "/a/big.bin", "size": 16384, "ext": "bin", "mtime": "2023-11-14T22:13:20Z"}
    ]


def test_directories_are_no_files(seeded):
    paths = {r["path"] for r in records(listings.top_files(seeded, 100))}
    assert len(paths) == 4 and not paths & {"/a", "/b"}


def test_by_extension(entries, seeded):
    rows = {r["ext"]: r for r in records(listings.by_extension(seeded))}
    assert rows["bin"] == {"ext": "bin", "files": 2, "total_size": 24576}
    bare = listings.by_extension(entries(("/x/Makefile", 5), ("/x/.", 1), ("/x/y.", 2)))
    assert records(bare) == [{"ext": "(none)", "files": 3, "total_size": 8}]


def test_stats(seeded):
    (row,) = records(listings.with_scan_meta(listings.stats(seeded), scan_meta(seeded, "/", 100, 160)))
    assert (row["files"], row["dirs"], row["total_bytes"], row["largest_bytes"]) == (4, 2, 28928, 16384)
    assert (row["avg_bytes"], row["partial"], row["scan_duration_s"]) == (7232, False, 60)
    assert records(listings.stats_scalar(listings.stats(seeded)))[0]["bytes"] == 28928


def test_partial_scan_and_missing_scan_data(seeded):
    meta = scan_meta(seeded, "/", 100, 50, completed=False)
    (row,) = records(listings.with_scan_meta(listings.stats(seeded), meta))
    assert (row["files"], row["partial"], row["scan_duration_s"]) == (4, True, 0)
    (row,) = records(listings.with_scan_meta(listings.stats(seeded), meta.where("false")))
    assert (row["files"], row["partial"], row["scan_root"]) == (4, False, None)


def test_top_dirs_counts_direct_children_only(entries):
    files = entries(("/a/x", 1), ("/a/b/y", 10), ("/a/b/z", 5), ("/top", 3))
    assert [tuple(r.values()) for r in records(listings.top_dirs(dir_usage(files)))] == [("/a/b", 15), ("", 3), ("/a", 1)]


def test_physical_falls_back_to_logical(spark, entries):
    from pyspark.sql import functions as F

    files = entries(("/a/x", 100), ("/a/y", 10)).withColumn(
        "physical_size", F.when(F.col("name") == "y", F.lit(4096).cast("long"))
    )
    assert [r["size"] for r in records(listings.top_files(files, physical=True))] == [4096, 100]
    assert records(listings.top_dirs(dir_usage(files), physical=True))[0]["total_size"] == 4196
    assert records(listings.stats(files, physical=True))[0]["total_bytes"] == 4196


def test_empty_and_old_files(entries):
    files = entries(("/b", 0, 1), ("/a", 0, 1500000000), ("/c", 7, 1400000000), ("/n", 7, None), ("/d", None))
    assert [r["path"] for r in records(listings.empty_files(files))] == ["/a", "/b"]
    # Placeholder and unknown times are not old.
    assert [r["path"] for r in records(listings.old_files(files, 1600000000))] == ["/c", "/a"]
    assert records(listings.old_files(files, 1400000000)) == []


@pytest.mark.parametrize(
    "pattern, found", [("*.log", ["x.log"]), ("?.log", ["x.log"]), ("X*", []), ("a_b", ["a_b"]), (r"c\d*", [r"c\dx"])]
)
def test_find_files(entries, pattern, found):
    files = entries(("/l/x.log", 3), ("/l/x.txt", 2), ("/l/a_b", 1), (r"/l/c\dx", 4), ("/l/x.log.d", None))
    assert [r["path"].rsplit("/", 1)[1] for r in records(listings.find_files(files, pattern))] == found


def test_churn(entries):
    files = entries(
        ("/t/hot/1.log", 4096, NOW),
        ("/t/hot/2.log", 8192, NOW),
        ("/t/hot/3.log", 4096, NOW - 90 * 86400),
        ("/t/cold/x.bin", 16384, NOW - 180 * 86400),
        ("/t/zero/e", 0, NOW),
    )
    rows = {r["path"]: r for r in records(activity.churn(files, NOW - 86400))}
    assert set(rows) == {"/t/hot", "/t/zero"}
    assert rows["/t/hot"]["recent_files"] == 2 and rows["/t/hot"]["churn_score"] == 0.75
    assert rows["/t/zero"]["churn_score"] == 0.0


def test_bundle_holds_only_what_was_asked_for(seeded):
    rows = records(listings.scan_bundle(seeded, dir_usage(seeded), top=1, ext=2))
    assert [r["section"] for r in rows] == ["stats", "top", "ext", "ext"]
    assert rows[0]["dirs"] == 2 and rows[1]["bytes"] == 16384


def test_subtrees_children_and_root(entries):
    files = entries(
        ("/r", None), ("/r/a", None), ("/r/a/deep", None), ("/r/ab", None), ("/r/empty", None),
        ("/r/a/1", 5), ("/r/a/deep/2", 7), ("/r/ab/3", 100), ("/r/4", 1), ("/r%/5", 50), root="/r",
    )
    sums = {r["path"]: (r["bytes"], r["files"]) for r in records(tree.subtree_sizes(dir_usage(files)))}
    assert sums["/r"] == (113, 4) and sums["/r/a"] == (12, 2) and sums["/r/ab"] == (100, 1)
    kids = [(r["name"], r["is_dir"], r["size"]) for r in records(tree.children(files, "/r"))]
    assert kids == [("ab", True, 100), ("a", True, 12), ("4", False, 1), ("empty", True, 0)]
    assert [r["path"] for r in records(tree.children(files, "/"))] == ["/r"]
    assert records(tree.root_total(files)) == [{"root": "/r", "total_bytes": 163}]
    assert records(tree.root_total(files.where("depth > 0")))[0]["root"] == "/"
