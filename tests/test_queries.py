"""Every registered query against its SQL in DuckDB, and the plans of the costly ones."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_queries  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from tallyhouse.operators import compare, listings, reclaim, retention, tree, trend  # noqa: E402
from tallyhouse.operators.usage import dir_usage, usage_rows  # noqa: E402
from tallyhouse.plans import inventory as I  # noqa: E402
from tallyhouse.plans.registry import store  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    if name not in contract.oracle_sql():
        pytest.skip("not SQL: tests/llm compares it with brute force")
    rows, _, problem = check_queries.compare(spark, duck, SF_DIR, name)
    assert problem is None and rows > 0


def test_inventory_has_the_known_totals(spark):
    files = store(spark, "/root/testdata/sf0.01").files(I.LATEST)
    row = listings.stats(files).first()
    assert (row["files"] + row["dirs"], row["dirs"], row["total_bytes"]) == (57923, 2101, 3411902668)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(text, node):
    return len(re.findall(rf"[+:]- .*?{node}", text))


@pytest.fixture(scope="module")
def snaps(spark):
    return store(spark, SF_DIR)


def test_cleanup_has_no_join_and_one_shuffle_from_the_roll_up(snaps):
    text = plan(reclaim.cleanup_scan(snaps.files("@latest"), usage=snaps.usage("@latest")))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1


def test_comparisons_have_no_join_and_one_shuffle(snaps):
    a, b = I.PREVIOUS, I.LATEST
    for df in (compare.diff(snaps.files(a, b), a, b), compare.growth(usage_rows(snaps.files(a, b)), snaps.meta(), a, b)):
        text = plan(df)
        assert "Join" not in text and text.count("Exchange hashpartitioning") == 1
        assert "SortAggregate" not in text and "Sort [" not in text


def test_trends_have_one_scan_and_one_shuffle(snaps):
    for usage in (snaps.usage(), usage_rows(snaps.files())):
        text = plan(trend.growth_over_n(usage, I.TIMES))
        assert "SortAggregate" not in text and "ObjectHashAggregate" not in text and "Join" not in text
        assert text.count("FileScan") == text.count("Exchange") == 1 and "TakeOrderedAndProject" in text


def test_long_trends_gather_samples_of_the_listed_directories_only(snaps, monkeypatch):
    monkeypatch.setattr(trend, "WIDE_SNAPSHOTS", 3)
    text = plan(trend.growth_over_n(snaps.usage(), I.TIMES))
    assert "SortAggregate" not in text and "SortMergeJoin" not in text
    # the only lists are built above the join with the listed directories
    assert "TakeOrderedAndProject" in text and text.index("ObjectHashAggregate") < text.index("LeftSemi")


@pytest.mark.parametrize("build", [
    lambda f: listings.top_dirs(dir_usage(f)),
    listings.by_extension,
    listings.stats,
    lambda f: tree.subtree_sizes(dir_usage(f)),
    lambda f: tree.children(f, I.ROOT),
])
def test_aggregations_over_files_are_hash_based(snaps, build):
    text = plan(build(snaps.files("@latest")))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Join" not in text


def test_scans_read_only_what_they_need(snaps):
    text = plan(listings.top_dirs(dir_usage(snaps.files("@latest"))))
    assert "ReadSchema: struct<path:string,size:bigint,is_dir:boolean>" in text
    assert "EqualTo(is_dir,true)" in text.split("PushedFilters")[1]
    text = plan(listings.find_files(snaps.files("@latest"), "*.log"))
    assert "StringEndsWith(name,.log)" in text and "TakeOrderedAndProject" in text
    text = plan(listings.filter_where(snaps.files("@latest"), "size >= 1KB AND ext = 'log'"))
    assert "GreaterThanOrEqual(size,1024)" in text and "EqualTo(ext,log)" in text
    text = plan(tree.children(snaps.files("@latest"), "/vol/s1"))
    assert "StringStartsWith(path,/vol/s1/)" in text


def test_roll_up_needs_no_shuffle_for_top_dirs(snaps):
    assert "Exchange" not in plan(listings.top_dirs(snaps.usage("@latest")))


def test_retained_files_are_found_by_partition(spark, snaps):
    policy = retention.Policy(last=1, monthly=1)
    kept = retention.retained_files(snaps.files(), retention.retention_plan(snaps.listing(), policy))
    text = plan(kept)
    assert "Join" not in text and re.search(rf"PartitionFilters: \[[^]]*snapshot_id#[0-9]+ = {I.LATEST}", text)


def test_one_snapshot_lists_one_folder(snaps):
    assert len(set(re.findall(r"snapshot_id=([0-9_-]+)/", " ".join(snaps.files("@latest").inputFiles())))) == 1
