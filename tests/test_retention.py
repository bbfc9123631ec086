import pytest
from conftest import records

from tallyhouse.operators.retention import Policy, keep_bucket, removed_bytes, retained_files, retention_plan


@pytest.fixture
def catalog(spark):
    def build(*rows):
        return spark.createDataFrame([(i, f"/t/{i}", b) for i, b in rows], "id string, path string, bytes long")

    return build


def actions(plan):
    return {r["id"]: (r["action"], r["reasons"]) for r in records(plan)}


def test_empty_policy_is_refused(catalog):
    with pytest.raises(ValueError):
        retention_plan(catalog(("2026-05-15_11-56", 1)), Policy())


def test_keep_last(catalog):
    plan = retention_plan(catalog(("2026-05-15_11-00", 100), ("2026-05-15_12-00", 200), ("2026-05-15_13-00", 300)), Policy(last=2))
    assert actions(plan) == {
        "2026-05-15_11-00": ("removed", []),
        "2026-05-15_12-00": ("kept", ["last"]),
        "2026-05-15_13-00": ("kept", ["last"]),
    }
    assert records(removed_bytes(plan)) == [{"total_removed_bytes": 100}]


def test_keep_daily_takes_the_newest_of_each_day(catalog):
    snaps = catalog(("2026-05-13_10-00", 10), ("2026-05-14_10-00", 20), ("2026-05-14_15-00", 25), ("2026-05-15_10-00", 30))
    plan = actions(retention_plan(snaps, Policy(daily=2)))
    assert {i for i, (a, _) in plan.items() if a == "kept"} == {"2026-05-15_10-00", "2026-05-14_15-00"}


def test_iso_weeks_months_and_years(catalog):
    snaps = catalog(("2025-12-28_10-00", 1), ("2025-12-29_10-00", 1), ("2026-01-01_10-00", 1), ("2026-01-05_10-00", 1))

    def kept(rule, n):
        return sorted(r["id"] for r in records(keep_bucket(snaps, rule, n)))

    # The week of 2026-01-01 began on Monday 2025-12-29.
    assert kept("weekly", 3) == ["2025-12-28_10-00", "2026-01-01_10-00", "2026-01-05_10-00"]
    assert kept("monthly", 2) == ["2025-12-29_10-00", "2026-01-05_10-00"]
    assert kept("yearly", 5) == ["2025-12-29_10-00", "2026-01-05_10-00"]
    assert kept("daily", 0) == []


def test_odd_ids_are_never_removed(catalog, entries):
    snaps = catalog(("2026-05-15_11-00", 100), ("2026-05-14_11-00", 7), ("my-manual-snapshot", 200))
    plan = retention_plan(snaps, Policy(last=1, daily=1))
    assert actions(plan) == {
        "2026-05-15_11-00": ("kept", ["daily", "last"]),
        "2026-05-14_11-00": ("removed", []),
        "my-manual-snapshot": ("skipped", []),
    }
    assert records(removed_bytes(plan))[0]["total_removed_bytes"] == 7
    created = {r["id"]: r["created"] for r in records(plan)}
    assert created["2026-05-15_11-00"] == "2026-05-15T11:00:00Z" and created["my-manual-snapshot"] is None
    files = entries(("/a", 1), snapshot_id="2026-05-14_11-00").unionByName(entries(("/b", 1), snapshot_id="my-manual-snapshot"))
    assert [r["path"] for r in records(retained_files(files, plan))] == ["/b"]
