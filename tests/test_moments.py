import random

import pytest
from conftest import records
from pyspark.sql import functions as F

from tallyhouse.operators import trend
from tallyhouse.sources.store import SnapshotStore
from tallyhouse.sources.trends import TrendTable, fitted, merged, moments_of

IDS = [f"2026-05-{day:02d}_10-00" for day in range(1, 8)]


@pytest.fixture
def snaps(spark, entries, tmp_path):
    rng = random.Random(3)
    made = SnapshotStore(spark, str(tmp_path / "s"))
    rows = None
    for k, one in enumerate(IDS):
        # constant, growing, shrinking, huge with tiny changes, gaps, and gone in the newest
        listing = [("/v/c/f", 500), ("/v/g/f", 10**6 * k), ("/v/s/f", 10**6 * (9 - k)), ("/v/h/f", 10**15 + k), (f"/v/r/f{k}", rng.randrange(10**9))]
        listing += [("/v/gap/f", 7 * k)] * (k % 2 == 0) + [("/v/gone/f", 5)] * (k < 6) + [("/v/new/f", 5 + k)] * (k > 4)
        part = entries(*listing, snapshot_id=one)
        rows = part if rows is None else rows.unionByName(part)
    made.write(rows, snapshot_ids=IDS)
    return made


def exact(frame):
    return {r["dir"]: tuple(r)[1:] for r in frame.select("dir", "n", "sx", "sy", "sxx", "sxy", "syy").collect()}


def test_adding_and_taking_back_equals_a_full_pass(snaps):
    table = TrendTable(snaps)
    assert table.ids() == [] and table.moments().count() == 0
    assert table.refresh(IDS[:2]) == IDS[:2] and table.refresh(IDS[:2]) == []
    for some in (IDS[:5], IDS[2:5], IDS[4:], IDS[1:], IDS):
        table.refresh(some)
        assert table.ids() == some
        assert exact(table.moments()) == exact(moments_of(snaps.usage(*some)))
    # a directory of which nothing is left has no row
    table.refresh(IDS[:5])
    assert "/v/new" not in exact(table.moments()) and "/v/new" in exact(moments_of(snaps.usage()))


def test_growth_from_moments_equals_the_full_fit(snaps):
    table = TrendTable(snaps)
    with pytest.raises(ValueError, match="at least 3"):
        table.growth_over_n()
    for some in (IDS[:4], IDS[2:], IDS):
        table.refresh(some)
        pairs = [(one, ts) for one, ts in snaps.last_n(7) if one in some]
        full = records(trend.growth_over_n(snaps.usage(*some), pairs, fill_target=10**9))
        kept = records(table.growth_over_n(fill_target=10**9))
        assert [r["path"] for r in kept] == [r["path"] for r in full] and len(full) >= 5
        for a, b in zip(kept, full):
            assert a["r2"] == pytest.approx(b["r2"], abs=1e-6) and abs(a["slope_bytes_per_day"] - b["slope_bytes_per_day"]) <= 1
            assert (a["latest_bytes"], a["n_snapshots"], a["sample_paths_ts"]) == (b["latest_bytes"], b["n_snapshots"], b["sample_paths_ts"])


def test_nothing_is_lost_of_tiny_changes_in_huge_directories(snaps):
    (row,) = fitted(moments_of(snaps.usage())).where("dir = '/v/h'").collect()
    assert (row["per_day"], row["r2"], row["n_snapshots"]) == (1.0, 1.0, 7)


def test_long_series_take_the_other_plan(snaps, monkeypatch):
    pairs = snaps.last_n(7)
    # running moments of doubles lose changes of one byte in 10^15, which columns keep
    usage = snaps.usage().where("dir <> '/v/h'")
    wide = records(trend.growth_over_n(usage, pairs, fill_target=10**9))
    monkeypatch.setattr(trend, "WIDE_SNAPSHOTS", 3)
    for a, b in zip(wide, records(trend.growth_over_n(usage, pairs, fill_target=10**9))):
        assert a["r2"] == pytest.approx(b["r2"], abs=1e-6) and abs(a["slope_bytes_per_day"] - b["slope_bytes_per_day"]) <= 1
        assert (a["path"], a["latest_bytes"], a["sample_paths_ts"]) == (b["path"], b["latest_bytes"], b["sample_paths_ts"])


def test_writers_of_moments_do_not_mix(snaps):
    table = TrendTable(snaps)
    assert snaps._mark("moments_claims/00000001")
    with pytest.raises(RuntimeError, match="another writer"):
        table.refresh(IDS)
    assert table.ids() == []
    table.release()
    assert table.refresh(IDS) == IDS


def test_merging_is_a_sum(snaps):
    whole = moments_of(snaps.usage())
    assert exact(merged(*(moments_of(snaps.usage(one)) for one in IDS))) == exact(whole)
    assert merged(whole, moments_of(snaps.usage(), -1)).count() == 0
    assert moments_of(snaps.usage().withColumn("snapshot_id", F.lit("manual"))).count() == 0
