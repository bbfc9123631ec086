import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import reclaim, sweep, tree
from tallyhouse.operators.usage import dir_usage
from tallyhouse.sources.manifest import missing_directories

NAMES = ["a", "a b", "a-b", "a.b", "b", "node_modules", "target", "0", "\u00fc", "zz"]


def paths(rng, n):
    """Files of a random tree, with names that sort before and after the separator."""
    folders = ["/v"]
    for _ in range(n // 3):
        folders.append(f"{rng.choice(folders)}/{rng.choice(NAMES)}")
    return sorted({f"{rng.choice(folders)}/f{rng.randrange(50)}{rng.choice(['', '.x', ' y'])}" for _ in range(n)}), sorted(set(folders))


def below(path, above):
    return path.startswith(above.rstrip("/") + "/")


def order(path):
    return path.replace("/", "\x01")


@pytest.mark.parametrize("partitions", [1, 3, 12])
def test_sweep_equals_prefix_search(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for snapshot in ("s1", "s2"):
        files, folders = paths(rng, 120)
        rows += [(snapshot, f, True, 1, rng.randrange(9)) for f in folders if rng.random() < 0.7]
        rows += [(snapshot, f, False, 1, rng.choice([rng.randrange(10**12), None])) for f in files]
    frame = spark.createDataFrame(rows, "snapshot_id string, path string, opens boolean, n long, size long")
    found = {(r["snapshot_id"], r["path"]): r for r in sweep.path_sweep(frame, ["n", "size"], partitions).collect()}
    opened = [(s, p) for s, p, o, _, _ in rows if o]
    assert len(found) == len(opened)
    for s, p in opened:
        inside = [r for r in rows if r[0] == s and (below(r[1], p) or r[1] == p)]
        got = found[s, p]
        assert (got["n"], got["size"]) == (len(inside), sum(r[4] or 0 for r in inside)), p
        assert got["own_size"] == next(r[4] for r in rows if r[:3] == (s, p, True))
        assert got["pre"] == sum(a == s and order(b) < order(p) for a, b in opened)


def test_sweep_of_nothing_and_of_roots(spark):
    schema = "snapshot_id string, path string, opens boolean, n long"
    assert sweep.path_sweep(spark.createDataFrame([], schema), ["n"]).count() == 0
    rows = [("s", "/", True, 1), ("s", "/a", False, 2), ("s", "/a/b", True, 4), ("s", "/a/b/c", False, 8), ("s", "rel/x", True, 16), ("s", "s3://k/x", True, 32)]
    for partitions in (1, 6):
        found = {r["path"]: (r["pre"], r["n"]) for r in sweep.path_sweep(spark.createDataFrame(rows, schema), ["n"], partitions).collect()}
        assert found == {"/": (0, 15), "/a/b": (1, 12), "rel/x": (2, 16), "s3://k/x": (3, 32)}


@pytest.fixture
def inventory(entries):
    rng = random.Random(9)
    files, folders = paths(rng, 300)
    rows = [(p, rng.randrange(10**9)) for p in files] + [(f, None) for f in folders] + [("/v/empty", None), ("/v/empty/node_modules", None)]
    return entries(*rows, root="/v")


def test_tree_of_a_snapshot(inventory, monkeypatch):
    monkeypatch.setattr(sweep, "PARTITION_ROWS", 10)
    rows = inventory.collect()
    made = tree.directory_tree(dir_usage(inventory), inventory)
    found = {r["path"]: r for r in made.collect()}
    dirs = {r["path"] for r in rows if r["is_dir"]}
    assert set(found) == dirs
    for path, r in found.items():
        inside = [x for x in rows if not x["is_dir"] and below(x["path"], path)]
        assert (r["files"], r["bytes"]) == (len(inside), sum(x["size"] for x in inside))
        assert r["own_files"] == sum(x["path"].rsplit("/", 1)[0] == path for x in inside)
        assert r["depth"] == next(x["depth"] for x in rows if x["path"] == path)
        # another directory lies below exactly if its place is in the interval
        assert {p for p, x in found.items() if r["pre"] < x["pre"] <= r["last"]} == {p for p in dirs if below(p, path)}
    plain = {r["path"]: (r["bytes"], r["files"]) for r in tree.subtree_sizes(dir_usage(inventory)).where("path <> '/v/..'").collect()}
    assert {r["path"]: (r["bytes"], r["files"]) for r in tree.tree_sizes(made).collect()} == {p: x for p, x in plain.items() if p in dirs}
    for parent in ("/v", "/v/", "/", "/v/a", "/v/empty", "/none"):
        assert tree.tree_children(made, inventory, parent).collect() == tree.children(inventory, parent).collect(), parent
    for only in (False, True):
        assert reclaim.cleanup_scan(inventory, tree=made, outermost_only=only).collect() == reclaim.cleanup_scan(inventory, outermost_only=only).collect()
        assert reclaim.cleanup_scan(inventory, outermost_only=only).collect() == reclaim.cleanup_scan(inventory, usage=dir_usage(inventory), outermost_only=only).collect()


def test_several_snapshots_do_not_mix(inventory):
    two = inventory.unionByName(inventory.withColumn("snapshot_id", F.lit("2026-05-16_11-00")))
    once, twice = (tree.directory_tree(dir_usage(x), x) for x in (inventory, two))
    assert twice.count() == 2 * once.count()
    assert sorted(map(tuple, twice.drop("snapshot_id").distinct().collect())) == sorted(map(tuple, once.drop("snapshot_id").collect()))


def test_stored_tree_reads_no_file_rows(spark, inventory, tmp_path):
    from tallyhouse.sources.store import SnapshotStore

    snaps = SnapshotStore(spark, str(tmp_path / "s"))
    snaps.write(inventory, "2026-05-15_11-00", tree=True)
    with pytest.raises(LookupError, match="holds no tree"):
        snaps.write(inventory, "2026-05-16_11-00")
        snaps.tree()
    stored = snaps.tree("2026-05-15_11-00")
    files = snaps.files("2026-05-15_11-00")
    for frame in (reclaim.cleanup_scan(files, tree=stored), reclaim.cleanup_scan(files, tree=stored, outermost_only=True), tree.tree_sizes(stored)):
        assert all("/tree/" in f for f in frame.inputFiles()) and frame.count() > 0
    listed = tree.tree_children(stored, files, "/v")
    execution = listed._jdf.queryExecution()
    assert "StringStartsWith(path,/v/)" in execution.executedPlan().toString()
    # of the entries only the files of the parent itself pass the scan's filter
    assert "NOT is_dir" in execution.optimizedPlan().toString() and "Aggregate" not in execution.optimizedPlan().toString()
    assert listed.collect() == tree.children(files, "/v").collect()


def test_missing_directories_have_no_depth(entries):
    files = entries(("/v/a/b", 5), root="/v")
    made = tree.directory_tree(dir_usage(files), files).collect()
    assert [(r["path"], r["depth"], r["bytes"]) for r in made] == [("/v/a", None, 5)]
    full = files.unionByName(missing_directories(files, "/v", None))
    assert {r["path"] for r in tree.directory_tree(dir_usage(full), full).collect()} == {"/v", "/v/a"}
