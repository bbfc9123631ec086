"""Time the headline queries on a stored inventory; prints one JSON line.

The inventory is derived from $BENCH_SF_DIR and committed as five snapshots
(`ingest`); every query then reads the stored snapshots.  A query's time is the
median of five runs after one warm-up, from building the DataFrame to having
its rows.  `value` is the sum of the query medians, ingest not included.
"""

import json
import os
import platform
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from tallyhouse.operators import activity, compare, listings, reclaim, retention, shape, tree, trend
from tallyhouse.operators.usage import dir_usage, usage_rows
from tallyhouse.plans import inventory as I
from tallyhouse.session import local_session, working_folder
from tallyhouse.sources.store import SnapshotStore

RUNS = 5


def headline(store: SnapshotStore) -> dict:
    """Query name -> function building its DataFrame; names in `_stored` read the roll-up."""
    a, b = store.resolve("@latest~1"), store.resolve("@latest")
    last = store.last_n(5)
    latest, rolled_up = (lambda: store.files(b)), (lambda: store.usage(b))

    def all_usage():
        return store.usage(*(one for one, _ in last))

    def plan():
        return retention.retention_plan(store.listing(), retention.Policy(last=1, weekly=2, monthly=2))

    return {
        "top_files": lambda: listings.top_files(latest()),
        "top_dirs": lambda: listings.top_dirs(dir_usage(latest())),
        "top_dirs_stored": lambda: listings.top_dirs(rolled_up()),
        "by_extension": lambda: listings.by_extension(latest()),
        "stats": lambda: listings.with_scan_meta(listings.stats(latest()), store.meta()),
        "find_files": lambda: listings.find_files(latest(), "f1*_2_*.log"),
        "old_files": lambda: listings.old_files(latest(), 1702000000),
        "empty_files": lambda: listings.empty_files(latest()),
        "churn": lambda: activity.churn(latest(), 1702500000),
        "diff": lambda: compare.diff(store.files(a, b), a, b),
        "growth": lambda: compare.growth(usage_rows(store.files(a, b)), store.meta(), a, b),
        "growth_stored": lambda: compare.growth(store.usage(a, b), store.meta(), a, b),
        "growth_over_n": lambda: trend.growth_over_n(usage_rows(store.files(*(one for one, _ in last))), last, fill_target=10**9),
        "growth_over_n_stored": lambda: trend.growth_over_n(all_usage(), last, fill_target=10**9),
        "classify_stored": lambda: shape.classify_pattern(all_usage(), last).groupBy("pattern").count(),
        "predict_stored": lambda: trend.predict(store.meta(), 10**10),
        "cleanup_scan": lambda: reclaim.cleanup_scan(latest()),
        "cleanup_scan_stored": lambda: reclaim.cleanup_scan(latest(), tree=store.tree(b)),
        "after_cleanup": lambda: listings.stats(reclaim.after_cleanup(latest(), reclaim.cleanup_scan(latest(), usage=rolled_up()))),
        "subtree_sizes_stored": lambda: tree.tree_sizes(store.tree(b)).orderBy(F.desc("bytes"), "path").limit(100),
        "children": lambda: tree.tree_children(store.tree(b), latest(), I.ROOT),
        "retention_plan": plan,
    }


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cores, **{"spark.sql.shuffle.partitions": cores})
    store = SnapshotStore(spark, working_folder(spark, "bench"))
    start = time.perf_counter()
    store.write(I.file_rows(spark, sf_dir), snapshot_ids=I.IDS, root=I.ROOT, directories=True, dir_mtime=I.DIR_MTIME, tree=True)
    ingest = time.perf_counter() - start
    times, rows = {}, {}
    for name, build in headline(store).items():
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            rows[name] = len(build().collect())
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 4)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "ingest_sec": round(ingest, 3),
                "entries": store.meta().agg(F.sum("entries")).first()[0],
                "result_rows": rows,
                "runs": RUNS,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "machine": f"{platform.system()} {platform.machine()}",
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
