"""Which snapshots a retention policy keeps.

Works on a catalog (id, path, bytes), one row per snapshot, such as
`SnapshotStore.listing()`.  Keepers are found with top-k plans, so not even
the catalog passes through a single task.
"""

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.scalars import BUCKETS, rfc3339, snapshot_ts


@dataclass(frozen=True)
class Policy:
    """How many snapshots each rule keeps; None switches a rule off."""

    last: int | None = None
    daily: int | None = None
    weekly: int | None = None
    monthly: int | None = None
    yearly: int | None = None

    def rules(self) -> dict[str, int]:
        return {rule: n for rule, n in asdict(self).items() if n is not None}


def _dated(catalog: DataFrame) -> DataFrame:
    ids = catalog.select("id", snapshot_ts("id").alias("ts"))
    return ids.where(F.col("ts").isNotNull())


def keep_last(catalog: DataFrame, n: int) -> DataFrame:
    """(id, reason) of the newest `n` snapshots."""
    newest = _dated(catalog).orderBy(F.desc("ts"), F.desc("id")).limit(n)
    return newest.select("id", F.lit("last").alias("reason"))


def keep_bucket(catalog: DataFrame, rule: str, n: int) -> DataFrame:
    """(id, reason) of the newest snapshot in each of the newest `n` days, weeks, months or years."""
    newest = (
        _dated(catalog)
        .groupBy(BUCKETS[rule]("ts").alias("bucket"))
        .agg(F.max(F.struct("ts", "id")).alias("newest"))
        .orderBy(F.desc("bucket"))
        .limit(n)
    )
    return newest.select("newest.id", F.lit(rule).alias("reason"))


def keepers(catalog: DataFrame, rule: str, n: int) -> DataFrame:
    return keep_last(catalog, n) if rule == "last" else keep_bucket(catalog, rule, n)


def retention_plan(catalog: DataFrame, policy: Policy) -> DataFrame:
    """The catalog with `created`, sorted `reasons` and `action`.

    `action` is kept, removed, or skipped for ids that name no time; those are
    never removed.
    """
    rules = policy.rules()
    if not rules:
        raise ValueError("a retention policy needs at least one rule")
    kept = reduce(DataFrame.unionByName, [keepers(catalog, rule, n) for rule, n in rules.items()])
    reasons = kept.groupBy("id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    ts = snapshot_ts("id")
    return catalog.select("id", "path", "bytes").join(reasons, "id", "left").select(
        "id",
        "path",
        "bytes",
        rfc3339(ts).alias("created"),
        F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
        F.when(ts.isNull(), "skipped")
        .when(F.col("reasons").isNotNull(), "kept")
        .otherwise("removed")
        .alias("action"),
    )


def removed_bytes(plan: DataFrame) -> DataFrame:
    """Stored bytes of the snapshots a plan drops, as one row."""
    gone = F.when(F.col("action") == "removed", F.col("bytes"))
    return plan.agg(F.coalesce(F.sum(gone), F.lit(0)).alias("total_removed_bytes"))


def retained_files(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Entries of the snapshots a plan does not drop.

    The plan is run and its ids, one short text per snapshot, become a filter on
    the partition column: dropped snapshots are not read and no file is shuffled.
    """
    stays = plan.where(F.col("action") != "removed").select("id")
    return files.where(F.col("snapshot_id").isin([row["id"] for row in stays.collect()]))
