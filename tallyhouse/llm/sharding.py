"""Uniform shuffling into shards of exact size, by a hypergeometric communication matrix.

Rows are dealt to source partitions by hash.  How many rows each partition sends to
each shard is drawn in advance from the multivariate hypergeometric law, which is the
law of these counts in a uniform permutation; then each partition permutes its rows
locally and cuts the permutation at those counts, the rows are exchanged, and each
shard is permuted again, in blocks of bounded size.
"""

import math
import random
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.session import written

#: Rows in a source partition or in a block of a shard, about.
PART_ROWS = 50_000
LEAST_PARTS = 64


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls taken without replacement are among the `good` ones.

    Inversion that starts at the mode and goes outward: some standard deviations
    of steps, whatever the numbers.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - at_mode
    down, up, p_down, p_up = mode, mode, at_mode, at_mode
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """For each partition the rows it sends to each shard; shard sizes are at most one apart."""
    rng = random.Random(seed)
    total = sum(sizes)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for size in sizes:
        row, left, rest = [], size, sum(room)
        for s in range(n_shards):
            rest -= room[s]
            row.append(hypergeometric(rng, room[s], rest, left))
            left -= row[-1]
        room = [free - sent for free, sent in zip(room, row)]
        matrix.append(row)
    return matrix


def shuffle_shards(rows: DataFrame, n_shards: int, by: list[str], seed: int = 7, part_rows: int = PART_ROWS) -> DataFrame:
    """`rows` with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    Every order of the rows over all slots is equally likely, up to the quality of the
    64-bit hashes of the columns `by`, which also make the result repeatable: a task
    that runs again deals its rows in the same way.  Rows equal in `by` are told apart
    only by their other columns; if they are equal in all, they are interchangeable.
    Shards differ by one row at most.  An empty table gives an empty result; nulls
    are values like others; `shard` and `slot` columns of the input are replaced.

    The driver sees one count for each source partition, a row count divided by
    `part_rows`.  `rows` is read once for the counts and once to be dealt.
    """
    spark = rows.sparkSession
    tag = f"_{uuid.uuid4().hex[:8]}"
    part, first, second, rank, ends, block, before = (f"{x}{tag}" for x in ("part", "first", "second", "rank", "ends", "block", "before"))
    rows = rows.drop("shard", "slot")
    keys = [rows[c] for c in by]

    total = rows.count()
    parts = max(LEAST_PARTS, -(-total // part_rows))
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(parts)))
    counts = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], n_shards, seed)
    cuts = spark.createDataFrame(
        [(p, [sum(sent[: s + 1]) for s in range(n_shards)]) for p, sent in enumerate(matrix)],
        f"{part} bigint, {ends} array<bigint>",
    )

    local = Window.partitionBy(part).orderBy(first, *by)
    sent = (
        dealt.withColumn(first, F.xxhash64(*keys, F.lit(seed + 1)))
        .withColumn(rank, F.row_number().over(local) - 1)
        .join(cuts, part)
        .withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(rank))))
    )
    sent = written(sent.drop(part, first, rank, ends), "shards")

    bits = max(1, math.ceil(math.log2(max(1, total / n_shards / part_rows))))
    again = sent.withColumn(second, F.xxhash64(*[sent[c] for c in by], F.lit(seed + 2))).withColumn(
        block, F.shiftrightunsigned(second, 64 - bits)
    )
    starts = again.groupBy("shard", block).agg(F.count(F.lit(1)).alias(before))
    starts = starts.withColumn(
        before,
        F.coalesce(F.sum(before).over(Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    inner = Window.partitionBy("shard", block).orderBy(second, *by)
    return (
        again.withColumn("slot", F.row_number().over(inner) - 1)
        .join(starts, ["shard", block])
        .withColumn("slot", (F.col("slot") + F.col(before)).cast("long"))
        .select(*rows.columns, "shard", "slot")
    )
