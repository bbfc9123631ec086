import random
from collections import Counter

from tallyhouse.llm import sharding


def test_hypergeometric_draws_follow_the_law():
    from math import comb

    rng = random.Random(1)
    drawn = Counter(sharding.hypergeometric(rng, 6, 9, 7) for _ in range(20000))
    for k in range(7):
        wanted = comb(6, k) * comb(9, 7 - k) / comb(15, 7)
        assert abs(drawn[k] / 20000 - wanted) < 0.015
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0


def test_matrix_has_exact_margins():
    sizes = [0, 17, 3000, 1, 999, 52]
    matrix = sharding.communication_matrix(sizes, 7, 5)
    assert [sum(r) for r in matrix] == sizes
    columns = [sum(c) for c in zip(*matrix)]
    assert sum(columns) == sum(sizes) and max(columns) - min(columns) <= 1


def shards(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["shard"], []).append(r["slot"])
    return out


def test_sizes_slots_and_repeatability(spark):
    rows = spark.range(1003).selectExpr("id AS doc_id", "'x' AS text", "1 AS part", "id % 3 AS shard")
    found = sharding.shuffle_shards(rows, 24, by=["doc_id"], part_rows=10)
    assert found.columns == ["doc_id", "text", "part", "shard", "slot"]
    got = shards(found)
    assert len(got) == 24 and {len(x) for x in got.values()} == {41, 42}
    assert all(sorted(x) == list(range(len(x))) for x in got.values())
    again = sharding.shuffle_shards(rows.repartition(5), 24, by=["doc_id"], part_rows=10)
    assert sorted(found.collect()) == sorted(again.collect())
    other = sharding.shuffle_shards(rows, 24, by=["doc_id"], seed=8, part_rows=10)
    assert sorted(found.collect()) != sorted(other.collect())


def test_every_place_is_equally_likely(spark):
    rows = spark.range(8).withColumnRenamed("id", "doc_id")
    seen = Counter()
    for seed in range(60):
        for r in sharding.shuffle_shards(rows, 2, by=["doc_id"], seed=seed * 10).collect() if seed < 12 else []:
            seen[r["doc_id"], r["shard"]] += 1
    assert all(0 < seen[d, s] < 12 for d in range(8) for s in range(2))


def test_nulls_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a")] * 30 + [(1, None)] * 30, "doc_id long, text string")
    got = shards(sharding.shuffle_shards(rows, 24, by=["doc_id", "text"]))
    assert sorted(map(len, got.values())) == [2] * 12 + [3] * 12
    assert all(sorted(x) == list(range(len(x))) for x in got.values())
    assert sharding.shuffle_shards(rows.limit(0), 24, by=["doc_id"]).count() == 0
    assert sharding.shuffle_shards(rows.limit(5), 24, by=["doc_id"]).count() == 5
