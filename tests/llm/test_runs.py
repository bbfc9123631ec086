import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import runs
from tallyhouse.llm.queries import QUERIES

BIG = 2**53 + 1


def brute(words):
    """(start, length, smallest period) by scanning every lag."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items() if m >= 12)


def answer(words):
    """The contract's columns for a list of words."""
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))


def strings(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 4)):
        a = rng.randrange(len(words) + 1)
        p = rng.randint(1, max(1, (len(words) - a) // 2))
        kind = rng.random()
        if kind < 0.4:
            for i in range(a + p, min(len(words), a + rng.randint(1, 4 * p))):
                words[i] = words[i - p]
        elif kind < 0.7:
            words[a:a] = words[a : a + p]
        else:
            # a period inside a period
            inner = ([0, 1] * 40)[: rng.randint(1, 70)]
            words[a:a] = inner * 3
    return words


def test_all_runs_of_random_strings():
    rng = random.Random(11)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    fixed = [fibonacci[-1], [0] * 200, ([0] * 40 + [1]) * 5, ([0] * 17 + [1] + [0] * 17 + [2]) * 4, ([0, 1] * 20 + [0]) * 4, [], [1]]
    for words in fixed + [strings(rng) for _ in range(600)]:
        found = sorted((s, e - s, q) for s, e, q in runs.find_runs(np.array(words, np.int64)).tolist())
        assert found == brute(words), words


def test_long_texts_of_one_word_and_of_two_halves():
    n = 60_000
    assert runs.find_runs(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    assert runs.find_runs(np.tile(np.arange(n // 2), 2)).tolist() == [[0, n, n // 2]]
    # 40 short runs, whose breaks repeat
    found = runs.find_runs(np.tile(np.r_[np.zeros(999, np.int64), 1], 40)).tolist()
    assert [0, 40_000, 1000] in found and len(found) == 41


def test_minima_of_every_window():
    rng = np.random.default_rng(3)
    at = np.flatnonzero(rng.random(400) < 0.3)
    gram = rng.integers(0, 9, len(at))
    found = set(runs.window_minima(at, gram, 8).tolist())
    order = dict(zip(gram.tolist(), runs.gram_hash(gram).tolist()))
    wanted = set()
    for j in range(-8, 408):
        inside = [(order[g], a) for a, g in zip(at.tolist(), gram.tolist()) if j <= a < j + 8]
        wanted |= {min(inside)[1]} if inside else set()
    assert found == wanted


def test_rows_of_every_kind(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a", "a " * 30, "x y\x1cz " * 12, "ab cd\x0bef " * 9 + "gh"]
    texts += [" ".join(map(str, strings(rng))) for _ in range(60)]
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)] + [(BIG, "a " * 13, 1, None), (None, "a " * 13, None, "n"), (4, "a " * 30, 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, __text2 string")
    found = runs.periodic_runs(docs)
    assert found.columns == ["doc_id", "__text2", *[f.name for f in runs.RESULT]] and found.count() == len(rows)
    wanted = sorted(repr((i, x, *answer([w.decode() for w in (t or "").encode().split()]))) for i, t, _, x in rows)
    assert sorted(repr(tuple(r)[:-1]) for r in found.collect()) == wanted
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_collapsed_text_is_its_digest(spark):
    docs = spark.createDataFrame([(1, "so it goes and " * 8 + "ends")], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert row["collapsed"] == "so it goes and ends" and row["collapsed_sha256"] == hashlib.sha256(row["collapsed"].encode()).hexdigest()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert set(found) == set(docs)
    looked = 0
    for d, text in docs.items():
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(d).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n <= 1500:
            assert found[d] == answer(words), d
            looked += 1
    assert looked > 150 and sum(r[0] > 0 for r in found.values()) > 10


def test_the_same_for_any_chunks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text"))
    some = [(r["text"] or "").encode().split() for r in docs.limit(60).collect()]
    assert runs._answers(some) == [x for t in some for x in runs._answers([t])]
