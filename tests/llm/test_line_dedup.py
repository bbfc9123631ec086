import hashlib
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(texts, least):
    split = [(t or "").split("\n") for t in texts]
    seen = Counter()
    for lines in split:
        seen.update({lower(x).strip(BLANK) for x in lines} - {""})
    out = []
    for lines in split:
        kept = [x for x in lines if seen[lower(x).strip(BLANK)] < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def rows(df):
    return sorted((r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect())


TEXTS = (
    [f"Shared line \nown {i}\n\n\tSHARED LINE" for i in range(12)]
    + [f"own {i}\nÀ Shared" for i in range(5)]
    + [None, "", "\n", "shared line", "x\n" * 3000 + "shared line", " \r\n"]
    + ["twice in one\ntwice in one"]
)


@pytest.mark.parametrize("least", [1, 2, 10, 14])
@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, -1])
def test_agrees_with_brute_force(spark, monkeypatch, least, limit):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    monkeypatch.setattr(line_dedup, "PROBE_ROWS", 1000)
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "shared line")], "doc_id long, text string")
    found = line_dedup.dedup_lines(docs, least, broadcast_bytes=limit)
    assert rows(found) == brute([*TEXTS, "shared line"], least)


def test_keeps_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", 5, 1)], "doc_id long, text string, n_lines string, n_chars int, shard int")
    assert line_dedup.dedup_lines(docs).columns == ["doc_id", "text", "n_chars", "shard", "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_minimal_perfect_hash_finds_every_key_and_no_other():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 5000))
    prints, counts = rng.integers(-(2**63), 2**63 - 1, len(keys)), np.arange(len(keys)) + 1
    made = line_dedup.build_shard(keys.view(np.uint64), prints.view(np.uint64), counts)
    shard = line_dedup.Shard(*(made[k].tobytes() for k in ("sizes", "bits", "prints", "counts")))
    assert (shard.count(keys.view(np.uint64), prints.view(np.uint64)) == counts).all()
    assert len(made["prints"]) == len(keys)
    assert (shard.count(keys.view(np.uint64), (prints + 1).view(np.uint64)) == 0).all()
    other = np.setdiff1d(rng.integers(-(2**63), 2**63 - 1, 5000), keys)
    assert (shard.count(other.view(np.uint64), other.view(np.uint64)) == 0).all()
    assert made["bits"].nbytes * 8 < 8 * len(keys)


def test_query_hash_is_of_the_kept_text(spark):
    from tallyhouse.llm.queries import QUERIES

    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    texts = [r["text"] for r in docs.values()]
    wanted = sorted((n, d, hashlib.sha256(t.encode()).hexdigest()) for t, n, d in brute(texts, 10))
    found = QUERIES["op8_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found) == wanted
