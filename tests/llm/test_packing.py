import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tallyhouse.llm import packing
from tallyhouse.llm.queries import QUERIES
from tallyhouse.llm.tokens import TextTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_tokenizer_agrees_with_the_library(library):
    ours = TextTokenizer(PATH)
    rng = random.Random(5)
    odd = "aZé ÉßİǅſḰΣσςΑ中Ж\x1c\x1f\x85\xa0 ​'sLL're1²Ⅷ_-<|>\n\t!?€\U0001f600҇"
    texts = ["", " ", "It's we'LL", "<|endoftext|> a<|startoftext|>b", "ΟΔΟΣ Σ", "é É", "don't\x1cstop"]
    texts += ["".join(rng.choices(odd, k=rng.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.randint(1, 0x24F)) for _ in range(60)) for _ in range(300)]
    for text in texts:
        wanted = library.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(ours.encode(text), "<u4")) == wanted, repr(text)


def test_texts_of_a_batch_are_merged_at_once(library, monkeypatch):
    from tallyhouse.llm import tokens

    ours, calls = TextTokenizer(PATH), []
    merge = ours.words.encode_to_numpy
    monkeypatch.setattr(ours.words, "encode_to_numpy", lambda *a, **b: calls.append(1) or merge(*a, **b))
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeéßñÉİØɏ×", k=rng.randint(1, 9))) + rng.choice(["", "", ",", ".", "!!", "'s", "$"]) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 200))) for _ in range(300)] + [None, "", " \n", "a\x1cb", "中 é x."]
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    batch = pa.array([None, "zz", *texts]).slice(2)
    assert [list(np.frombuffer(i, "<u4")) for i in ours.encode_all(batch)] == wanted
    assert len(calls) == 1
    monkeypatch.setattr(tokens, "AT_ONCE", 2000)
    assert [list(np.frombuffer(i, "<u4")) for i in ours.encode_all(batch)] == wanted
    assert list(ours.encode_all(batch[:0])) == []


def test_combinations_fill_the_window():
    made = packing.combinations(16, 4)
    sums = made @ np.arange(1, 17)
    assert (sums == 16).all() and made.sum(axis=1).max() == 4 and len({tuple(r) for r in made}) == len(made) == 64


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 30)), rng.random(8) * rng.integers(-1, 5, 8)
        x = packing.nnls(a, b)
        gradient = a.T @ (a @ x - b)
        assert (x >= 0).all() and gradient.min() > -1e-6 and abs(gradient @ x) < 1e-6


def test_plan_keeps_within_the_histogram():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 500, 64)
    tokens = counts * (np.arange(64) * 64 + 32)
    columns, repeats = packing.plan(counts, tokens)
    assert (columns.T @ repeats <= counts).all() and (repeats > 0).all()
    gap = (repeats * (4096 - columns @ (tokens / np.maximum(counts, 1)))).sum()
    left = tokens.sum() - (repeats @ (columns @ (tokens / np.maximum(counts, 1))))
    assert gap <= left + 4096
    assert len(packing.plan(np.zeros(64, np.int64), np.zeros(64, np.int64))[1]) == 0


def check(found, texts, library, window=4096):
    """Every id once, checksums right, sequences gapless; returns the lengths of the sequences."""
    docs, sequences = {}, {}
    for r in found:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(docs) == set(texts)
    for d, parts in docs.items():
        wanted, at = ids(library, texts[d]), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(wanted)
            piece = wanted[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
            at += r["length"]
        assert at == len(wanted)
    lengths = []
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        lengths.append(at)
    return lengths


def padding(lengths, window=4096):
    return sum(window - n for n in lengths if n & (n - 1))


def test_query_on_whole_tables(spark, library):
    for sf in ("sf0.001", "sf0.01"):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
        lengths = check(QUERIES["op7_packing"](spark, f"/root/testdata/{sf}").collect(), texts, library)
        assert padding(lengths) <= 0.002 * sum(lengths)


def test_odd_lengths_nulls_and_clashing_columns(spark, library, monkeypatch):
    from tallyhouse.llm import prefix

    monkeypatch.setattr(prefix, "BUCKET_ROWS", 3)
    rng = random.Random(8)
    texts = {i: "a " * rng.choice([0, 1, 3, 63, 64, 700, 4094, 4095, 4096, 9000]) for i in range(60)} | {100: None, 101: "", 102: "é\n" * 5}
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, start int, bin string")
    lengths = check(packing.pack(docs, PATH, by=["doc_id"]).collect(), texts, library)
    assert padding(lengths) <= 0.02 * sum(lengths)


def test_one_length_only_and_repeated_rows(spark, library):
    docs = spark.createDataFrame([(7, "a b")] * 5 + [(None, "c " * 3000)] * 4, "doc_id long, text string")
    found = packing.pack(docs, PATH, by=["doc_id"]).collect()
    assert sum(r["length"] for r in found) == 5 * 3 + 4 * 3001
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert packing.pack(docs.limit(0), PATH, by=["doc_id"]).count() == 0
