import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import spelling
from tallyhouse.llm.queries import QUERIES


def near(word, vocabulary, letters):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
    return [x for x in out - {word} if x in vocabulary]


def brute(vocabulary):
    letters, form, rows = {c for w in vocabulary for c in w}, {}, {}
    around = {w: near(w, vocabulary, letters) for w in vocabulary}
    for w, n in vocabulary.items():
        best = min(around[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 2 * n else None
    for w, n in vocabulary.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (n, form[w], root, len(around[w]), vocabulary[form[w]] if form[w] else None)
    return rows


def answered(frame):
    return {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in frame.collect()}


def made_up(seed, size):
    """Words and variants of them, some of them chains of several steps."""
    rng = random.Random(seed)
    words = {"".join(rng.choices("abcdeé", k=rng.randint(5, 9))): rng.randint(3, 400) for _ in range(size)}
    for w in list(words):
        n = words[w]
        while n > 6 and rng.random() < 0.8:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abxÿ") + w[i:], w[:i] + rng.choice("xyzÀ") + w[i + 1 :]])
            n = n // rng.choice([2, 2, 3])
            if len(w) >= 5:
                words.setdefault(w, n)
    return words


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 1024])
def test_all_near_words_and_chains(spark, filter_bytes):
    words = made_up(4, 500)
    words |= {"hello" + "o" * 2000: 9, "hello" + "o" * 1999: 3, "aaaaa": 40, "aaaaaa": 20, "aaaaaaa": 10, "aaaaaaaa": 5}
    frame = spark.createDataFrame([(w, n, 1.5) for w, n in words.items()], "word string, n long, form double")
    assert answered(spelling.group_variants(frame, filter_bytes=filter_bytes)) == brute(words)


def test_a_chain_of_many_steps(spark):
    # each word half as frequent as the next one
    words = {"abcdefgh"[: 8 - k] + "z" * k if k < 8 else "z" * (k + 1): 3 * 2**k for k in range(9)}
    found = answered(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert found == brute(words) and len({r[2] for r in found.values()}) < len(words)


def test_edits_meet_every_pair_once():
    rng = random.Random(1)
    alphabet = np.frombuffer(b"abc", np.uint8)
    for _ in range(200):
        word = "".join(rng.choices("abc", k=rng.randint(1, 7)))
        codes = np.frombuffer(word.encode(), np.uint8)[None, :]
        found = Counter()
        for _, hashes, length in spelling.edits(codes, alphabet):
            found.update((h, length) for h in hashes.tolist())
        wanted = {word[:i] + word[i + 1 :] for i in range(len(word))} - {""}
        wanted |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abc" if c < word[i]}
        by = lambda w: (int(spelling.word_hashes(np.frombuffer(w.encode(), np.uint8)[None, :])[0]), len(w))
        assert found == Counter(by(w) for w in wanted)


def test_long_words_are_hashed_in_pieces(monkeypatch):
    codes = np.random.default_rng(0).integers(97, 123, (3, 50), np.uint8)
    alphabet = np.arange(97, 123, dtype=np.uint8)
    whole = sorted((r, h, n) for row, found, n in spelling.edits(codes, alphabet) for r, h in zip(row.tolist(), found.tolist()))
    monkeypatch.setattr(spelling, "EDITS", 100)
    assert whole == sorted((r, h, n) for row, found, n in spelling.edits(codes, alphabet) for r, h in zip(row.tolist(), found.tolist()))


def test_nothing_and_little(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.group_variants(none).count() == 0
    assert answered(spelling.group_variants(spark.createDataFrame([("alone", 5)], "word string, n long"))) == {"alone": (5, None, "alone", 0, None)}
    # equal counts: near, but no form
    two = spark.createDataFrame([("color", 5), ("colour", 5)], "word string, n long")
    assert answered(spelling.group_variants(two)) == {"color": (5, None, "color", 1, None), "colour": (5, None, "colour", 1, None)}


def test_query_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(2**53 + 1, "Naïve naïve NAÏVE naÏve naÏves naÏves naÏves"), (None, "wordy wordy wordy wordyy wordyy wordyy"), (5, None), (6, ""), (7, "12 _ ×÷×÷×÷×")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert answered(QUERIES["op13_spelling_variants"](spark, str(tmp_path))) == brute(words) and len(words) > 2500
