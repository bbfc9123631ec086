import math
import random

import numpy as np

from tallyhouse.llm import quality
from tallyhouse.llm.queries import QUERIES

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in BLANK:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines, dup = [], 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            dup += line in lines
            lines.append(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(lines)


def test_measures_agree_with_brute_force():
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a\n\na\n a\na", "é\xa0# <>", "x " * 500, "a b c d e f g h " * 2]
    texts += [" ".join(rng.choices("abc", k=rng.randint(0, 60))) + "\n#|" for _ in range(60)]
    for text in texts:
        assert quality.measure(text) == brute(text), text


def test_binomial_tail_is_exact():
    for n, p in ((12, 0.3), (40, 0.02)):
        for k in range(n + 1):
            wanted = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(quality.binomial_tail(k, n, p) - wanted) < 1e-12


def test_cutoff_is_the_lowest_safe_level_of_the_sequence():
    good = np.zeros(quality.LEVELS, np.int64)
    good[0], good[40], good[50] = 5000, 300, 1
    cutoff = quality.lowest_cutoff(good, 0.01, 0.01)
    assert cutoff == 41
    assert quality.lowest_cutoff(good // 100, 0.01, 0.01) == quality.LEVELS


def test_cutoffs_hold_on_fresh_documents(spark):
    # of good documents 1 in 50 has many symbols; rejecting them all would break the limit
    rng = random.Random(9)

    def text(symbols):
        return " ".join(rng.choice("abcdefgh") * rng.randint(3, 7) + ("#" * 2 if i < symbols else "") for i in range(60))

    docs = [(i, text(60 if i % 50 == 0 else 0), "en") for i in range(4000)] + [(9000 + i, text(60), "xx") for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 4000)] + [(9001, 1), (9002, None)], "doc_id long, quality int")
    found = quality.judge(frame, labels, by=["doc_id"], strata=["lang"])
    lost = found.where("lang = 'en' AND NOT kept AND NOT base_failed").count()
    assert lost <= 4000 * quality.MAX_FALSE_REJECTION
    assert found.where("lang = 'xx' AND NOT kept AND NOT base_failed").count() == 0


def test_rules_reject_what_good_documents_never_show(spark):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(3, 7) for _ in range(60))) for i in range(4000)]
    junk = [(5000 + i, " ".join(rng.choice("abcdefgh") * 4 + "###" for _ in range(60))) for i in range(50)]
    frame = spark.createDataFrame([(i, t, None) for i, t in good + junk], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.judge(frame, labels, by=["doc_id"], strata=["lang"]).collect()}
    assert sum(found[i]["kept"] for i, _ in junk) == 0
    assert sum(found[i]["kept"] for i, _ in good) >= 3960


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, None, 7), (1, None, None, 7), (None, "a b", "en", 8), (2, "w " * 5000, "en", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    found = quality.judge(docs, labels, by=["doc_id"], strata=["lang"])
    assert sorted((r["n_words"], r["base_failed"], r["kept"]) for r in found.collect()) == [
        (0, True, False), (0, True, False), (2, True, False), (5000, True, False)
    ]
    assert quality.judge(docs.limit(0), labels, by=["doc_id"], strata=["lang"]).count() == 0


def test_query_on_a_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op6_quality"](spark, "/root/testdata/sf0.001").collect():
        n = brute(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n[:5]
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["base_failed"] and r["kept"])
