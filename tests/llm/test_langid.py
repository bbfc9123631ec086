import math
import random
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import langid
from tallyhouse.llm.queries import QUERIES


def symbols(text):
    out, boundary = [], False
    for c in text.lower():
        if c.isalpha():
            out.append(ord(c) - 96 if "a" <= c <= "z" else 27 + (ord(c) * 2654435761 >> 7) % 37)
            boundary = True
        elif boundary:
            out.append(0)
            boundary = False
    return out


def brute_grams(text, order=4):
    s = [0] * (order - 1) + symbols(text)
    return [tuple(s[i : i + order]) for i in range(len(s) - order + 1)]


def packed(gram):
    return sum(x << 6 * (len(gram) - 1 - i) for i, x in enumerate(gram))


def test_grams_agree_with_brute_force():
    texts = ["", "abc", " Ab, c!é ñ中", "1234", "x" * 50, "İi ǅ", "a\x00b\n\nc "]
    found, doc, letters = langid.grams(texts)
    for i, t in enumerate(texts):
        assert found[doc == i].tolist() == [packed(g) for g in brute_grams(t)]
        assert letters[i] == sum(c.isalpha() for c in t.lower())


def brute_model(counts, order):
    """P(last | rest) by the textbook recursion."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def chance(gram):
        if not gram:
            return 1 / 64
        c = levels[len(gram)]
        once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        if not same:
            return chance(gram[1:])
        return max(c.get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * chance(gram[1:])

    return chance


def test_model_is_interpolated_kneser_ney():
    text = "the cat and the hat and that other one, then another"
    counts = Counter(brute_grams(text))
    found = np.array(sorted(packed(g) for g in counts), np.int64)
    n = np.array([counts[tuple(int(x) >> 6 * k & 63 for k in (3, 2, 1, 0))] for x in found])
    model = langid.Model(found, n, 4)
    chance = brute_model(counts, 4)
    for gram in [*counts, (1, 2, 3, 4), (0, 0, 20, 9), (20, 8, 5, 63), (20, 8, 1, 20)]:
        assert math.isclose(math.exp(model.log_chance(np.array([packed(gram)], np.uint32))[0]), chance(gram), rel_tol=1e-5)
    every = np.arange(64, dtype=np.uint32)
    for context in (0, packed((20, 8, 5)), packed((9, 9, 9))):
        assert math.isclose(np.exp(model.log_chance(every + np.uint32(context << 6))).sum(), 1, rel_tol=1e-4)


@pytest.fixture
def corpus(spark):
    rng = random.Random(3)
    words = {"xx": ["bada", "dabo", "bodi"], "yy": ["mipé", "tepi", "émit"]}
    rows = [(i, " ".join(rng.choices(words[k], k=30)), k) for i in range(60) for k in words]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "12 !", "xx"), (903, "bada dabo", None), (904, "mipé " * 9000, "yy")]
    return spark.createDataFrame([(*r, 5.0, True) for r in rows], "doc_id long, text string, lang string, score double, teaches boolean")


def test_texts_get_their_language(corpus):
    found = {(r["doc_id"], r["lang"]): r for r in langid.identify(corpus, "teaches", ["doc_id", "lang"]).collect()}
    assert len(found) == 125
    for (i, lang), r in found.items():
        assert 0 <= r["score"] <= 1
        assert r["lang_pred"] == {900: "und", 901: "und", 902: "und", 903: "xx"}.get(i, lang)
        if i in (900, 901, 902):
            assert r["rejected"] and r["score"] == 0


def test_results_do_not_depend_on_neighbours(spark, corpus, monkeypatch):
    whole = sorted((r["doc_id"], r["lang_pred"], r["entropy"] or 0) for r in langid.identify(corpus, "teaches", ["doc_id"]).collect())
    monkeypatch.setattr(langid, "SLICE", 50)
    again = langid.identify(corpus.repartition(7), "teaches", ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["lang_pred"], r["entropy"] or 0) for r in again) == whole


def test_rare_grams_are_left_to_shorter_ones(corpus, monkeypatch):
    names, models, _ = langid.fit(corpus)
    every = [len(m.gram) for m in models]
    monkeypatch.setattr(langid, "LEAST_SHARE", 0.02)
    names, models, _ = langid.fit(corpus)
    assert names == ["xx", "yy"] and all(0 < len(m.gram) <= 50 and len(m.gram) < n for m, n in zip(models, every))
    found = langid.identify(corpus, "teaches", ["doc_id", "lang"]).where("doc_id < 900 AND lang_pred <> lang")
    assert found.count() == 0


def test_a_larger_corpus_gives_the_same_answers(corpus):
    """Every text five times over: shares, models' predictions and limits are of the same texts."""
    docs = corpus
    for _ in range(4):
        docs = docs.unionByName(corpus)
    one = {(r["doc_id"], r["lang"]): r["lang_pred"] for r in langid.identify(corpus, "teaches", ["doc_id", "lang"]).collect()}
    many = {(r["doc_id"], r["lang"], r["lang_pred"]) for r in langid.identify(docs, "teaches", ["doc_id", "lang"]).collect()}
    assert many == {(*k, v) for k, v in one.items()}


def test_limits_come_from_texts_the_models_have_not_seen(spark, monkeypatch):
    rng = random.Random(5)
    letters = {"xx": "abcdefgh", "yy": "ijklmnop"}
    text = lambda k, n: " ".join("".join(rng.choices(letters[k], k=rng.randint(2, 8))) for _ in range(n))
    rows = [(i, text(k, rng.choice([3, 40])), k, True) for i in range(600) for k in letters]
    fresh = [(1000 + i, text(k, rng.choice([3, 40])), k, False) for i in range(300) for k in letters]
    strange = [(2000 + i, " ".join("".join(rng.choices("qrstuvwxyz", k=5)) for _ in range(40)), None, False) for i in range(20)]
    docs = spark.createDataFrame(rows + fresh + strange, "doc_id long, text string, lang string, teaches boolean")
    out = langid.identify(docs, "teaches", ["doc_id"]).collect()
    assert sum(r["rejected"] for r in out if 1000 <= r["doc_id"] < 2000) <= 0.04 * len(fresh)
    assert all(r["rejected"] for r in out if r["doc_id"] >= 2000)
    kept_out = docs.where("teaches").where(langid._calibrates("text")).count()
    assert 0.05 * len(rows) < kept_out < 0.15 * len(rows)
    # the calibrating models hold no n-gram that only texts kept out have
    _, whole, blind = langid.fit(docs.where("teaches"))
    assert all(set(b.gram.tolist()) < set(w.gram.tolist()) for w, b in zip(whole, blind))


def test_nothing_to_learn_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", None, True), (1, "abc", "x", False)], "doc_id long, text string, lang string, teaches boolean")
    assert [(r["lang_pred"], r["rejected"]) for r in langid.identify(docs, "teaches", ["doc_id"]).collect()] == [("und", True)] * 2
    assert langid.identify(docs.limit(0), "teaches", ["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in QUERIES["op9_language"](spark, sf).collect()]
    assert len(found) == len(lang)
    held = [r for r in found if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_languages_beyond_one_pass_change_no_answer(spark, corpus, monkeypatch):
    """As many passes as languages, and more languages than were once refused."""
    columns = ["doc_id", "lang", "lang_pred", "score", "entropy", "rejected"]
    whole = sorted(map(str, langid.identify(corpus, "teaches", ["doc_id", "lang"]).select(columns).collect()))
    monkeypatch.setattr(langid, "AT_ONCE", 1)
    assert sorted(map(str, langid.identify(corpus, "teaches", ["doc_id", "lang"]).select(columns).collect())) == whole
    monkeypatch.undo()
    monkeypatch.setattr(langid, "AT_ONCE", 300_000_000)
    words = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 40, f"l{i:03d}", True) for i in range(260)]
    docs = spark.createDataFrame(words, "doc_id long, text string, lang string, teaches boolean")
    assert len([name for part in langid.Models(docs).parts for name in part]) == 260


def test_no_gram_is_left_out(spark):
    text = "".join(chr(97 + i % 26) for i in range(1_200_000)) + "zazbzczd"
    docs = spark.createDataFrame([(text, "xx")], "text string, lang string")
    _, (model,), _ = langid.fit(docs)
    assert set(langid.grams([text])[0].tolist()) == set(model.gram.tolist())
