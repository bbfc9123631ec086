import random
import re

from tallyhouse.llm import decontaminate as D
from tallyhouse.llm.queries import QUERIES


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def best_stretch(same):
    """The best stretch by trying all: (score, equal)."""
    best = (0, 0)
    for lo in range(len(same)):
        score = equal = 0
        for x in same[lo:]:
            score += 1 if x else -D.MISMATCH
            equal += x
            best = max(best, (score, equal))
    return best


def brute(docs, items):
    """{(doc, item): (equal words, share)} over all diagonals on which a mask hits."""
    out = {}
    for d, t in docs:
        ours = tokens(t)
        for i, b in items:
            theirs = tokens(b)
            for shift in range(-len(theirs), len(ours)):
                at = [(k + shift, k) for k in range(len(theirs)) if 0 <= k + shift < len(ours)]
                same = [ours[a] == theirs[k] for a, k in at]
                hit = any(
                    all(same[w + p] for p in mask) for mask in D.MASKS for w in range(len(same) - D.SPAN + 1)
                )
                if not hit:
                    continue
                score, equal = best_stretch(same)
                if equal >= D.LEAST_WORDS and (equal >= D.SHARE * len(theirs) or equal >= D.LONG):
                    out[d, i] = max(out.get((d, i), (0, 0)), (equal / len(theirs), score))
    return {k: round(v[0], 9) for k, v in out.items()}


def found(df):
    rows = df.collect()
    got = {(r["doc_id"], r["item_id"]): round(r["share"], 9) for r in rows}
    assert len(got) == len(rows)
    return got


def passages(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=3)) for _ in range(150)] + ["the", "and", "é"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([15, 20, 40])))) for i in range(6)]
    docs = []
    for n in range(40):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if n % 2:
            part = tokens(rng.choice(items)[1])
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            part = part[rng.choice([0, 0, 5]) :]
            at = rng.randint(0, len(words))
            words = words[:at] + part + words[at:]
        docs.append((n, ", ".join(words).upper()))
    return docs, items


def test_agrees_with_brute_force(spark, monkeypatch):
    for seed, limit in ((1, D.BROADCAST_BYTES), (2, -1)):
        monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
        docs, items = passages(seed)
        docs += [(100, None), (101, ""), (102, "one two"), (103, items[0][1] * 50), (104, "the " * 5000)]
        a = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, item int, seed string")
        b = spark.createDataFrame([(*i, 5) for i in items] + [(50, None, 5), (51, "a b", 5)], "item_id long, text string, id int")
        assert found(D.overlaps(a, b, "doc_id", "item_id")) == brute(docs, items)


def test_places_are_those_of_the_equal_words(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    doc = "start here Alpha beta GAMMA xx epsilon zeta eta theta iota yy lambda mu end"
    rows = D.overlaps(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"), "doc_id", "item_id").collect()
    assert [(r["doc_start"], r["item_start"], r["n_span"], r["n_equal"]) for r in rows] == [(2, 0, 12, 10)]


def test_short_items_are_found_as_a_whole(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(6)]
    items = [(n, " ".join(rng.choices(words, k=n % 7 + 1))) for n in range(30)] + [(40, "! ?"), (41, None), (3, "W1, w2"), (None, "w5 w5")]
    docs = [(n, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for n in range(60)] + [(70, None), (71, "w1 w2"), (71, "w1 w2"), (72, "w0")]
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, window int")
    b = spark.createDataFrame(items, "item_id long, text string")
    wanted = {}
    for d, t in docs:
        for i, x in items:
            ours, theirs = tokens(t), tokens(x)
            places = [k for k in range(len(ours) - len(theirs) + 1) if theirs and ours[k : k + len(theirs)] == theirs]
            if places:
                wanted[d, i] = max(wanted.get((d, i), (0, 0)), (len(theirs), -places[0]))
    for limit in (D.BROADCAST_BYTES, -1):
        monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
        rows = D.overlaps(a, b, "doc_id", "item_id").collect()
        assert {(r["doc_id"], r["item_id"]): (r["n_equal"], -r["doc_start"]) for r in rows} == wanted and len(rows) == len(wanted)
        assert all(r["share"] == 1 and r["item_start"] == 0 and r["n_span"] == r["n_equal"] for r in rows)


def test_short_and_long_items_together(spark):
    docs, items = passages(4)
    short = [(90, " ".join(tokens(docs[3][1])[4:11])), (91, " ".join(tokens(items[0][1])[:3]))]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    got = found(D.overlaps(a, spark.createDataFrame(items + short, "item_id long, text string"), "doc_id", "item_id"))
    whole = {(d, i): 1.0 for d, t in docs for i, x in short if f" {' '.join(tokens(x))} " in f" {' '.join(tokens(t))} "}
    assert (3, 90) in whole and got == {**brute(docs, items), **whole}


def test_clean_keeps_the_rest_as_it_is(spark):
    docs, items = passages(3)
    docs += [(None, items[0][1]), (None, "nothing"), (1, docs[0][1]), (1, docs[0][1])]
    a = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, extra string")
    b = spark.createDataFrame(items, "item_id long, text string")
    numbered = [(n, t) for n, (_, t) in enumerate(docs)]
    bad = {d for d, _ in brute(numbered, items)}
    kept = D.clean(a, b, "doc_id", "item_id")
    assert kept.columns == a.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for n, r in enumerate(a.collect()) if n not in bad)
    assert D.clean(a.limit(0), b, "doc_id", "item_id").count() == 0
    assert D.clean(a, b.limit(0), "doc_id", "item_id").count() == len(docs)


def test_query_finds_the_planted_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {(d, i) for d, t in docs for i, b in items if f" {' '.join(tokens(b))} " in f" {' '.join(tokens(t))} "}
    got = found(QUERIES["op1_decontamination"](spark, sf))
    assert whole and whole <= set(got) and len(got) <= len(whole) + 5
