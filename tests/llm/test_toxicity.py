import random
import zlib

import numpy as np

from tallyhouse.llm import toxicity
from tallyhouse.llm.queries import QUERIES


def corpus(spark, n=1500):
    rng = random.Random(6)
    words = ["".join(rng.choices("aeioubdfgklmnprst", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(3, 80))
        toxic = i % 8 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["Vilexo", "grumbax", "vilexos!", "vilexat"]))
        rows.append((i, " ".join(text), "x", 9.0))
        labels.append((i, int(toxic)))
    return rows, labels, words


def test_separates_what_the_labels_mark(spark):
    rows, labels, words = corpus(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), by="doc_id")
    assert 0 < len(model.hashes) < 5000  # of some 100,000 features
    # also an inflection never seen, and a very long text
    fresh = [(1, "a vilexumo b", 1), (2, " ".join(words * 30), 0), (3, " ".join(words * 30) + " grumbax", 1), (4, "", 0), (5, None, 0), (5, None, 0)]
    found = toxicity.score_toxicity(spark.createDataFrame(fresh, "doc_id long, text string, lang int"), model)
    assert found.columns == ["doc_id", "text", "lang", "score", "predicted"]
    for r in found.collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == r["lang"] == int(r["score"] >= 0.5), r


def test_repeatable_in_any_partitioning(spark):
    rows, labels, _ = corpus(spark, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    one, two = (toxicity.fit(d, marks, by="doc_id") for d in (docs, docs.repartition(7)))
    assert (one.hashes == two.hashes).all() and np.allclose(one.weights, two.weights, atol=0) and one.bias == two.bias


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, "b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        model = toxicity.fit(docs, marks, by="doc_id")
        assert toxicity.score_toxicity(docs, model).count() == 4
        assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert len(toxicity.fit(docs.limit(0), labels, by="doc_id").hashes) == 0


def test_one_step_of_the_learner():
    learner = toxicity.Ftrl(2, 0.5, 0)
    learner.learn(np.array([0]), 1.0)
    # p = 0.5, g = -0.5: z = -0.5 is not beyond L1 = 1, so the weight stays zero
    assert learner.z[0] == -0.5 and learner.n[0] == 0.25 and learner.weights(np.array([0, 1])).tolist() == [0, 0]
    for _ in range(4):
        learner.learn(np.array([0]), 1.0)
        learner.learn(np.array([1]), 0.0)
    assert learner.weights(np.array([0]))[0] > 0 and learner.weights(np.array([1]))[0] == 0


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op2_toxicity"](spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    positive = [p for p, t in held if t]
    assert sum(positive) >= 0.8 * len(positive)
    assert sum(p for p, t in held if not t) <= 0.01 * len(held)
