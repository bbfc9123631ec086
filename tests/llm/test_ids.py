"""Ids, decimals and times beside nulls come out of every operator as they went in."""

import datetime
import decimal

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import html_text, langid, line_dedup, packing, quality, runs, toxicity
from tallyhouse.llm.tables import unused

IDS = [2**53 + 1, None, -(2**62) - 3, 2**63 - 1, 7]
TIME, DECIMAL = datetime.datetime(2024, 2, 29, 1, 2, 3, 456789), decimal.Decimal("12345678901234567.89")
SCHEMA = "doc_id long, text string, d decimal(19,2), t timestamp, `a.b` array<long>, lang string, _key string, _row int, `__text` int, score double"


@pytest.fixture
def docs(spark):
    rows = [
        (i, f"some words of text number {k}\nshared line", DECIMAL if k % 2 else None, None if k % 2 else TIME, [2**53 + 1, None], "en", "k", None, 3, None)
        for k, i in enumerate(IDS)
    ]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def same(before, after, columns):
    pick = [F.col(f"`{c}`") for c in columns]
    assert sorted(map(repr, before.select(*pick).collect())) == sorted(map(repr, after.select(*pick).collect()))


def test_whole_rows(docs):
    model = toxicity.Model(*(toxicity.np.zeros(0),) * 2, -1.0)
    others = [c for c in docs.columns if c not in ("text", "score")]
    same(docs, toxicity.score_toxicity(docs, model), [*others, "text"])
    for size in (line_dedup.BROADCAST_BYTES, 0):
        found = line_dedup.dedup_lines(docs, min_docs=3, broadcast_bytes=size)
        same(docs, found, [*others, "score"])
        assert found.columns == [*docs.columns, "n_lines", "n_dropped"] and found.where("n_dropped = 1 AND text NOT LIKE '%shared%'").count() == 5
    same(docs, runs.periodic_runs(docs), [c for c in docs.columns if c != "text"])


def test_kept_columns(docs, spark):
    keep = ["doc_id", "d", "t"]
    same(docs, html_text.extract(docs, keep, html="text"), keep)
    same(docs, quality.measured(docs, keep), keep)
    same(docs, langid.identify(docs.withColumn("teaches", F.lit(True)), "teaches", keep), keep)


def test_packing_loses_no_document(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    for by in (["doc_id"], ["doc_id", "d", "t"]):
        found = packing.pack(docs.unionByName(docs.withColumn("text", F.repeat("text", 900))), path, by=by)
        assert {r[0] for r in found.select("doc_id").collect()} == set(IDS)
        total = found.groupBy(*by, "doc_tokens").agg(F.sum("length").alias("n"))
        assert total.count() == 10 and total.where("n <> doc_tokens").count() == 0


def test_a_label_given_twice_counts_once(spark):
    rows = [(i, "plain words " + " ".join(f"w{i}x{k}" for k in range(30)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    cuts = [quality.judge(docs, x, ["doc_id"], ["lang"]).orderBy("doc_id").collect() for x in (labels, labels.unionByName(labels).unionByName(labels))]
    assert cuts[0] == cuts[1]


def test_unused_names():
    assert unused("a", ["b"]) == "a" and unused("a", ["A", "_a"]) == "__a"
