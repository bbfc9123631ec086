"""Cleaning a corpus in five stages, each one operator of tallyhouse.llm on all that the last one kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import decontaminate, line_dedup, neardup, packing, toxicity
from tallyhouse.llm.tables import fold, table
from tallyhouse.session import written


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model predicts to be toxic.

    The model learns from the labelled documents among `docs`.
    """
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(docs, labels, by="doc_id")
    # numbered names: a column may be called score or predicted itself
    text = f"c{docs.columns.index('text')}"
    return toxicity.score_toxicity(_numbered(docs), model, text).where("predicted = 0").drop("score", "predicted").toDF(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines found in ten documents or more; n_chars follows the text.

    A document all of whose lines go stays with an empty text.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: F.col(n) for c, n in zip(docs.columns, names)}
    source = _numbered(docs)
    text = names[docs.columns.index("text")]
    kept = line_dedup.dedup_lines(source.withColumn("no_text", F.col(text).isNull()), text=text)
    new = {
        "text": F.when(~F.col("no_text"), at["text"]),
        "n_chars": F.when(F.col("n_dropped") > 0, F.length(text).cast("long")).otherwise(at["n_chars"]),
    }
    return kept.select(*(new.get(c, at[c]).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id."""
    node = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    classes = neardup.join_texts(docs.select("doc_id", "text"), by="doc_id").where("keeper")
    named = classes.select(F.col("doc_id").alias("_keeper_id"), F.col("node").alias("_keeper_node"), F.col("twins").alias("_keeper_twins"))
    named = written(named.distinct(), "keepers")
    kept = docs.join(named, docs["doc_id"].eqNullSafe(named["_keeper_id"]) & (node == named["_keeper_node"]))
    once = kept.where("_keeper_twins = 1")
    # rows with the same id and text
    row = F.struct(*(docs[c] for c in docs.columns))
    again = kept.where("_keeper_twins > 1").groupBy("_keeper_node").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.select(*docs.columns).unionByName(again.select("row.*"))


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), by="doc_id", item="item_id")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), by=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmarks),
    ("packing", pack),
]

#: Learned weights, hashed joins and token ids are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
