import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tallyhouse.llm import toxicity

SF = "/root/testdata/sf0.01"
BLANK = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"\w+", text.lower())


def brute_lines(docs):
    seen = Counter()
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x).strip(BLANK)
    for text in docs.values():
        seen.update({key(x) for x in text.split("\n")} - {""})
    return {d: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for d, t in docs.items()}


def brute_keepers(docs):
    sets, root = {}, {d: d for d in docs}
    for d, t in docs.items():
        w = words(t)
        n = min(5, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holder, texts = {}, {}
    for d in docs:
        texts.setdefault(docs[d], []).append(d)
        for s in sets[d]:
            holder.setdefault(s, []).append(d)
    pairs = [(a[0], b) for a in texts.values() for b in a[1:]]
    for a in docs:
        common = Counter(b for s in sets[a] for b in holder[s])
        pairs += [(a, b) for b, n in common.items() if b != a and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {d for d in docs if find(d) == d}


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in P.STAGES:
        made = stage(spark, out[-1], SF)
        out.append(P.written(made, f"test-{name}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_all_but_the_last_keep_the_columns(stages):
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.dtypes == before.dtypes and 0 < after.count() <= before.count()


def test_each_stage_on_its_input(spark, stages):
    docs, kind, lined, single, clean, packed = stages
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0), by="doc_id")
    toxic = {r["doc_id"] for r in toxicity.score_toxicity(docs, model).where("predicted = 1").collect()}
    assert set(texts(kind)) == set(texts(docs)) - toxic

    assert texts(lined) == brute_lines(texts(kind))
    assert lined.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count() == 0

    assert set(texts(single)) == brute_keepers(texts(lined))

    items = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, t in texts(single).items() if any(f" {i} " in f" {' '.join(words(t))} " for i in items)}
    gone = set(texts(single)) - set(texts(clean))
    assert leaked <= gone and len(gone) <= len(leaked) + 5

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(texts(clean))
    for d, t in texts(clean).items():
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)


ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words\nof a text", "en", None, 20)] + [
    (10 + i, "a shared line of words\n" + f"own{i} " * 9, "en", "s", 1) for i in range(12)
]


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(*r, 0.5, 7, "x") for r in ODD],
        "doc_id long, text string, lang string, source string, n_chars long, score double, n_dropped int, twins string",
    )
    out = docs
    for name, stage in P.STAGES[:-1]:
        out = P.written(stage(spark, out, SF), f"odd-{name}")
        assert out.columns == docs.columns
    # of the empty and null texts one stays, and every other document
    assert out.count() == 14
    assert P.STAGES[-1][1](spark, out, SF).count() >= 14


def test_empty_documents(spark):
    out = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        out = P.written(stage(spark, out, SF), f"empty-{name}")
        assert out.count() == 0
