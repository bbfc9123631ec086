"""Toxicity by logistic regression over hashed word n-grams, learned by FTRL-proximal.

Features of a text are its distinct words, their stems, pairs of neighbours and pairs
with one word between, hashed to 2^24 coordinates.  FTRL-proximal gives each coordinate a rate of
its own and keeps most weights at exactly zero, so that the model is two short sorted
arrays, which are broadcast.
"""

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.tables import answered, lean
from tallyhouse.session import written

#: Labelled rows learned from at most, the first by the hash of their id.
SAMPLE_ROWS = 10_000
#: Rows of the sample that a feature must be in.
LEAST_ROWS = 3
#: Bits of a feature's hash: there are so many coordinates, whatever the sample holds.
COORDINATE_BITS = 24
EPOCHS = 6
ALPHA, BETA, L2 = 0.5, 1.0, 0.1
#: L1 grows with the rows learned from, between these, so that a few rows can still move a weight.
L1_LEAST, L1_MOST, L1_ROWS = 1.0, 5.0, 2000
STEMS = (4, 5)
#: Words remembered by a worker.
REMEMBERED = 100_000
_WORDS = re.compile(r"[^\W\d_]+")
_SIEVE = 1 << 20


class _Hashes(dict):
    """Hashes of a word and of its stems, each a kind of its own; a short word has its own hash as stem."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = word.encode()
        self[word] = value = (zlib.crc32(raw), *(zlib.crc32(word[:n].encode(), n) if len(word) > n else zlib.crc32(raw) for n in STEMS))
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - COORDINATE_BITS)).astype(np.uint32)


def features(text: str | None, known: dict) -> np.ndarray:
    """Hashes of all features of a whole text, with repeats."""
    words = _WORDS.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint32)
    one = np.array(list(map(known.__getitem__, words)), np.uint64)
    word = one[:, 0]
    # a kind is in the high bits, so that kinds do not meet before mixing
    parts = [one[:, k] + np.uint64((k + 1) << 34) for k in range(one.shape[1])]
    for gap, kind in ((1, 11), (2, 12)):
        if len(word) > gap:
            parts.append(word[:-gap] * np.uint64(0x100000001B3) + (word[gap:] << np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(kind << 34))
    return _mixed(np.concatenate(parts))


class Model:
    """Sorted feature hashes with their weights, and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order].astype(np.uint32), weights[order].astype(np.float64), float(bias)

    def sieve(self) -> np.ndarray:
        out = np.zeros(_SIEVE, bool)
        out[self.hashes & np.uint32(_SIEVE - 1)] = True
        return out

    def score(self, found: np.ndarray, sieve: np.ndarray) -> float:
        total = self.bias
        found = found[sieve[found & np.uint32(_SIEVE - 1)]]
        if len(found):
            found = np.unique(found)
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            total += float(self.weights[at][self.hashes[at] == found].sum())
        return float(1 / (1 + np.exp(-min(max(total, -500.0), 500.0))))


class Ftrl:
    """FTRL-proximal over dense coordinates; the last one is the bias and is not regularized.

    Weights are kept from being negative: a feature can only be evidence of toxicity, so
    that no amount of harmless text outweighs it.
    """

    def __init__(self, size: int, rate: float, rows: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.l1 = np.full(size + 1, min(max(rows / L1_ROWS, L1_LEAST), L1_MOST))
        self.l1[-1] = 0.0
        # the bias starts at the log-odds of the share of positive rows
        start = np.log(rate / (1 - rate))
        self.z[-1] = -start * (BETA / ALPHA + L2)

    def weights(self, at) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        free = (-l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(l1 > 0, np.maximum(free, 0.0), free)

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, len(self.z) - 1)
        w, n = self.weights(at), self.n[at]
        p = 1 / (1 + np.exp(-min(max(float(w.sum()), -35.0), 35.0)))
        g = p - label
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, by: str, text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """A model of at most a weight for each coordinate from at most `rows` labelled rows.

    `labels` has `by` and toxic; null labels teach nothing, repeated ones count again.
    The rows of the sample are seen in the order of a hash, once per epoch, by one task
    that holds two numbers for each coordinate in use; their features are made by many.
    """
    chosen = labels.where("toxic IS NOT NULL").select(F.col(by).alias("_id"), F.col("toxic").cast("double").alias("label"))
    chosen = chosen.withColumn("_order", F.xxhash64("_id", F.lit("order"))).orderBy("_order", "_id", "label").limit(rows)
    texts = docs.select(F.col(by).alias("_id"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), "_id").select("_order", "label", "text")

    def extract(batches):
        known = _Hashes()
        for frame in batches:
            frame["found"] = [np.unique(features(t, known)).tobytes() for t in frame.pop("text")]
            yield frame

    made = written(sample.mapInPandas(lean(extract), "_order long, label double, found binary"), "toxic-features")

    def tally(batches):
        for frame in batches:
            if len(frame):
                hashes, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in frame["found"]]), return_counts=True)
                yield pd.DataFrame({"hash": hashes.astype(np.int64), "n": n})

    counts = made.select("found").mapInPandas(lean(tally), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    common = counts.where(F.col("n") >= LEAST_ROWS).select("hash")

    def packed(batches):
        for frame in batches:
            yield pd.DataFrame({"hashes": [frame["hash"].to_numpy().astype(np.uint32).tobytes()]})

    # the driver gets four bytes for each coordinate in use
    vocabulary = np.sort(np.frombuffer(b"".join(r["hashes"] for r in common.mapInPandas(lean(packed), "hashes binary").collect()), np.uint32))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    n_rows, positive = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    rate = min(max((positive + 0.5) / (n_rows + 1), 1e-6), 1 - 1e-6)

    def index(batches):
        vocabulary = shared.value
        for frame in batches:
            out = []
            for x in frame.pop("found"):
                found = np.frombuffer(x, np.uint32)
                at = np.minimum(np.searchsorted(vocabulary, found), max(len(vocabulary) - 1, 0))
                out.append(at[vocabulary[at] == found].astype(np.int32).tobytes() if len(vocabulary) else b"")
            frame["at"] = out
            yield frame

    def train(batches):
        vocabulary = shared.value
        learner = Ftrl(len(vocabulary), rate, n_rows)
        for frame in batches:
            for at, label in zip(frame["at"], frame["label"]):
                learner.learn(np.frombuffer(at, np.int32), label)
        weights = learner.weights(slice(None))
        some = np.flatnonzero(weights[:-1])
        yield pd.DataFrame({"hashes": [vocabulary[some].tobytes()], "weights": [weights[some].tobytes()], "bias": [float(weights[-1])]})

    seen = (
        made.mapInPandas(lean(index), "_order long, label double, at binary")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
        .withColumn("_order", F.xxhash64("_order", "epoch"))
        .repartition(1)
        .sortWithinPartitions("epoch", "_order", "label", "at")
    )
    learned = seen.mapInPandas(lean(train), "hashes binary, weights binary, bias double").first()
    if learned is None:
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0)
    return Model(np.frombuffer(learned["hashes"], np.uint32), np.frombuffer(learned["weights"], np.float64), learned["bias"])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 if score >= 0.5), which replace columns of that name.

    Whole texts are scored, and nothing but the text.  Null and empty texts get the
    score of the bias; rows that repeat get equal scores; an empty table stays empty.
    """
    docs = docs.drop("score", "predicted")
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def start():
        known, model = _Hashes(), held.value
        sieve = model.sieve()

        def work(batch):
            score = np.array([model.score(features(t.as_py(), known), sieve) for t in batch.column(at)], np.float64)
            return score, (score >= 0.5).astype(np.int32)

        return work

    return answered(docs, T.StructType().add("score", "double").add("predicted", "integer"), start)
