"""Quality rules whose cutoffs are chosen so that good documents are rarely rejected.

A rule compares one measure of a text with a cutoff.  For each stratum and rule the
cutoffs are tried from the most lenient on; a cutoff is accepted while an exact
binomial test on labelled good documents shows that it rejects at most a given share of
them, and the first that fails ends the search (fixed-sequence testing, which needs no
correction within a rule).  The error level is split over all strata and rules
(Bonferroni), so that all accepted cutoffs hold together.
"""

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.tables import answered
from tallyhouse.session import written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
#: Allowed share of good documents that all rules of a stratum reject together.
MAX_FALSE_REJECTION = 0.01
#: Probability that any accepted cutoff breaks its share.
ERROR_LEVEL = 0.05
#: Up to so many strata their cutoffs are broadcast.
BROADCAST_STRATA = 10_000
#: Steps of a measure; its cutoffs are whole steps.
LEVELS = 64


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = (ids ^ (ids >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    total = np.zeros(n, np.uint64)
    for k in range(window):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + n]
    _, where, counts = np.unique(total, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines with a word) of a whole text."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines")


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and the measures of each text; a null text measures as an empty one."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    answers = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

    def work(batch):
        found = [measure(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        return [[x[i] for x in found] for i in range(len(MEASURES))]

    return answered(source, answers, lambda: work, drop=1)


def rules() -> dict[str, Column]:
    """Each rule as a level from 0 to LEVELS - 1; higher is worse."""

    def share(part: str, whole: str, full: float) -> Column:
        """Full scale at part / whole = full."""
        return F.when(F.col(whole) > 0, F.col(part) * F.lit(LEVELS / full) / F.col(whole)).otherwise(F.lit(0.0))

    mean = F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(F.lit(5.0))
    levels = {
        "symbols": share("n_symbols", "n_words", 1.0),
        "duplicate_lines": share("n_dup_lines", "n_word_lines", 1.0),
        "repeated_words": share("n_repeat_words", "n_words", 1.0),
        "long_words": (mean - 5.0) * 4,
        "short_words": (5.0 - mean) * 16,
        "few_words": F.lit(LEVELS) - F.col("n_words") / 4.0,
    }
    return {name: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(LEVELS - 1)).cast("int") for name, x in levels.items()}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), exactly up to rounding, summed from k downward."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = math.exp(log)
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < total * 1e-17:
            break
    return min(total, 1.0)


def lowest_cutoff(good: np.ndarray, share: float, error: float) -> int:
    """The lowest level to reject from; LEVELS if none is safe.  `good[l]`: good documents at level l."""
    n, rejected, cutoff = int(good.sum()), 0, LEVELS
    for level in range(LEVELS - 1, 0, -1):
        rejected += int(good[level])
        if binomial_tail(rejected, n, share) > error:
            break
        cutoff = level
    return cutoff


def calibrate(good: DataFrame, strata: list[str], share: float = MAX_FALSE_REJECTION, error: float = ERROR_LEVEL) -> DataFrame:
    """Cutoffs per stratum from the levels of labelled good documents: `strata` and an int column per rule.

    Only counts per stratum, rule and level leave the tasks.
    """
    names = list(rules())
    counts = written(
        good.groupBy(*strata).agg(
            *(F.count_if(F.col(r) == level).alias(f"{r}_{level}") for r in names for level in range(LEVELS))
        ),
        "quality-counts",
    )
    tests = max(1, counts.count()) * len(names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*strata).schema), *(f"cut_{r} int" for r in names)])

    def run(batches):
        for frame in batches:
            cuts = {}
            for r in names:
                levels = frame[[f"{r}_{x}" for x in range(LEVELS)]].to_numpy(np.int64)
                cuts[f"cut_{r}"] = [lowest_cutoff(x, share / len(names), error / tests) for x in levels]
            yield frame[strata].assign(**cuts)

    return counts.mapInPandas(run, schema)


def judge(docs: DataFrame, labels: DataFrame, by: list[str], strata: list[str], text: str = "text") -> DataFrame:
    """Per row of `docs`: `by`, `strata`, the measures, the levels, base_failed, rejected_by (array), kept.

    `labels` has the columns `by` and quality (1: good); rows without a label or with a
    null one teach nothing, and a label given twice counts once.  The base check fails
    texts of fewer than 20 words and texts of which more than 30 % are repeated words.
    Good documents that pass it calibrate the rules of their stratum; a stratum with
    too few of them has no cutoffs and rejects nothing.  A null stratum is a stratum of
    its own.  Null and empty texts fail the base check; an empty table stays empty.
    """
    names = list(rules())
    rows = measured(docs, [*by, *[s for s in strata if s not in by]], text)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = written(rows.withColumns(rules()).withColumn("base_failed", base), "quality-measures")
    good = rows.where(~F.col("base_failed")).join(labels.where("quality = 1").select(*by).distinct(), by)
    cuts = calibrate(good, strata)
    cuts = cuts.withColumnsRenamed({s: f"_{s}" for s in strata})
    known = written(cuts, "quality-cutoffs")
    if known.count() <= BROADCAST_STRATA:
        known = F.broadcast(known)
    same = F.lit(True)
    for s in strata:
        same = same & rows[s].eqNullSafe(known[f"_{s}"])
    flags = F.array_compact(F.array(*(F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in names)))
    return (
        rows.join(known, same, "left")
        .withColumn("rejected_by", flags)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop(*(f"_{s}" for s in strata), *(f"cut_{r}" for r in names))
    )
