"""Periodic runs of words, found by minimizers at several scales.

A run of period q repeats its first q words at distance q, so the smallest hash among
the grams of a window occurs again q words later, where the window has the same words.
The scale of grams and windows of g words serves periods from 2g to 4g: windows whose
minima are equal and that far apart seed a pair, which is extended to both sides as far
as words at that distance are equal.  Periods below 8 are scanned lag by lag.

Grams that repeat within half their own length would make every position a minimum.
They lie inside a run of a shorter period, which an earlier scale has found, and are no
anchors; a run all of whose windows hold such grams only has its second half inside a
shorter run, whose start is an anchor.  So each scale looks at a number of pairs in
proportion to the words, and nothing is missed.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.tables import answered

#: Periods below this are scanned directly; the first scale starts here.
FIRST_PERIOD = 8
LEAST_LENGTH = 12
#: Words looked at together, about; a longer text is looked at alone.
CHUNK_WORDS = 200_000


def gram_levels(word: np.ndarray) -> list[np.ndarray]:
    """Numbers of the grams of 1, 2, 4, ... words at each position, as far as any gram repeats.

    Equal numbers mean equal grams; a gram found once has a negative number of its own.
    `word` has a number for each word, negative where no other position is equal.
    """
    n = len(word)
    alone = -1 - np.arange(n + 1)
    levels, width = [], 1
    kinds, back, times = np.unique(word, return_inverse=True, return_counts=True)
    now = np.append(np.where((times[back] > 1) & (word >= 0), back, alone[:n]), alone[n])
    while (now >= 0).any():
        levels.append(now)
        at = np.flatnonzero(now[: max(n - width, 0)] >= 0)
        at = at[now[at + width] >= 0]
        _, back, times = np.unique(now[at] * (n + 1) + now[at + width], return_inverse=True, return_counts=True)
        now, width = alone.copy(), 2 * width
        repeated = times[back] > 1
        now[at[repeated]] = back[repeated]
    return levels


def extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words are equal before, and from, each pair of positions i < j."""
    ahead, back = i.copy(), i.copy()
    lag = j - i
    for k in range(len(levels) - 1, -1, -1):
        level, width = levels[k], 1 << k
        ahead += width * (level[ahead] == level[ahead + lag])
        left = back - width
        back -= width * ((left >= 0) & (level[np.maximum(left, 0)] == level[np.maximum(left, 0) + lag]))
    return i - back, ahead - i


def lag_runs(word: np.ndarray, lag: int) -> np.ndarray:
    """(start, end, lag) of all stretches of at least 2 * lag words in which words `lag` apart are equal."""
    if len(word) <= lag:
        return np.zeros((0, 3), np.int64)
    equal = np.diff(np.concatenate(([0], word[:-lag] == word[lag:], [0])).astype(np.int8))
    start, end = np.flatnonzero(equal == 1), np.flatnonzero(equal == -1)
    enough = end - start >= lag
    return np.stack([start, end + lag, np.full(len(start), lag)], 1)[enough]


def smallest_periods(runs: np.ndarray) -> np.ndarray:
    """One row per stretch, that of its smallest period; a multiple of it gives the same stretch."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs) < 2:
        return runs
    return runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]]


def gram_hash(gram: np.ndarray) -> np.ndarray:
    """Hashes of gram numbers, below 2^63; the number itself would prefer the words seen first."""
    x = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)


def window_minima(at: np.ndarray, gram: np.ndarray, width: int) -> np.ndarray:
    """Positions (of `at`, ascending) whose hash is the first smallest in some window of `width` positions."""
    if not len(at):
        return at
    # a gap of a window or more stands for itself: it can be shortened
    place = np.concatenate(([0], np.cumsum(np.minimum(np.diff(at), width))))
    value = np.full(place[-1] + 2 * width, np.iinfo(np.uint64).max, np.uint64)
    value[place + width - 1] = gram_hash(gram)
    where = np.arange(len(value))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = value[:-step], value[step:]
        where = np.where(left <= right, where[:-step], where[step:])
        value = np.minimum(left, right)
        reach += step
    found = np.unique(where[value < np.iinfo(np.uint64).max]) - (width - 1)
    return at[np.searchsorted(place, found)]


def _pairs(at: np.ndarray, gram: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of equal grams at distances from `least` to below twice that."""
    order = np.lexsort((at, gram))
    at, gram = at[order], gram[order]
    left, right = [at[:0]], [at[:0]]
    for step in range(1, len(at)):
        near = (gram[step:] == gram[:-step]) & (at[step:] - at[:-step] < 2 * least)
        if not near.any():
            break
        far = near & (at[step:] - at[:-step] >= least)
        left.append(at[:-step][far])
        right.append(at[step:][far])
    return np.concatenate(left), np.concatenate(right)


def _pairs_before(runs: np.ndarray, level: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the anchor of each run and the equal grams that far to its left."""
    anchor = runs[:, 0] + runs[:, 2] - 1
    anchor = anchor[level[anchor] >= 0]
    if not len(anchor):
        return anchor, anchor
    size = len(level)
    at = np.flatnonzero(level >= 0)
    key = np.sort(level[at] * size + at)
    base = level[anchor] * size
    lo = np.searchsorted(key, base + np.maximum(anchor - 2 * least + 1, 0))
    n = np.maximum(np.searchsorted(key, base + anchor - least + 1) - lo, 0) * (anchor >= least)
    right = np.repeat(anchor, n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return key[np.repeat(lo, n) + inside] % size, right


def find_runs(word: np.ndarray) -> np.ndarray:
    """(start, end, smallest period) of every maximal run of two periods and LEAST_LENGTH words or more.

    `word` numbers the words; a negative number equals nothing.
    """
    levels = gram_levels(word)
    if not levels:
        return np.zeros((0, 3), np.int64)
    runs = smallest_periods(np.concatenate([lag_runs(levels[0][:-1], q) for q in range(1, FIRST_PERIOD)]))
    width = FIRST_PERIOD // 2
    k = width.bit_length() - 1
    while k < len(levels):
        level, least = levels[k], 2 * width
        inner = runs[(runs[:, 2] <= width // 2) & (runs[:, 1] - runs[:, 0] >= width)]
        covered = np.zeros(len(level) + 1, np.int64)
        np.add.at(covered, inner[:, 0], 1)
        np.add.at(covered, inner[:, 1] - width + 1, -1)
        at = np.flatnonzero((level >= 0) & (np.cumsum(covered)[:-1] == 0))
        anchors = window_minima(at, level[at], width)
        left, right = _pairs(anchors, level[anchors], least)
        more = _pairs_before(inner[inner[:, 1] - inner[:, 0] >= least], level, width, least)
        left, right = np.concatenate([left, more[0]]), np.concatenate([right, more[1]])
        if len(left):
            before, after = extend(levels, left, right)
            lag, start = right - left, left - before
            found = np.stack([start, start + before + after + lag, lag], 1)[before + after >= lag]
            runs = smallest_periods(np.concatenate([runs, found]))
        k, width = k + 1, 2 * width
    return runs[runs[:, 1] - runs[:, 0] >= LEAST_LENGTH]


RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256", "collapsed")]
)


def _answers(texts: list[list[bytes]]) -> list[tuple]:
    """One row of RESULT for each text, given as its words."""
    known: dict[bytes, int] = {}
    size = sum(map(len, texts)) + len(texts)
    word, first, at = np.full(size, -1, np.int64), np.zeros(len(texts), np.int64), 0
    for x, words in enumerate(texts):
        first[x] = at
        word[at : at + len(words)] = [known.setdefault(w, len(known)) for w in words]
        at += len(words) + 1
    runs = find_runs(word)
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    gone = np.zeros(size + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    gone = np.cumsum(gone) > 0
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for x, words in enumerate(texts):
        own = [(s - int(first[x]), e - s, q) for s, e, q in runs[bounds[x] : bounds[x + 1]].tolist()]
        own.sort(key=lambda r: (r[0], r[2]))
        if own:
            best = min(own, key=lambda r: (-r[1], r[0], r[2]))
            best = (*best, 1000 * best[1] // best[2])
            words = [w for w, g in zip(words, gone[first[x] : first[x] + len(words)].tolist()) if not g]
        else:
            best = (None,) * 4
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in own).encode()
        kept = b" ".join(words)
        out.append((len(own), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, collapsed: bool = True) -> DataFrame:
    """`keep` (all columns but `text`, if not given) and the columns of RESULT for each row of `docs`.

    Words are runs of other bytes than x20 and x09 to x0D, numbered from 0.  A run is a
    stretch of words with smallest period q (words q apart are equal), of at least 12
    words and two periods, which no neighbouring word extends.  n_runs counts them all,
    overlapping ones too; start, length, period and exponent_milli tell the longest
    (ties: smallest start, then period) and are null without one; runs_sha256 is taken
    of all as lines `start,length,period` by start, then period.  `collapsed` is the
    text with the words of each run after its first period dropped, joined by single
    spaces, and is left out if not wanted.

    Whole texts are searched.  Null, empty and blank texts have no words and no runs;
    rows that repeat are answered one by one; an empty table stays empty; other columns
    pass through unread, and kept ones named as a result are replaced.
    """
    answers = [f for f in RESULT if collapsed or f.name != "collapsed"]
    names = {f.name for f in answers}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names and (keep is not None or c != text)]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("binary").alias("__text"))

    def work(batch):
        out, some, n = [], [], 0
        for value in batch.column(batch.num_columns - 1):
            # bytes.split() cuts at x20 and x09 to x0D exactly
            some.append((value.as_py() or b"").split())
            n += len(some[-1])
            if n >= CHUNK_WORDS:
                out += _answers(some)
                some, n = [], 0
        out += _answers(some)
        return [[r[i] for r in out] for i, f in enumerate(RESULT) if f.name in names]

    return answered(source, T.StructType(answers), lambda: work, drop=1)
