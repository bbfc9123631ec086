"""Language identification by interpolated Kneser-Ney models of letters.

Texts become letters in 63 classes (a to z, and all other letters dealt to 37 classes by
code point) with one boundary for each run of other characters.  Each language has one
model: sorted arrays of the packed n-grams it has seen, with their log-probabilities,
and tables for backing off.  A text gets the language of the lowest cross-entropy per
letter; it is marked as rejected if even that is unusually high for texts of the language
and length that the models have not seen.
"""

import pickle
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.tables import answered
from tallyhouse.session import written

BITS = 6
ORDER = 4
#: n-grams that make up less than this share of their language's are left to the shorter ones; 0 keeps all,
#: of which there are at most 2 ** (BITS * ORDER) (8 bytes each, and 2 MB of tables), however large the corpus.
LEAST_SHARE = 0.0
#: Bytes of the models a pass holds; further languages take further passes.
AT_ONCE = 1 << 27
#: Characters looked at together.
SLICE = 1_000_000
#: n-grams a task gathers before it hands them on.
HELD = 1_000_000
#: One in so many teaching texts sets the rejection limits; the models that score it have not seen it.
CALIBRATION = 10
#: Share of a language's own texts that its rejection limit leaves out.
REJECTED_SHARE = 0.005
#: Texts needed for a limit of their length alone; else all lengths of the language share one.
LEAST_TEXTS = 400
#: Letters after which a text's length adds no more certainty.
SURE_LETTERS = 30
UNKNOWN = "und"
_BREAK = "\ud800"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + (c * 2654435761 >> 7) % 37
    return out


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed n-grams, text of each, letters per text) of all symbols of some texts.

    A text starts with a boundary; one without letters has no n-grams.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(_BREAK + t for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = codes == ord(_BREAK)
    symbol = _classes()[codes]
    letter = symbol > 0
    # a boundary stands for the first of a run of other characters after a letter
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~start[1:]
    doc = np.cumsum(start, dtype=np.int32) - 1
    symbol, doc = symbol[keep].astype(np.uint32), doc[keep]
    out = symbol.copy()
    for back in range(1, order):
        same = doc[back:] == doc[:-back]
        out[back:] |= np.where(same, symbol[:-back], 0).astype(np.uint32) << np.uint32(BITS * back)
    return out, doc, np.bincount(doc[symbol > 0], minlength=len(texts))


def _slices(texts: list[str]):
    """Runs of texts of about SLICE characters; a longer text is one run."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def _calibrates(text: str) -> Column:
    """Whether a text is kept out of the models that set the limits; equal texts go together."""
    return F.pmod(F.xxhash64(text, F.lit("calibration")), F.lit(CALIBRATION)) == 0


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n, n_taught) over all texts with a language; `n_taught` leaves out those that calibrate."""

    def run(batches):
        held, size = {}, 0

        def out():
            for (key, kept_out), parts in held.items():
                gram, n = _summed(parts)
                yield pd.DataFrame({"lang": key, "gram": gram.astype(np.int64), "n": n, "n_taught": n * (not kept_out)})
            held.clear()

        for frame in batches:
            for key, group in frame.groupby(["lang", "kept_out"])["text"]:
                for _, texts in _slices(group.to_list()):
                    found = np.sort(grams(texts)[0])
                    if not len(found):
                        continue
                    edge = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                    held.setdefault(key, []).append((found[edge], np.diff(np.r_[edge, len(found)])))
                    if len(held[key]) > 8:
                        held[key] = [_summed(held[key])]
            size = sum(len(g) for parts in held.values() for g, _ in parts)
            if size > HELD:
                yield from out()
        yield from out()

    source = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    made = source.withColumn("kept_out", _calibrates("text")).mapInPandas(run, "lang string, gram long, n long, n_taught long")
    return made.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_taught").alias("n_taught"))


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    gram = np.concatenate([g for g, _ in parts])
    unique, where = np.unique(gram, return_inverse=True)
    return unique, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


class Model:
    """Interpolated Kneser-Ney: sorted n-grams with log-probabilities, and what unseen ones back off to."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, order: int):
        """`gram` sorted, of `order` symbols, seen `n` times."""
        chance = np.full(1 << BITS, 1.0 / (1 << BITS))
        levels = [(gram.astype(np.int64), n.astype(np.float64))]
        for k in range(order - 1, 0, -1):
            # a shorter n-gram counts once for each symbol seen before it
            short, times = np.unique(levels[-1][0] & ((1 << BITS * k) - 1), return_counts=True)
            levels.append((short, times.astype(np.float64)))
        for k, (g, c) in zip(range(1, order + 1), reversed(levels)):
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = g >> BITS
            contexts = 1 << BITS * (k - 1)
            total, kinds = np.bincount(context, c, contexts), np.bincount(context, minlength=contexts)
            with np.errstate(invalid="ignore", divide="ignore"):
                weight = np.where(total > 0, discount * kinds / total, 1.0)
            lower, lowest = chance, (1 << BITS * max(k - 1, 1)) - 1
            seen = (c - discount) / total[context] + weight[context] * lower[g & lowest]
            if k == order:
                self.gram, self.seen = gram.astype(np.uint32), np.log(seen).astype(np.float32)
                self.weight, self.lower = np.log(weight).astype(np.float32), np.log(lower).astype(np.float32)
                self.lowest = np.uint32(lowest)
            else:
                every = np.arange(1 << BITS * k)
                chance = weight[every >> BITS] * lower[every & lowest]
                chance[g] = seen

    def log_chance(self, gram: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        return np.where(self.gram[at] == gram, self.seen[at], self.weight[gram >> np.uint32(BITS)] + self.lower[gram & self.lowest])


class Models:
    """The stored models of all languages, and those without the texts that calibrate; read some languages at a time."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang"):
        """Every text and every language counts.  A model is built by one task, from at most 2 ** (BITS * ORDER) n-grams."""
        counts = written(gram_counts(docs, text, lang), "language-counts")
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        # a row for each language
        common = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= LEAST_SHARE * F.col("total"))

        def build(frame):
            frame = frame.sort_values("gram")
            model = Model(frame["gram"].to_numpy(), frame["n"].to_numpy(), ORDER)
            return pd.DataFrame({"lang": frame["lang"].iloc[:1], "model": [pickle.dumps(model)]})

        def built(n: str) -> DataFrame:
            rows = common.where(F.col(n) > 0).select("lang", "gram", F.col(n).alias("n")).groupBy("lang")
            return written(rows.applyInPandas(build, "lang string, model binary"), "language-models")

        self.whole, self.taught = built("n"), built("n_taught")
        self.parts, size = [], AT_ONCE
        for name, length in sorted((r[0], r[1]) for r in self.whole.select("lang", F.length("model")).collect()):
            if size + length > AT_ONCE:
                self.parts.append([])
                size = 0
            self.parts[-1].append(name)
            size += length

    def of(self, names: list[str], blind: bool = False) -> list[Model]:
        """Models of some languages; one all of whose texts calibrate has but one model."""

        def read(stored: DataFrame, wanted: list[str]) -> dict[str, Model]:
            return {r["lang"]: pickle.loads(r["model"]) for r in stored.where(F.col("lang").isin(wanted)).toLocalIterator()}

        found = read(self.taught, names) if blind else {}
        found |= read(self.whole, [n for n in names if n not in found])
        return [found[name] for name in names]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], list[Model], list[Model]]:
    """(languages in order of name, their models, their models without the texts that calibrate), all on the driver."""
    models = Models(docs, text, lang)
    names = [name for part in models.parts for name in part]
    return names, models.of(names), models.of(names, blind=True)


def entropies(texts: list[str], models: list[Model], scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per symbol by text and model, letters per text)."""
    gram, doc, letters = grams(texts)
    ordered = np.sort(gram)
    kinds = ordered[np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])] if len(gram) else ordered
    scratch[kinds] = np.arange(len(kinds))
    where = scratch[gram]
    n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
    out = np.zeros((len(texts), len(models)))
    for m, model in enumerate(models):
        out[:, m] = np.bincount(doc, model.log_chance(kinds)[where] if len(kinds) else None, minlength=len(texts))
    return -out / n[:, None], letters


def identify(docs: DataFrame, teaches: str, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """`keep`, lang_pred, score, entropy and rejected for each row of `docs`.

    Models come from the rows where the boolean column `teaches` is true and neither
    `text` nor `lang` is null; nothing else is looked at to score a row than its text.
    A text that is null or has no letter is `und` with score 0 and rejected; so is every
    text if nothing could be learned.  Of equal entropies the first language by name
    wins.  The score is the share of the best language when the entropies of at most 30
    letters are taken as evidence.  The rejection limit of a language is the entropy that
    all but 0.5 % of its teaching texts of a like length stay below, as models see them
    that have not learned from those texts; it does not change lang_pred, and a language
    without such texts rejects none.  Texts are scored whole; rows that repeat are scored
    one by one; an empty table stays empty.
    """
    taught = docs.where(teaches)
    models = Models(taught, text, lang)
    limits = _limits(taught.where(_calibrates(text)), text, lang, models)
    rows = docs.select(*(F.col(k) for k in keep), F.col(text).alias("_text"))
    return _scored(rows, models, limits)


def length_class(letters: np.ndarray) -> np.ndarray:
    """Texts of like length: powers of two, 1,024 letters and more together."""
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), 10)


def _limits(docs: DataFrame, text: str, lang: str, models: Models) -> dict[str, np.ndarray]:
    """Highest entropy that is not rejected, by length class, for each language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("own"), F.col(text))
    found = _scored(rows, models, {}, "length").where("lang_pred = own")
    share = F.percentile_approx("entropy", 1 - REJECTED_SHARE, 100_000)
    # a row for each language and class
    of = {(r["own"], r["length"]): (r["n"], r["top"]) for r in found.rollup("own", "length").agg(F.count(F.lit(1)).alias("n"), share.alias("top")).collect()}
    limits = {}
    for name in {own for own, _ in of}:
        limits[name] = np.full(11, np.inf)
        for length in range(11):
            n, top = of.get((name, length), (0, None))
            limits[name][length] = top if n >= LEAST_TEXTS else of.get((name, None), (0, np.inf))[1]
    return limits


def _scored(source: DataFrame, models: Models, limits: dict[str, np.ndarray], *more: str) -> DataFrame:
    """Answers for the last column of `source`, a text, which goes; `more` asks for its length class, and for the
    models without the texts that calibrate.

    One pass takes as many languages as fit into AT_ONCE; further ones go on from the
    best language so far, its entropy and the odds against it, and change no answer.
    """
    columns, state = source.columns[:-1], ("_best", "_low", "_odds")
    for number, names in enumerate(parts := models.parts or [[]]):
        last = number == len(parts) - 1
        held = source.sparkSession.sparkContext.broadcast((names, models.of(names, blind=bool(more)), limits if last else {}))
        work = _work(held, number > 0, last, bool(more))
        if last:
            answers = T.StructType().add("lang_pred", "string").add("score", "double").add("entropy", "double").add("rejected", "boolean")
            for name in more:
                answers = answers.add(name, "long")
            return answered(source, answers, work, drop=1 + 3 * (number > 0))
        plain = source.toDF(*(f"c{i}" for i in range(len(source.columns))))
        answers = T.StructType().add("s0", "string").add("s1", "double").add("s2", "double")
        # the text goes on as the last column, what the passes before found goes
        found = answered(plain, answers, work)
        kept = written(found.select(*(f"c{i}" for i in range(len(columns))), "s0", "s1", "s2", f"c{len(plain.columns) - 1}"), "language-scores")
        source = kept.toDF(*columns, *state, "_text")


def _work(held, goes_on: bool, last: bool, lengths: bool):
    def start():
        names, models, limits = held.value
        scratch, free = np.zeros(1 << BITS * ORDER, np.int32), np.full(11, np.inf)

        def work(batch):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            best, low, odds = np.full(len(texts), None, object), np.full(len(texts), np.inf), np.zeros(len(texts))
            if goes_on:
                best[:] = batch.column(batch.num_columns - 4).to_pylist()
                low, odds = (batch.column(batch.num_columns - k).to_numpy(zero_copy_only=False).copy() for k in (3, 2))
            counted = np.zeros(len(texts), np.int64)
            if models:
                for first, some in _slices(texts):
                    at = slice(first, first + len(some))
                    found, letters = entropies(some, models, scratch)
                    sure, least, before = np.minimum(letters, SURE_LETTERS), found.min(axis=1), low[at].copy()
                    better = least < before
                    low[at] = lower = np.where(better, least, before)
                    fall = np.where(np.isfinite(before), before - lower, 0)
                    odds[at] = odds[at] * np.exp(-fall * sure) + np.exp(-(found - lower[:, None]) * sure[:, None]).sum(axis=1)
                    best[at] = np.where(better, np.array(names, object)[found.argmin(axis=1)], best[at])
                    counted[at] = letters
            if not last:
                return best.tolist(), low, odds
            known = counted > 0
            score = np.divide(1, odds, out=np.zeros(len(texts)), where=known)
            entropy = np.where(known, low, np.nan).round(9)
            languages = [b if k else UNKNOWN for b, k in zip(best, known)]
            length = np.where(known, length_class(counted), 0)
            limit = np.array([limits.get(b, free)[c] for b, c in zip(languages, length)], float)
            rejected = ~known | (entropy > limit)
            return languages, score.round(9), pa.array(entropy, mask=~known), rejected, *([length] if lengths else [])

        return work

    return start
