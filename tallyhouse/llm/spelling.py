"""Grouping spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

Every word is told by a 64-bit polynomial hash of its letters, so that the hash of an
edited word follows from sums over the word in constant time, without building it.  The
vocabulary goes into blocked Bloom filters (one 64-bit block for each word's bits), one
for each length of word.  A task generates the deletions of its words and the
replacements by smaller letters, which meet every pair of near words exactly once, and
looks them up in the filters.  Only what they say may exist is shuffled: hashes join
the hashes of the vocabulary, the words themselves decide.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.tables import ascii_lower
from tallyhouse.session import written

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
#: Bits of a filter for each word, and bits that a word sets.
BITS_PER_WORD, PROBES = 20, 4
#: Filters broadcast together; a larger vocabulary is probed in several passes.
FILTER_BYTES = 32 << 20
#: Blocks of a filter packed by one task.
CHUNK_BLOCKS = 1 << 16
#: Edits hashed at a time.
EDITS = 1 << 20

_SEED = np.random.default_rng(13)
_LETTER = _SEED.integers(1, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_FACTOR = np.uint64(0xD1342543DE82EF95)


def _powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), _FACTOR, np.uint64))))[:n]


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of words of one length, given as rows of Latin-1 codes."""
    return (_LETTER[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mixed hash that picks the block, the bits set in it)."""
    x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    mask = np.zeros(len(x), np.uint64)
    for p in range(PROBES):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * p)) & np.uint64(63))
    return x >> np.uint64(6 * PROBES), mask


def edits(codes: np.ndarray, alphabet: np.ndarray):
    """Batches of (row, hash, length) of the deletions and the replacements by smaller letters.

    `codes` are words of one length.  Deleting any of several equal letters in a row
    gives the same word, which is given once.
    """
    n, length = codes.shape
    power, letter = _powers(length), _LETTER[codes]
    total = (letter * power).sum(axis=1, dtype=np.uint64)
    rows = max(1, EDITS // (length * len(alphabet)))
    wide = max(1, EDITS // len(alphabet))
    for a in range(0, n, rows):
        part, own = codes[a : a + rows], letter[a : a + rows]
        if length > 1:
            # the letters after a deleted one move one place to the left
            moved = np.cumsum((own[:, 1:] * power[:-1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
            moved = np.concatenate((moved, np.zeros((len(part), 1), np.uint64)), axis=1)
            before = np.cumsum(own * power, axis=1, dtype=np.uint64) - own * power
            first = np.concatenate((np.ones((len(part), 1), bool), part[:, 1:] != part[:, :-1]), axis=1)
            row, _ = np.nonzero(first)
            yield row + a, (before + moved)[first], length - 1
        for lo in range(0, length, wide):
            at = slice(lo, lo + wide)
            smaller = alphabet[None, None, :] < part[:, at, None]
            change = (_LETTER[alphabet][None, None, :] - own[:, at, None]) * power[None, at, None]
            row, _, _ = np.nonzero(smaller)
            yield row + a, (total[a : a + rows][:, None, None] + change)[smaller], length


def _codes(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places in `words`, and the words as rows of codes."""
    by_length: dict[int, list[int]] = {}
    for x, word in enumerate(words):
        by_length.setdefault(len(word), []).append(x)
    return {
        length: (np.array(at), np.frombuffer("".join(words[x] for x in at).encode("latin-1"), np.uint8).reshape(len(at), length))
        for length, at in by_length.items()
        if length
    }


def hashed(words: DataFrame) -> DataFrame:
    """`words` with the hash of the column word."""

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for at, codes in _codes(batch.column("word").to_pylist()).values():
                step = max(1, EDITS // codes.shape[1])
                for a in range(0, len(at), step):
                    out[at[a : a + step]] = word_hashes(codes[a : a + step])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=[*batch.schema.names, "hash"])

    return words.mapInArrow(run, T.StructType([*words.schema.fields]).add("hash", "long"))


def filter_blocks(words: int) -> int:
    return max(1, -(-words * BITS_PER_WORD // 64))


def _filters(words: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """The filter of each length: tasks set bits and pack chunks, the driver puts at most FILTER_BYTES together."""

    def mark(batches):
        for batch in batches:
            block, mask = _bits(batch.column("hash").to_numpy().view(np.uint64))
            length = batch.column("length").to_numpy()
            block = block % np.array([sizes[x] for x in length.tolist()], np.uint64)
            yield pa.record_batch([pa.array(length), pa.array(block.astype(np.int64)), pa.array(mask.view(np.int64))], ["length", "block", "bits"])

    def pack(group: pa.Table) -> pa.Table:
        place = group.column("block").to_numpy()
        base = place.min() // CHUNK_BLOCKS * CHUNK_BLOCKS
        out = np.zeros(CHUNK_BLOCKS, np.int64)
        out[place - base] = group.column("bits").to_numpy()
        return pa.table({"length": group.column("length")[:1], "base": pa.array([base]), "packed": pa.array([out.tobytes()])})

    marked = words.select("hash", "length").mapInArrow(mark, "length int, block long, bits long")
    blocks = marked.groupBy("length", "block").agg(F.bit_or("bits").alias("bits"))
    chunks = blocks.groupBy("length", F.floor(F.col("block") / CHUNK_BLOCKS)).applyInArrow(pack, "length int, base long, packed binary")
    out = {length: np.zeros(size, np.int64) for length, size in sizes.items()}
    for length, base, packed in chunks.collect():
        filled = np.frombuffer(packed, np.int64)[: sizes[length] - base]
        out[length][base : base + len(filled)] = filled
    return {length: x.view(np.uint64) for length, x in out.items()}


def positives(words: DataFrame, part: DataFrame, sizes: dict[int, int], alphabet: bytes) -> DataFrame:
    """(source, hash): the hashes of edits of `words` that the filters of `part` (hash, length) know."""
    held = words.sparkSession.sparkContext.broadcast(_filters(part, sizes))
    letters = np.frombuffer(alphabet, np.uint8)

    def probe(batches):
        filters = held.value
        for batch in batches:
            source = batch.column("hash").to_numpy()
            for length, (at, codes) in _codes(batch.column("word").to_pylist()).items():
                if length not in filters and length - 1 not in filters:
                    continue
                for row, found, size in edits(codes, letters):
                    if size not in filters or not len(found):
                        continue
                    known = filters[size]
                    block, mask = _bits(found)
                    hit = known[(block % np.uint64(len(known))).astype(np.int64)] & mask == mask
                    yield pa.record_batch([pa.array(source[at[row[hit]]]), pa.array(found[hit].view(np.int64))], ["source", "hash"])

    return words.select("word", "hash").mapInArrow(probe, "source long, hash long")


def near_words(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n): every word with every word that one insertion, deletion or replacement away.

    `vocabulary` has distinct words of Latin-1 letters and a count n; both directions of
    a pair are given.  Filters larger than `filter_bytes` are built and probed in parts,
    dealt by hash; the pairs are the same.
    """
    vocabulary = written(hashed(vocabulary).withColumn("length", F.length("word")), "vocabulary")
    counts = {r["length"]: r["n"] for r in vocabulary.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = bytes(sorted(ord(r["c"]) for r in letters.collect()))
    parts = max(1, -(-8 * sum(map(filter_blocks, counts.values())) // filter_bytes))
    found = []
    for p in range(parts):
        own = vocabulary if parts == 1 else vocabulary.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == p)
        sizes = counts if parts == 1 else {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
        found.append(written(positives(vocabulary, own, {x: filter_blocks(n) for x, n in sizes.items()}, alphabet), "edits"))
    edited = found[0]
    for more in found[1:]:
        edited = edited.unionByName(more)
    # what the filters let through meets the vocabulary by hash, then by the words themselves
    target = vocabulary.select("hash", F.col("word").alias("near"), F.col("n").alias("near_n"))
    source = vocabulary.select(F.col("hash").alias("source"), "word", "n")
    pairs = edited.join(target, "hash").drop("hash").join(source, "source").where(F.levenshtein("word", "near", 1) == 1)
    pairs = written(pairs.select("word", "n", "near", "near_n").distinct(), "near")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each of `forms` (word, form): the end of its chain of forms.

    Counts at least double along a chain, so the chains are short; each round doubles
    the steps that every word has gone, and words that have arrived are not joined again.
    """
    done, active = [], written(forms.select("word", F.col("form").alias("at")), "forms")
    steps = active
    while True:
        jump = steps.select(F.col("word").alias("_from"), F.col("at").alias("_to"))
        moved = written(active.join(jump, F.col("at") == F.col("_from"), "left"), "chains")
        done.append(moved.where("_from IS NULL").select("word", F.col("at").alias("root")))
        active = moved.where("_from IS NOT NULL").select("word", F.col("_to").alias("at"))
        if active.isEmpty():
            break
        # words that have arrived can still be passed through
        steps = written(steps.join(jump, F.col("at") == F.col("_from"), "left").select("word", F.coalesce("_to", "at").alias("at")), "steps")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def vocabulary_of(docs: DataFrame, words, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of an array column, counted over all rows."""
    return (
        docs.select(F.explode(words).alias("word"))
        .where(F.length("word") >= least_letters)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_count)
    )


def runs_of_letters(text):
    """The runs of letters of a text, with A to Z lower-cased; null for a null text."""
    return F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(LETTERS), F.lit(0))


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, form, root, n_near, form_n) for each row of `vocabulary` (word, n).

    Words are near if they differ by exactly one inserted, deleted or replaced code
    point; n_near counts them.  The form of a word is its near word of largest n (ties:
    the smallest in code-point order) if that n is at least `ratio` times its own, which
    must be above 1 for chains to end; else null, as form_n.  The root follows forms to
    the last; a word without a form is its own root.  An empty vocabulary stays empty.
    Words consist of letters of Latin-1, of any length.
    """
    vocabulary = written(vocabulary.select("word", "n"), "words")
    pairs = near_words(vocabulary, filter_bytes)
    best = pairs.groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    )
    taken = -F.col("best.minus") >= ratio * F.col("n")
    best = best.select("word", "n_near", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n"))
    best = written(best, "forms")
    ends = roots(best.where("form IS NOT NULL").select("word", "form"))
    return (
        vocabulary.join(best, "word", "left")
        .join(ends, "word", "left")
        .select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
