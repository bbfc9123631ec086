"""Finding benchmark passages in documents by spaced seeds, tolerant of substituted words.

A mask takes some words of a short window and ignores the others.  Windows of items and
documents that agree under one of the fixed masks have the same seed; seeds are joined,
and around each hit the words of the item are laid on the document's, without gaps, to
find the stretch with the best score of equal over unequal words.  Items shorter than a
window are looked for as a whole.  Everything is DataFrame functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places in a window that each mask looks at.
MASKS = ((0, 1, 3, 4, 7), (0, 2, 3, 5, 6), (0, 1, 2, 6, 7))
SPAN = 8
#: An unequal word costs as much as so many equal ones give.
MISMATCH = 2
#: A stretch counts if it has this share of the item's words, or so many words, and so few unequal ones.
SHARE, LONG = 0.5, 13
LEAST_WORDS = 7
#: Seeds of items are broadcast up to this size, candidates as well; else both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Hashes of the lower-case runs of letters, digits and underscores."""
    parts = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def seeds(text: Column) -> Column:
    """Seeds of all windows, mask after mask; empty for texts shorter than a window."""

    def all_masks(h: Column) -> Column:
        n = F.size(h) - SPAN

        def under(number: int, places: tuple[int, ...]) -> Column:
            return F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.lit(number), *(h[i + p] for p in places)))

        made = F.concat(*(under(k, places) for k, places in enumerate(MASKS)))
        return F.when(n >= 0, made).otherwise(F.array().cast("array<bigint>"))

    # a one-element array so that the words are hashed once
    return F.transform(F.array(words(text)), all_masks)[0]


def _windows(frame: DataFrame, text: str, keys: list[str], place: str) -> DataFrame:
    """(keys, place, seed): one row per window and mask."""
    made = frame.select(*keys, seeds(F.col(text)).alias("_seeds"))
    made = made.select(*keys, (F.size("_seeds") / len(MASKS)).cast("int").alias("_n"), F.posexplode("_seeds").alias("_at", "seed"))
    return made.select(*keys, (F.col("_at") % F.col("_n")).alias(place), "seed")


def _small(frame: DataFrame, width: Column) -> DataFrame:
    """`frame`, broadcast if the bytes of its rows, `width` each, are few."""
    size = frame.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame


def _whole(known: DataFrame, marked: DataFrame) -> DataFrame | None:
    """(id, text_hash, item, best) of the items shorter than a window, where all their words stand together.

    None without such items, so that only they cost a pass.  The windows of each of
    their lengths, at most SPAN - 1, are joined by the words themselves.
    """
    short = known.select("item", words(F.col("item_text")).alias("window"))
    short = short.where(F.size("window").between(1, SPAN - 1)).distinct()
    lengths = sorted(r[0] for r in short.select(F.size("window")).distinct().collect())
    if not lengths:
        return None

    def windows(h: Column) -> Column:
        def of(length: int) -> Column:
            places = F.sequence(F.lit(0), F.size(h) - length)
            made = F.transform(places, lambda i: F.struct(i.alias("at"), F.slice(h, i + 1, length).alias("window")))
            return F.when(F.size(h) >= length, made).otherwise(F.array().cast("array<struct<at:int,window:array<bigint>>>"))

        return F.concat(*map(of, lengths))

    wide = F.octet_length(F.coalesce(F.col("item").cast("string"), F.lit(""))) + F.size("window") * 8 + 40
    made = marked.select("id", "text_hash", F.transform(F.array(words(F.col("doc_text"))), windows)[0].alias("made"))
    hits = made.select("id", "text_hash", F.inline("made")).join(_small(short, wide), "window")
    n = F.size("window").cast("long")
    place = F.struct(
        F.lit(1.0).alias("share"),
        n.cast("int").alias("score"),
        (-F.col("at")).alias("early"),
        F.col("at").cast("long").alias("doc_start"),
        F.lit(0).cast("long").alias("item_start"),
        n.alias("n_span"),
        n.alias("n_equal"),
    )
    return hits.select("id", "text_hash", "item", place.alias("best"))


def _stretch(ours: Column, theirs: Column) -> Column:
    """Best stretch of two equally long arrays: (score, from, to, equal words)."""
    same = F.zip_with(ours, theirs, lambda a, b: a.eqNullSafe(b).cast("int"))
    start = F.struct(
        *(F.lit(0).alias(n) for n in ("at", "run", "since", "hits")), *(F.lit(0).alias(n) for n in ("score", "lo", "hi", "equal"))
    )

    def step(s: Column, x: Column) -> Column:
        fresh = s.run < 0
        run = F.when(fresh, F.lit(0)).otherwise(s.run) + F.when(x == 1, F.lit(1)).otherwise(F.lit(-MISMATCH))
        since = F.when(fresh, s.at).otherwise(s.since)
        hits = F.when(fresh, F.lit(0)).otherwise(s.hits) + x
        # of equal scores the one with more equal words
        better = (run > s.score) | ((run == s.score) & (hits > s.equal))
        return F.struct(
            (s.at + 1).alias("at"),
            run.alias("run"),
            since.alias("since"),
            hits.alias("hits"),
            F.when(better, run).otherwise(s.score).alias("score"),
            F.when(better, since).otherwise(s.lo).alias("lo"),
            F.when(better, s.at + 1).otherwise(s.hi).alias("hi"),
            F.when(better, hits).otherwise(s.equal).alias("equal"),
        )

    return F.aggregate(same, start, step, lambda s: F.struct(s.score, s.lo, s.hi, s.equal))


def overlaps(docs: DataFrame, items: DataFrame, by: str, item: str, text: str = "text", item_text: str = "text") -> DataFrame:
    """Benchmark passages in documents: `by`, text_hash, `item`, doc_start, item_start, n_span, n_equal, share.

    One row for each document and item that overlap, with the best stretch, in words
    from 0.  A stretch counts if at least half of the item's words, or 13 words, are
    equal in it, and at least 7, at most one word in three being another.  Items of
    fewer words than a window (8) count where all their words stand together, in texts
    of any length; of the longer ones nothing is found in a text of fewer than 8 words.
    A null text has no words, and an item without words is never found.  Items with the same id are looked for one by one and the
    best counts.  Rows equal in `by` and text are answered once; a null `by` is a value
    like others.  Empty tables give an empty result.
    """
    known = items.select(F.col(item).alias("item"), F.col(item_text).alias("item_text")).where("item_text IS NOT NULL").distinct()
    known = known.select("item", "item_text", F.xxhash64("item_text").alias("item_hash"))
    marked = docs.select(F.col(by).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("doc_text")).where("doc_text IS NOT NULL")

    wanted = _windows(known, "item_text", ["item", "item_hash"], "item_at").distinct()
    hits = _windows(marked, "doc_text", ["id", "text_hash"], "doc_at").join(_small(wanted, F.lit(40)), "seed")
    diagonals = hits.groupBy("id", "text_hash", "item", "item_hash", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(
        F.count(F.lit(1)).alias("hits")
    )
    laid = known.select(F.col("item").alias("_item"), F.col("item_hash").alias("_hash"), words(F.col("item_text")).alias("item_words"))
    diagonals = diagonals.join(_small(laid, F.size("item_words") * 8 + 40), F.col("item").eqNullSafe(F.col("_item")) & (F.col("item_hash") == F.col("_hash")))
    # the candidates' words are fetched from their documents; few documents have any
    per_doc = diagonals.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash")).agg(
        F.collect_list(F.struct("item", "shift", "item_words")).alias("places")
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text_hash"))
    found = marked.join(per_doc, same).dropDuplicates(["id", "text_hash"])
    found = found.select("id", "text_hash", words(F.col("doc_text")).alias("doc_words"), F.explode("places").alias("p"))
    found = found.select("id", "text_hash", "p.*", "doc_words")
    # the part of the item that lies on the document
    skipped = F.greatest(-F.col("shift"), F.lit(0)).cast("int")
    length = F.least(F.size("item_words") - skipped, F.size("doc_words") - F.greatest("shift", F.lit(0)).cast("int"))
    ours = F.slice("doc_words", F.greatest("shift", F.lit(0)).cast("int") + 1, length)
    theirs = F.slice("item_words", skipped + 1, length)
    found = found.select("id", "text_hash", "item", "shift", skipped.alias("skipped"), F.size("item_words").alias("n_item"), _stretch(ours, theirs).alias("s"))
    enough = (F.col("s.equal") >= LEAST_WORDS) & ((F.col("s.equal") >= SHARE * F.col("n_item")) | (F.col("s.equal") >= LONG))
    rows = found.where(enough).select(
        "id",
        "text_hash",
        "item",
        F.struct(
            (F.col("s.equal") / F.col("n_item")).alias("share"),
            F.col("s.score").alias("score"),
            (-F.greatest("shift", F.lit(0))).alias("early"),
            (F.col("s.lo") + F.greatest("shift", F.lit(0))).cast("long").alias("doc_start"),
            (F.col("s.lo") + F.col("skipped")).cast("long").alias("item_start"),
            (F.col("s.hi") - F.col("s.lo")).cast("long").alias("n_span"),
            F.col("s.equal").cast("long").alias("n_equal"),
        ).alias("best"),
    )
    whole = _whole(known, marked)
    if whole is not None:
        rows = rows.unionByName(whole)
    rows = rows.groupBy("id", "text_hash", "item").agg(F.max("best").alias("best"))
    return rows.select(
        F.col("id").alias(by), "text_hash", F.col("item").alias(item), *(f"best.{c}" for c in ("doc_start", "item_start", "n_span", "n_equal", "share"))
    )


def clean(docs: DataFrame, items: DataFrame, by: str, item: str, text: str = "text") -> DataFrame:
    """`docs` without the rows that overlap an item; all else as it was."""
    bad = overlaps(docs, items, by, item, text).select(F.col(by).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(bad, docs[by].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text]) == bad["_hash"]), "left_anti")
