"""Packing tokenized documents into windows with hardly any padding.

Whole windows are cut off long documents.  The lengths that remain, rounded up to bins,
form a histogram; the multisets of at most six bins that fill a window exactly are the
columns of a non-negative least squares problem whose solution says how often to use
each.  Rounded down to what the histogram holds, it places most documents uncut.  The
residual documents form one stream, which fills the gaps of those windows, then windows
of its own, and ends in windows of powers of two.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.prefix import hash_bucket, running
from tallyhouse.llm.tables import answered, lean
from tallyhouse.llm.tokens import tokenizer
from tallyhouse.session import written

WINDOW = 4096
BIN = 64
MAX_PARTS = 6
#: The id that ends every document.
END_ID = 2


def combinations(units: int, most: int) -> np.ndarray:
    """Multisets of 1 to `most` bins that sum to `units`, a row of counts per bin (bin b at b - 1)."""
    out = []

    def extend(parts: list[int], left: int, largest: int) -> None:
        if left == 0:
            out.append(parts)
        elif len(parts) < most:
            # the rest must fit into the parts that may still come
            for part in range(min(left, largest), -(-left // (most - len(parts))) - 1, -1):
                extend([*parts, part], left - part, part)

    extend([], units, units)
    counts = np.zeros((len(out), units), np.int64)
    for row, parts in zip(counts, out):
        np.add.at(row, np.array(parts) - 1, 1)
    return counts


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimizes |a x - b|, by active sets."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(6 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            wanted = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (wanted > 0).all():
                x[:] = 0
                x[at] = wanted
                break
            low = wanted <= 0
            step = (x[at][low] / np.maximum(x[at][low] - wanted[low], 1e-300)).min()
            x[at] += step * (wanted - x[at])
            used[at[(x[at] <= 1e-12) & low]] = False
            x[~used] = 0
    return x


def plan(counts: np.ndarray, tokens: np.ndarray, window: int = WINDOW, size: int = BIN) -> tuple[np.ndarray, np.ndarray]:
    """(combinations used, repeats): how often to fill a window with which bins.

    `counts` and `tokens` are documents and their tokens per bin.  Enough documents are
    left over for their tokens to fill the gaps that rounding up leaves, as expected
    from the bins' mean lengths.
    """
    columns = combinations(window // size, MAX_PARTS)
    wanted = nnls(columns.T.astype(float), counts.astype(float))
    repeats, left = np.zeros(len(columns), np.int64), counts.copy()
    # rounded down to what is there, the often used first; then what the rounding left, longest parts first
    for order, limit in ((np.argsort(-wanted, kind="stable"), np.floor(wanted).astype(np.int64)), (np.arange(len(columns)), None)):
        for c in order:
            if limit is not None and limit[c] == 0:
                break
            need = columns[c]
            fits = int((left[need > 0] // need[need > 0]).min())
            n = fits if limit is None else min(fits, int(limit[c]))
            repeats[c] += n
            left -= n * need
    mean = tokens / np.maximum(counts, 1)
    filled = columns @ mean
    gap, rest = float((repeats * (window - filled)).sum()), float((left * mean).sum())
    if gap > rest:
        share = (gap - rest) / (gap + float((repeats * filled).sum()))
        repeats = np.floor(repeats * (1 - share)).astype(np.int64)
    kept = repeats > 0
    return columns[kept], repeats[kept]


def _ranges(columns: np.ndarray, repeats: np.ndarray) -> pd.DataFrame:
    """For each bin the runs of ranks that go to a combination, by bin and first rank."""
    base = np.cumsum(repeats) - repeats
    next_rank = np.zeros(columns.shape[1], np.int64)
    out = []
    for need, n, first in zip(columns, repeats, base):
        slot = 0
        for b in np.flatnonzero(need):
            out.append((b + 1, next_rank[b], next_rank[b] + n * need[b], need[b], first, slot))
            next_rank[b] += n * need[b]
            slot += need[b]
    runs = pd.DataFrame(out, columns=["bin", "lo", "hi", "each", "first", "slot"], dtype=np.int64)
    return runs.sort_values(["bin", "lo"], ignore_index=True)


def tail_windows(tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the powers of two that sum to `tokens`, largest first."""
    out, start = [], 0
    for power in reversed(range(tokens.bit_length())):
        if tokens >> power & 1:
            out.append((start, 1 << power))
            start += 1 << power
    return out


def _ids(path: str, texts: pa.Array) -> Iterator[memoryview]:
    for ids in tokenizer(path).encode_all(texts):
        yield memoryview(b"%b%b" % (ids, END_ID.to_bytes(4, "little")))


def token_counts(docs: DataFrame, by: list[str], text: str, path: str, window: int = WINDOW) -> DataFrame:
    """`by`, text_hash, doc_tokens, the checksums of the whole windows, and length and checksum of the rest."""
    source = docs.select(*by, F.xxhash64(text).alias("text_hash"), F.col(text).alias("__text"))
    answers = T.StructType().add("doc_tokens", "long").add("whole_crc", T.ArrayType(T.LongType())).add("rest", "long").add("rest_crc", "long")

    def work(batch):
        made = []
        for ids in _ids(path, batch.column(batch.num_columns - 1)):
            n = len(ids) // 4
            cut = n // window * window
            made.append((n, [zlib.crc32(ids[4 * i : 4 * (i + window)]) for i in range(0, cut, window)], n - cut, zlib.crc32(ids[4 * cut :])))
        return [[m[i] for m in made] for i in range(4)]

    return answered(source, answers, lambda: work, drop=1)


def _assigned(rests: DataFrame, runs: pd.DataFrame) -> DataFrame:
    """`rests` (with bin and rank) with sequence and slot, null for the residual ones."""
    key = (runs["bin"].to_numpy() << 44) + runs["lo"].to_numpy()
    held = [runs[c].to_numpy() for c in ("lo", "hi", "each", "first", "slot", "bin")]
    def work(batch):
        lo, hi, each, first, slot, bins = held
        b, rank = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
        if not len(key):
            return pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())
        at = np.searchsorted(key, (b << 44) + rank, side="right") - 1
        ok = (at >= 0) & (bins[at] == b) & (rank < hi[at])
        at = np.where(ok, at, 0)
        within = rank - lo[at]
        return pa.array(first[at] + within // each[at], mask=~ok), pa.array(slot[at] + within % each[at], mask=~ok)

    source = rests.select(*(c for c in rests.columns if c not in ("bin", "rank")), "bin", "rank")
    return answered(source, T.StructType().add("sequence", "long").add("slot", "long"), lambda: work, drop=2)


def pack(docs: DataFrame, path: str, by: list[str], text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: `by`, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the tokenizer at `path`, then id 2; a null text is an empty
    one, so that every row has at least one id.  Sequences hold `window` ids; only the
    last few are shorter, and those are powers of two.  Rows that repeat are packed one
    by one; nulls in `by` are values; an empty table has no pieces.  If too few tokens
    are left over to fill all gaps, some windows keep a little padding at their end.

    The driver sees one row per length bin and a few totals.
    """
    keys = [*by, "text_hash"]
    docs = docs.select(*by, text)
    made = written(token_counts(docs, by, text, path, window), "token-counts")
    n_docs, n_whole = made.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("whole_crc")), F.lit(0))).first()

    # whole windows
    whole = running(
        made.where(F.size("whole_crc") > 0), "sequence", F.size("whole_crc").cast("long"), hash_bucket(keys, n_docs), [*keys, "doc_tokens"]
    ).select(*by, "doc_tokens", "sequence", F.posexplode("whole_crc").alias("place", "ids_crc32"))
    whole = whole.select(
        *by,
        (F.col("place") * window).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

    # rests that the solution places uncut
    rests = made.where("rest > 0").select(*keys, "doc_tokens", "rest", "rest_crc", F.ceil(F.col("rest") / BIN).cast("long").alias("bin"))
    counts, tokens = np.zeros(window // BIN, np.int64), np.zeros(window // BIN, np.int64)
    for b, n, total in rests.groupBy("bin").agg(F.count(F.lit(1)), F.sum("rest")).collect():
        counts[b - 1], tokens[b - 1] = n, total
    columns, repeats = plan(counts, tokens, window)
    ranked = running(rests, "rank", F.lit(1).cast("long"), hash_bucket(keys, n_docs), [*keys, "doc_tokens"], ["bin"])
    placed = written(_assigned(ranked, _ranges(columns, repeats)), "packed")
    solved = placed.where("sequence IS NOT NULL")
    first = n_whole
    inside = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    uncut = solved.select(
        *by,
        (F.col("doc_tokens") - F.col("rest")).alias("start"),
        F.col("rest").alias("length"),
        F.col("rest_crc").alias("ids_crc32"),
        "doc_tokens",
        (F.col("sequence") + first).alias("sequence_id"),
        F.coalesce(F.sum("rest").over(inside), F.lit(0)).alias("offset"),
    )

    # the residual stream
    fills = solved.groupBy("sequence").agg(F.sum("rest").alias("filled")).where(F.col("filled") < window)
    gaps = running(fills, "lo", F.lit(window) - F.col("filled"), F.floor(F.col("sequence") / 4_000), ["sequence"])
    gaps = gaps.select((F.col("sequence") + first).alias("sequence_id"), "filled", "lo", (F.col("lo") + window - F.col("filled")).alias("hi"))
    n_gap = fills.agg(F.coalesce(F.sum(F.lit(window) - F.col("filled")), F.lit(0))).first()[0]
    residual = placed.where("sequence IS NULL").select(*keys, "doc_tokens", "rest")
    n_rest = residual.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    stream = running(residual, "lo", F.col("rest"), hash_bucket(keys, n_docs), [*keys, "doc_tokens"]).withColumn("hi", F.col("lo") + F.col("rest"))
    pieces = _into_gaps(stream, gaps, keys, n_gap, window).unionByName(
        _into_windows(stream, keys, n_gap, n_rest, first + int(repeats.sum()), window)
    )
    return whole.unionByName(uncut).unionByName(_checksums(pieces, docs, by, text, path))


def _cut(lo, hi, offset):
    """Columns of the part [lo, hi) of the stream within its document and its sequence."""
    return [
        (F.col("doc_tokens") - F.col("rest") + lo - F.col("lo")).alias("start"),
        (hi - lo).alias("length"),
        offset.cast("long").alias("offset"),
    ]


def _into_gaps(stream: DataFrame, gaps: DataFrame, keys: list[str], n_gap: int, window: int) -> DataFrame:
    """Pieces of the stream's first `n_gap` tokens; both sides meet by blocks of the stream."""

    def blocks(lo, hi):
        return F.explode(F.sequence(F.floor(F.col(lo) / window), F.floor((F.col(hi) - 1) / window))).alias("block")

    left = stream.where(F.col("lo") < n_gap).select("*", blocks("lo", "hi"))
    right = gaps.select("sequence_id", "filled", F.col("lo").alias("gap_lo"), F.col("hi").alias("gap_hi"))
    right = right.select("*", blocks("gap_lo", "gap_hi"))
    lo, hi = F.greatest("lo", "gap_lo"), F.least("hi", "gap_hi")
    return (
        left.join(right, "block")
        # a pair that meets in several blocks counts in the one where its overlap begins
        .where((lo < hi) & (F.floor(lo / window) == F.col("block")))
        .select(*keys, "doc_tokens", "sequence_id", *_cut(lo, hi, F.col("filled") + lo - F.col("gap_lo")))
    )


def _into_windows(stream: DataFrame, keys: list[str], n_gap: int, n_rest: int, first: int, window: int) -> DataFrame:
    """Pieces of the rest of the stream: windows in a row, then powers of two."""
    total = max(0, n_rest - n_gap)
    full = total // window
    ends = [(n_gap + full * window + s, n_gap + full * window + s + n, first + full + i) for i, (s, n) in enumerate(tail_windows(total % window))]
    left = stream.where(F.col("hi") > n_gap).withColumn("at", F.greatest("lo", F.lit(n_gap)))
    wide = F.transform(
        F.sequence(F.floor((F.col("at") - n_gap) / window), F.floor((F.col("hi") - 1 - n_gap) / window)),
        lambda i: F.struct((i * window + n_gap).alias("a"), F.least((i + 1) * window + n_gap, F.lit(n_gap + full * window)).alias("b"), (i + first).alias("s")),
    )
    spans = wide
    if ends:
        # the few documents that reach into the powers of two see those as well
        tail = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(s).cast("long").alias("s")) for a, b, s in ends])
        spans = F.when(F.col("hi") > n_gap + full * window, F.concat(wide, tail)).otherwise(wide)
    lo, hi = F.greatest("at", "w.a"), F.least("hi", "w.b")
    return (
        left.select("*", F.explode(spans).alias("w"))
        .where(lo < hi)
        .select(*keys, "doc_tokens", F.col("w.s").alias("sequence_id"), *_cut(lo, hi, lo - F.col("w.a")))
    )


def _checksums(pieces: DataFrame, docs: DataFrame, by: list[str], text: str, path: str) -> DataFrame:
    """Checksums of pieces that are cut anywhere: their documents are tokenized once more."""
    keys = [*by, "text_hash"]
    wanted = pieces.groupBy(*keys, "doc_tokens").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    wanted = wanted.withColumnsRenamed({k: f"_{k}" for k in keys})
    texts = docs.withColumn("text_hash", F.xxhash64(text))
    same = texts["text_hash"] == wanted["_text_hash"]
    for k in by:
        same = same & texts[k].eqNullSafe(wanted[f"_{k}"])
    # rows that repeat have their pieces in one list: one copy of the text is enough
    found = texts.join(wanted, same).dropDuplicates(keys).select(*[texts[k] for k in by], "doc_tokens", "pieces", F.col(text).alias("_text"))
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([*(docs.schema[k] for k in by), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches):
        for batch in batches:
            owner, out = [], []
            tokens, wanted, text = (batch.column(len(by) + i) for i in range(3))
            for x, ids in enumerate(_ids(path, text)):
                for p in wanted[x].as_py():
                    owner.append(x)
                    crc = zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])
                    out.append((p["start"], p["length"], crc, tokens[x].as_py(), p["sequence_id"], p["offset"]))
            keys = [c.take(pa.array(owner, pa.int64())) for c in batch.columns[: len(by)]]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array([r[i] for r in out], pa.int64()) for i in range(6))], names=schema.names)

    return found.mapInArrow(lean(run), schema)
