"""Dropping lines that many documents share, by probing sharded minimal perfect hashes.

Lines are counted by a 128-bit hash of their key.  The keys that reach the limit go into
shards; each shard is a minimal perfect hash (levels of bit arrays: at each level the
keys that hit a bit alone settle there, the others go on) whose value, the rank of the
bit, indexes an array of fingerprints and an array of counts.  Documents look their
lines up in these arrays; no line is joined with another.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.tables import answered, ascii_lower, strip_blank, unused
from tallyhouse.session import written

#: Keys in a shard, about; also the bound on what one task builds.
SHARD_KEYS = 50_000
#: The shards are broadcast together up to this size, and probed shard by shard beyond it.
BROADCAST_BYTES = 32 << 20
#: Lookups that one task takes when shards are probed one by one, about.
PROBE_ROWS = 500_000
#: Bits per key at each level.
GAMMA = 2.0


def line_key(line: Column) -> Column:
    return strip_blank(ascii_lower(line))


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_shard(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> dict:
    """Arrays of one shard: bit words and start of each level, and per rank fingerprint and count.

    `keys` are distinct 64-bit numbers.
    """
    levels, left = [], np.arange(len(keys))
    order = []
    while len(left):
        size = max(64, int(-(-GAMMA * len(left) // 64) * 64))
        at = (_mix(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        order.append(left[settled][np.argsort(at[settled])])
        levels.append(alone)
        left = left[~settled]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return {
        "sizes": np.array([len(x) for x in levels], np.int64),
        "bits": np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool), bitorder="little"),
        "prints": prints[order],
        "counts": counts[order],
    }


class Shard:
    """Lookup in the arrays of `build_shard`."""

    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes):
        self.sizes = np.frombuffer(sizes, np.int64)
        self.bits = np.frombuffer(bits, np.uint8)
        self.prints = np.frombuffer(prints, np.uint64)
        self.counts = np.frombuffer(counts, np.int64)
        # bits set before each byte
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The stored count of each (key, fingerprint), 0 where there is none."""
        out = np.zeros(len(keys), np.int64)
        todo, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = start + (_mix(keys[todo], level) % np.uint64(size)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> bit) & 1 == 1
            found, byte, bit = todo[hit], byte[hit], bit[hit]
            below = np.bitwise_count(self.bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            rank = self.before[byte] + below
            same = self.prints[rank] == prints[found]
            out[found[same]] = self.counts[rank[same]]
            todo, start = todo[~hit], start + int(size)
        return out


def line_counts(docs: DataFrame, text: str, min_docs: int) -> DataFrame:
    """(key, print, n): hashes of the keys found in at least `min_docs` rows."""
    keys = F.array_distinct(F.transform(F.split(text, "\n"), line_key))
    return (
        docs.select(F.explode(keys).alias("line"))
        .where(F.length("line") > 0)
        .groupBy(F.xxhash64("line").alias("key"), F.xxhash64("line", F.lit(1)).alias("print"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs)
    )


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row of arrays for each shard of the keys in `counts`."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        # two lines may share the 64-bit key; the later ones go to `extra` as plain triples
        first = ~rows["key"].duplicated().to_numpy()
        made = build_shard(
            rows["key"].to_numpy()[first].view(np.uint64),
            rows["print"].to_numpy()[first].view(np.uint64),
            rows["n"].to_numpy()[first],
        )
        rest = rows.loc[~first, ["key", "print", "n"]].to_numpy(np.int64).tobytes()
        return pd.DataFrame([[int(rows["shard"].iloc[0]), *(made[k].tobytes() for k in ("sizes", "bits", "prints", "counts")), rest]])

    shard = F.pmod("key", F.lit(shards)).cast("int").alias("shard")
    return (
        counts.select(shard, "key", "print", "n")
        .groupBy("shard")
        .applyInPandas(build, "shard int, sizes binary, bits binary, prints binary, counts binary, extra binary")
    )


class Index:
    """All shards, or some of them, looked up together."""

    def __init__(self, shards: int, rows):
        self.n, self.shards, self.extra = shards, {}, {}
        for row in rows:
            self.shards[row[0]] = Shard(*(bytes(x) for x in row[1:5]))
            for key, print_, n in np.frombuffer(bytes(row[5]), np.int64).reshape(-1, 3):
                self.extra[int(key), int(print_)] = int(n)

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """`keys` and `prints` as signed 64-bit numbers."""
        out = np.zeros(len(keys), np.int64)
        shard = keys % self.n
        for s in np.unique(shard):
            if int(s) in self.shards:
                at = np.flatnonzero(shard == s)
                out[at] = self.shards[int(s)].count(keys[at].view(np.uint64), prints[at].view(np.uint64))
        if self.extra:
            for i, pair in enumerate(zip(keys.tolist(), prints.tolist())):
                out[i] = self.extra.get(pair, out[i])
        return out


def dedup_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`docs` with shared lines dropped from `text`, and `n_lines`, `n_dropped`.

    Texts split at line feeds.  A line's key is the line without blanks at its ends,
    with A to Z lower-cased.  Keys of at least one code point that occur in at least
    `min_docs` rows lose all their lines in every row; a row counts once however often
    it repeats the line.  The lines that stay are joined by line feeds, unchanged.  A
    null text is one empty line and becomes an empty text; an empty table stays empty;
    rows that repeat are rows of their own; other columns pass through, and columns
    named n_lines and n_dropped are replaced.

    The index holds about 16 bytes for each shared key.  Up to `broadcast_bytes` it is
    broadcast.  Beyond that, distinct lookups meet their shard in tasks of bounded
    size; the results are the same.
    """
    docs = docs.drop("n_lines", "n_dropped").withColumn(text, F.coalesce(text, F.lit("")))
    counts = written(line_counts(docs, text, min_docs), "line-counts")
    n_keys = counts.count()
    shards = max(1, -(-n_keys // SHARD_KEYS))
    index = build_index(counts, shards)
    if n_keys * 24 <= broadcast_bytes:
        held = docs.sparkSession.sparkContext.broadcast((shards, [tuple(r) for r in index.collect()]))
        return _probe_broadcast(docs, text, held)
    return _probe_shards(docs, text, written(index, "line-index"), shards)


def _hashes(text: str) -> list[Column]:
    """Hashes of the keys of all lines; empty keys have some too, which no index holds."""
    keys = F.transform(F.split(text, "\n"), line_key)
    return [F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(k, F.lit(1)))]


def _results(text: str) -> T.StructType:
    return T.StructType().add(text, "string").add("n_lines", "long").add("n_dropped", "long")


def _without(texts: pa.Array, flags: list[np.ndarray]) -> tuple:
    """(texts without the lines flagged, lines, lines dropped), `flags` being one array per text."""
    gone = [int(f.sum()) for f in flags]
    if any(gone):
        texts = [
            "\n".join(x for x, d in zip(t.as_py().split("\n"), f) if not d) if n else t.as_py() for t, f, n in zip(texts, flags, gone)
        ]
    return texts, [len(f) for f in flags], gone


def _probe_broadcast(docs: DataFrame, text: str, held) -> DataFrame:
    at = docs.columns.index(text)

    def start():
        index = Index(*held.value)

        def work(batch):
            keys, prints = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            n = index.count(keys.flatten().to_numpy(), prints.flatten().to_numpy())
            return _without(batch.column(at), np.split(n > 0, np.cumsum(keys.value_lengths().to_numpy())[:-1]) if len(keys) else [])

        return work

    names = [unused(f"__hash{i}", docs.columns) for i in range(2)]
    hashed = docs.withColumns(dict(zip(names, _hashes(text))))
    return answered(hashed, _results(text), start, drop=2)


def _probe_shards(docs: DataFrame, text: str, index: DataFrame, shards: int) -> DataFrame:
    """Lookups go to their shard; a shard with many is copied to several tasks."""
    at, row, lost = docs.columns.index(text), unused("__row", docs.columns), unused("__gone", docs.columns)
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hashed = docs.select(F.col(row).alias("row"), F.arrays_zip(*(c.alias(n) for n, c in zip(("key", "print"), _hashes(text)))).alias("lines"))
    lookups = (
        hashed.select("row", F.posexplode("lines").alias("pos", "line"))
        .select("row", "pos", "line.key", "line.print")
        .withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    )
    copies = lookups.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PROBE_ROWS).cast("int").alias("copies"))
    left = lookups.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("row", "pos"), F.col("copies")).cast("int"))
    right = index.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def find(asked: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(arrays):
            return pd.DataFrame({"row": [], "pos": []}, dtype="int64")
        held = Index(shards, arrays[["shard", "sizes", "bits", "prints", "counts", "extra"]].itertuples(index=False))
        return asked.loc[held.count(asked["key"].to_numpy(), asked["print"].to_numpy()) > 0, ["row", "pos"]]

    by = ["shard", "copy"]
    hits = left.drop("copies").groupBy(*by).cogroup(right.drop("copies").groupBy(*by)).applyInPandas(find, "row long, pos int")
    gone = hits.groupBy(F.col("row").alias(row)).agg(F.collect_list("pos").alias(lost))

    def start():
        def work(batch):
            flags = []
            for value, gone in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                flag = np.zeros(value.as_py().count("\n") + 1, bool)
                flag[gone.as_py() or []] = True
                flags.append(flag)
            return _without(batch.column(at), flags)

        return work

    names = [c for c in docs.columns if c != row]
    return answered(docs.join(gone, row, "left").select(*(F.col(f"`{c}`") for c in names), lost), _results(text), start, drop=1)
