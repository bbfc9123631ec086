"""Jaccard self-join of texts on word n-grams by a MinHash LSH forest, verified exactly.

Each distinct text has a label in each tree of the forest, its minima one after another,
so that labels in order are a trie.  All texts meet first where whole labels are equal.
Texts that meet are compared by their whole sets of n-grams, and the links found, each
weighted by the probability of meeting at its similarity, tell how many were missed.  A
text whose recall reaches the target stops there; the others shorten their prefixes in
all trees at once and meet every text below them, until the length at which a pair at
the threshold itself meets with the target probability.  (To shorten tree by tree, where
fewest texts are met, is no way: those are the trees without the partner.)

A pair is looked at once, in the first round and tree where it meets.  A large run of
texts is cut into blocks whose pairs go to tasks of their own.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tables import give_back, lean
from tallyhouse.session import written

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 6
RECALL = 0.9997
#: Texts and bytes of one side of a comparison, and of one call, about.
BLOCK = 512
BLOCK_BYTES = 8 << 20
GROUP_ROWS = 1500
GROUP_BYTES = 16 << 20
BROADCAST_BYTES = 32 << 20
#: Words remembered by a worker.
REMEMBERED = 100_000
_WORD = re.compile(r"\w+")


def meets(similarity, length: int, trees: int = TREES):
    """The probability that two texts share a prefix of `length` in some tree."""
    return 1 - (1 - similarity**length) ** trees


def prefix_lengths(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> list[int]:
    """The whole label, then two minima less each round, to where a pair at the threshold meets with probability `recall`."""
    last = depth
    while last > 1 and meets(threshold, last, trees) < recall:
        last -= 1
    return [*range(depth, last, -2), last]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, known: dict, size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `size` lower-case words of a whole text.

    A shorter text is one run of all its words; a text without words has none.
    """
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(total)]
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ (total >> np.uint64(29)))


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def labels(found: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[bytes]:
    """The label in each tree: `depth` minima, two bytes each; a prefix of a label is one of the minima."""
    a, b = _factors(trees * depth)
    low = np.full(trees * depth, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 4096):
        part = found[start : start + 4096]
        low = np.minimum(low, (a[:, None] * (part ^ (part >> np.uint64(31)))[None, :] + b[:, None]).min(axis=1))
    # the top bits of a minimum are small, the low ones of its product are not random enough
    low = (low ^ (low >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    packed = (low >> np.uint64(48)).astype(">u2").tobytes()
    return [packed[i : i + 2 * depth] for i in range(0, len(packed), 2 * depth)]


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, through the hashes that at least two sets have."""
    sizes = [len(s) for s in sets]
    kinds, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times[where] > 1
    column, owner = (np.cumsum(times > 1) - 1)[where[shared]], owner[shared]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, n, 4096):
        lo, hi = np.searchsorted(column, (start, start + 4096))
        part = np.zeros((len(sets), min(4096, n - start)), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        out += part @ part.T
    return out


def _places(marks: np.ndarray, length: int) -> np.ndarray:
    """Numbers by text and tree that are equal where prefixes of `length` are."""
    part = np.ascontiguousarray(marks[:, :, :length]).view(f"V{2 * length}")[:, :, 0]
    return np.unique(part, return_inverse=True)[1].reshape(part.shape)


def compare(sets, marks, active, side, tree, lengths, threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each text, links it missed by estimate, index of its component's first text) within one comparison.

    `marks` are the labels by text, tree and minimum; `lengths` the prefix lengths so far.
    Pairs that met before, or of two texts that have stopped, are left out.  `side` tells
    the two blocks apart, or is all zero when a block is compared with itself.
    """
    sizes = np.array([len(s) for s in sets], np.float64)
    both = _common(sets)
    i, j = np.nonzero(np.triu(both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6, 1))
    ok = (both[i, j] > 0) & ((side[i] != side[j]) | (side.max() == 0)) & (active[i] | active[j])
    now = _places(marks, lengths[-1])
    for earlier in range(tree):
        ok &= now[i, earlier] != now[j, earlier]
    if len(lengths) > 1:
        before = _places(marks, lengths[-2])
        for other in range(before.shape[1]):
            ok &= before[i, other] != before[j, other]
    i, j = i[ok], j[ok]
    similar = both[i, j] / (sizes[i] + sizes[j] - both[i, j])
    missed = 1 / meets(similar, lengths[-1], marks.shape[1]) - 1
    n = len(sets)
    links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    unseen = np.bincount(i, missed, n) + np.bincount(j, missed, n)
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return links, unseen, root
        root = new


def _compare_group(table: pa.Table, lengths: list[int], threshold: float) -> pa.Table:
    """All comparisons of one group of rows: node, another node linked to it or itself, links, estimate of missed ones."""
    place = [table.column(c).to_numpy() for c in ("key", "tree", "low", "high")]
    order = np.lexsort(place[::-1])
    place = [p[order] for p in place]
    edge = np.r_[True, np.any([p[1:] != p[:-1] for p in place], axis=0), True]
    starts = np.flatnonzero(edge)
    node, block, active = table.column("node").to_pylist(), table.column("block").to_numpy(), table.column("active").to_numpy()
    found, labels_of = table.column("found").to_pylist(), table.column("labels").to_pylist()
    out = ([], [], [], [])
    for a, b in zip(starts, starts[1:]):
        at = order[a:b]
        sets = [np.frombuffer(found[x], np.uint64) for x in at]
        marks = np.frombuffer(b"".join(m for x in at for m in labels_of[x]), np.uint16).reshape(len(at), TREES, DEPTH)
        side = (block[at] != place[2][a]).astype(np.int8)
        links, unseen, root = compare(sets, marks, active[at], side, int(place[1][a]), lengths, threshold)
        for x in np.flatnonzero(links):
            out[0].append(node[at[x]])
            out[1].append(node[at[root[x]]])
            out[2].append(int(links[x]))
            out[3].append(float(unseen[x]))
    del found, labels_of
    give_back()
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.float64())
    return pa.table([pa.array(values, kind) for values, kind in zip(out, kinds)], names=["node", "other", "links", "unseen"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (node, other) is connected with.

    Each round takes the least label among the neighbours and then follows the labels
    once; rounds are written down, so that a lost executor costs one round at most.
    """
    both = edges.select("node", "other").unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other", "root": "near"}), "other").groupBy("node").agg(F.min("near").alias("near"))
        moved = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = moved.select(F.col("node").alias("low"), F.col("low").alias("next"))
        moved = moved.join(jump, "low").select("node", F.least("low", "next").alias("new"), "root")
        moved = written(moved, "labels")
        labels = moved.select("node", F.col("new").alias("root"))
        if moved.where("new <> root").limit(1).count() == 0:
            return labels


def _small(frame: DataFrame, rows: int, width: int) -> DataFrame:
    """Broadcast if its known size allows; otherwise joined by shuffling, which AQE splits where a key is hot."""
    return F.broadcast(frame) if rows * width <= BROADCAST_BYTES else frame


def _blocks(n, hashes):
    """Into how many blocks so many texts with so many n-grams are cut."""
    return F.ceil(F.greatest(n / BLOCK, hashes * 8 / BLOCK_BYTES)).cast("int")


def _members(trie: DataFrame, stopped: DataFrame | None, lengths: list[int]) -> DataFrame:
    """(tree, key, node, active, size, blocks, active_blocks): the runs to compare at the last of `lengths`.

    Left out are runs without an active text, those that a longer prefix had already, and
    equal sets of texts but for their first tree.
    """

    def key(length):
        return F.xxhash64(F.substring("label", 1, 2 * length))

    rows = trie.select("node", "size", "tree", key(lengths[-1]).alias("key"), *([key(lengths[-2]).alias("before")] if lengths[1:] else []))
    if stopped is None:
        rows = rows.withColumn("active", F.lit(True))
    else:
        rows = rows.join(stopped.withColumn("stopped", F.lit(True)), "node", "left").withColumn("active", F.col("stopped").isNull()).drop("stopped")
    mark = F.xxhash64("node")
    active_size = F.when(F.col("active"), F.col("size"))
    runs = rows.groupBy("tree", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("hashes"),
        F.count(active_size).alias("n_active"),
        F.coalesce(F.sum(active_size), F.lit(0)).alias("active_hashes"),
        F.bit_xor(mark).alias("mix"),
        F.sum(mark.cast("decimal(20)")).alias("sum"),
        *([(F.min("before") < F.max("before")).alias("grown")] if lengths[1:] else [F.lit(True).alias("grown")]),
    )
    runs = runs.where("n > 1 AND n_active > 0 AND grown")
    same = ("n", "hashes", "n_active", "active_hashes")
    runs = runs.groupBy(*same, "mix", "sum").agg(F.min(F.struct("tree", "key")).alias("first")).select("first.tree", "first.key", *same)
    whole = (F.col("n") <= BLOCK) & (F.col("hashes") * 8 <= BLOCK_BYTES)
    rest = _blocks(F.col("n") - F.col("n_active"), F.col("hashes") - F.col("active_hashes"))
    cut = _blocks(F.col("n_active"), F.col("active_hashes"))
    runs = runs.select(
        "tree", "key", F.when(whole, 0).otherwise(rest).alias("rest_blocks"), F.when(whole, 1).otherwise(cut).alias("active_blocks"), whole.alias("whole")
    )
    return rows.drop("before").join(runs, ["tree", "key"])


def join_texts(docs: DataFrame, by: str, text: str = "text", threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """Per row of `docs`: `by`, class_id, n_links, n_copies, keeper, twins.

    Two texts are linked if the Jaccard similarity of their sets of `size`-word runs
    (lower-case runs of letters, digits and underscores) is at least `threshold`; texts
    are in a class if a chain of links or equality connects them.  class_id is the
    smallest `by` of the class (null only if it has no other).  n_links is the number
    of other texts linked to the row's text, copies counting once; n_copies the rows
    with exactly its text.  keeper marks the row that stands for its class; it is one
    row unless the same `by` and text occur `twins` times.  A null text equals an empty
    one; texts without words equal only their own copies; an empty table stays empty.
    """
    node = F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("node")

    def sign(batches):
        known = _Hashes()
        for batch in batches:
            sizes, made = [], []
            for value in batch.column("text"):
                found = shingles(value.as_py(), known, size)
                sizes.append(len(found))
                made.append(labels(found) if len(found) else None)
            yield pa.record_batch([batch.column("node"), pa.array(sizes, pa.int64()), pa.array(made, pa.list_(pa.binary()))], ["node", "size", "labels"])

    signed = docs.select(node, F.col(text).alias("text")).mapInArrow(lean(sign), "node binary, size long, labels array<binary>")
    signed = written(signed.where("labels IS NOT NULL").dropDuplicates(["node"]), "signatures")

    # only prefixes that two texts share at the end take part
    lengths = prefix_lengths(threshold)
    rows = signed.select("node", "size", F.posexplode("labels").alias("tree", "label"))
    rows = rows.withColumn("key", F.xxhash64("tree", F.substring("label", 1, 2 * lengths[-1])))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    trie = written(rows.join(shared, "key").select("node", "size", "tree", "label"), "trie")

    def collect(batches):
        known = _Hashes()
        for batch in batches:
            found = [shingles(value.as_py(), known, size).tobytes() for value in batch.column("text")]
            yield pa.record_batch([batch.column("node"), pa.array(found, pa.binary())], ["node", "found"])

    def compare_round(met, so_far):
        candidates = written(met.select("node").distinct(), "candidates")
        chosen = docs.select(node, F.col(text).alias("text")).join(_small(candidates, candidates.count(), 64), "node", "left_semi")
        sets = chosen.mapInArrow(lean(collect), "node binary, found binary").dropDuplicates(["node"]).join(signed.select("node", "labels"), "node")
        mark = F.xxhash64("node", F.lit(5))
        block = F.when(F.col("whole"), 0).when(F.col("active"), F.pmod(mark, F.col("active_blocks")))
        block = block.otherwise(F.col("active_blocks") + F.pmod(mark, F.greatest("rest_blocks", F.lit(1)))).cast("int")
        # stopped texts are compared with active ones only
        met = met.withColumns({"block": block, "others": F.col("active_blocks") + F.when(F.col("active"), F.col("rest_blocks")).otherwise(0)})
        total = met.agg(F.coalesce(F.sum("others"), F.lit(0)), F.coalesce(F.sum(F.col("others") * F.col("size") * 8), F.lit(0))).first()
        n_groups = max(1, -(-total[0] // GROUP_ROWS), -(-total[1] // GROUP_BYTES))
        met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("with"))
        met = met.select("tree", "key", "node", "active", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
        group = F.pmod(F.xxhash64("tree", "key", "low", "high"), F.lit(n_groups))
        compared = met.join(sets, "node").groupBy(group)
        return compared.applyInArrow(lambda part: _compare_group(part, so_far, threshold), "node binary, other binary, links long, unseen double")

    compared = stopped = None
    for i in range(len(lengths)):
        met = written(_members(trie, stopped, lengths[: i + 1]), "met")
        links = written(compare_round(met, lengths[: i + 1]), "links")
        compared = links if compared is None else compared.unionByName(links)
        if i + 1 < len(lengths):
            reached = compared.groupBy("node").agg(F.sum("links").alias("links"), F.sum("unseen").alias("unseen"))
            reached = reached.where(F.col("links") >= RECALL * (F.col("links") + F.col("unseen"))).select("node")
            stopped = written(reached if stopped is None else reached.unionByName(stopped).distinct(), "stopped")

    classes = components(compared.where("node <> other"))
    links = compared.groupBy("node").agg(F.sum("links").alias("n_links"))
    ids = docs.select(F.col(by).alias("id"), node).groupBy("node", "id").agg(F.count(F.lit(1)).alias("twins"))
    best = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("node"), F.col("twins")))
    texts = ids.groupBy("node").agg(best.alias("best"), F.sum("twins").alias("n_copies"))
    texts = texts.join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = texts.groupBy("root").agg(F.min("best").alias("first"))
    texts = written(
        texts.where("n_links IS NOT NULL OR n_copies > 1")
        .join(first, "root")
        .select("node", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"),
        "classes",
    )
    known = _small(texts.withColumnRenamed("node", "_node"), texts.count(), 120)
    found = docs.select(F.col(by), node).join(known, F.col("node") == F.col("_node"), "left")
    keeper = (F.col("node") == F.col("first.node")) & F.col(by).eqNullSafe(F.col("first.id"))
    return found.select(
        by,
        F.when(F.col("_node").isNull(), F.col(by)).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.when(F.col("_node").isNull(), F.lit(True)).otherwise(keeper).alias("keeper"),
        F.coalesce("first.twins", F.lit(1)).alias("twins"),
        "node",
    )
