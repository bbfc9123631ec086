"""Lists of names to leave out of an inventory."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.functions.hashes import hash_test
from tallyhouse.functions.paths import contains_any
from tallyhouse.session import written

#: Bytes of a pattern that its index looks at.
GRAM = 16
#: The bitmap of the grams holds 2 to the power of so many bits at most; more grams let more runs pass, none less.
MOST_BITS = 28
_BLANK = r"[\s\x{0B}\x{85}\p{Z}]"


def read_ignore_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, line) of ignore files; each file is small and read whole."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"))
    return split_lines(texts, "source", "value")


def split_lines(texts: DataFrame, source: str, text: str) -> DataFrame:
    """(source, line_no, line) of any text column."""
    lines = F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")
    return texts.select(F.col(source).alias("source"), lines)


def ignore_patterns(lines: DataFrame) -> DataFrame:
    """Distinct usable patterns and where each was first given, as (pattern, source, line_no).

    Blank lines, comments, and lines with `*`, `?` or a leading `!` are dropped.
    """
    trimmed = F.regexp_replace("line", f"^{_BLANK}+|{_BLANK}+$", "")
    pattern = F.col("pattern")
    usable = (pattern != "") & ~F.substring(pattern, 1, 1).isin("#", "!") & ~contains_any(pattern, "*?")
    return (
        lines.select("source", "line_no", trimmed.alias("pattern"))
        .where(usable)
        .groupBy("pattern")
        .agg(F.min(F.struct("source", "line_no")).alias("first"))
        .select("pattern", "first.source", "first.line_no")
    )


def ignore_filter(files: DataFrame, patterns=(), defaults: bool = True, subtrees: bool = False, root: str = "") -> DataFrame:
    """Entries whose name holds none of `patterns`, nor of the default ones, as a substring.

    With `subtrees` an ignored directory takes all below it along: a pattern
    without a slash that is in the path below `root` is in the name of the entry
    or of a directory above.  The patterns are a short list on the driver, so the
    test is one column and needs no join; `ignore_by_table` takes a table of them.
    """
    unwanted = [*(S.DEFAULT_IGNORES if defaults else ()), *patterns]
    tested = F.substr("path", F.lit(len(root.rstrip("/")) + 1)) if subtrees else F.col("name")
    return files.where(~contains_any(tested, unwanted)) if unwanted else files


def ignore_by_table(files: DataFrame, patterns: DataFrame, subtrees: bool = False, root: str = "") -> DataFrame:
    """Entries whose name holds none of the texts in `pattern` of `patterns`, a table of any size.

    A name holds a pattern only if it holds the pattern's gram: the pattern itself
    up to GRAM bytes, else the run of so many bytes of it that the fewest patterns
    have.  So a name is compared with patterns it holds, and with longer ones of a
    gram that it holds.  The runs of the distinct names first pass a bitmap of the
    grams, so that few are shuffled, then meet the grams in an equi-join that also
    tests the whole pattern.  The names found are written to a working folder and
    taken out by an anti join, which only the entries whose name passes a bitmap of
    them go through; the others stay where they are.  NULL and empty patterns
    exclude nothing, an entry without a name stays.  `subtrees` and `root` are those
    of `ignore_filter`.
    """
    tested = F.substr("path", F.lit(len(root.rstrip("/")) + 1)) if subtrees else F.col("name")
    index = pattern_index(patterns)
    # at most GRAM rows
    counts = {r[0]: r[1] for r in index.groupBy(F.length("gram")).count().collect()}
    if not counts:
        return files
    names = files.select(tested.alias("_tested")).where("_tested IS NOT NULL").distinct()
    held = _held(names, sorted(counts), _bitmap(index, sorted(counts), sum(counts.values())))
    holds = (F.col("_gram") == F.col("gram")) & F.contains(F.col("_tested").cast("binary"), F.col("pattern"))
    unwanted = written(held.join(index, holds, "left_semi").select("_tested").distinct(), "unwanted")
    n = unwanted.count()
    if not n:
        return files
    doubtful = tested.isNotNull() & hash_test(unwanted, n)(tested)
    kept = files.where(doubtful).join(unwanted, tested == F.col("_tested"), "left_anti")
    return files.where(~doubtful).unionByName(kept)


def pattern_index(patterns: DataFrame) -> DataFrame:
    """(gram, pattern) in UTF-8: each distinct pattern under itself, a long one under its gram that is rarest among
    those of long patterns, ties by the smaller gram."""
    distinct = patterns.where("pattern <> ''").select(F.col("pattern").cast("binary").alias("pattern")).distinct()
    spread = distinct.where(F.length("pattern") > GRAM).select("pattern", F.explode(F.array_distinct(grams("pattern", GRAM))).alias("gram"))
    common = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = spread.join(common, "gram").groupBy("pattern").agg(F.min(F.struct("n", "gram")).alias("best")).select("best.gram", "pattern")
    return rarest.unionByName(distinct.where(F.length("pattern") <= GRAM).select(F.col("pattern").alias("gram"), "pattern"))


def grams(text: str, length: int) -> Column:
    """All runs of `length` bytes of a binary column that is at least as long, repeats included."""
    last = F.length(text) - length + 1
    return F.transform(F.sequence(F.lit(1), last), lambda at: F.substring(F.col(text), at, F.lit(length)))


def _runs(texts: pa.Array, lengths: list[int]):
    """(length, first byte, text, two hashes) of all runs of each length; bytes and texts count from 0."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at, text = np.arange(len(data)), np.repeat(np.arange(len(texts)), np.diff(offsets))
    end, mixed = (offsets[1:] - offsets[0])[text], np.zeros(len(data), np.uint64)
    for length in range(1, lengths[-1] + 1):
        fits = at + length <= end
        at, text, end, mixed = at[fits], text[fits], end[fits], mixed[fits]
        mixed = mixed * np.uint64(0x100000001B3) + data[at + length - 1] + np.uint64(1)
        if length in lengths:
            one = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            yield length, at, text, (one, (one ^ (one >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))


def _bitmap(index: DataFrame, lengths: list[int], n: int) -> np.ndarray:
    """Bits, eight in a byte and a power of two of them, of which each gram sets two."""
    bits = min(max((64 * n).bit_length(), 15), MOST_BITS)

    def run(batches):
        for batch in batches:
            size = pc.binary_length(batch.column(0)).to_numpy()
            start = np.cumsum(size) - size
            for length, at, text, hashes in _runs(batch.column(0), lengths):
                whole = (at == start[text]) & (size[text] == length)
                for mixed in hashes:
                    yield pa.RecordBatch.from_arrays([pa.array((mixed[whole] >> np.uint64(64 - bits)).astype(np.int64))], names=["bit"])

    places = index.select("gram").mapInArrow(run, "bit long")
    parts = places.groupBy(F.expr("bit DIV 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    out = np.zeros(1 << bits - 3, np.uint8)
    # 4 KB for each part, 32 MB in all at most
    for r in parts.toLocalIterator():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _held(names: DataFrame, lengths: list[int], bitmap: np.ndarray) -> DataFrame:
    """(_tested, _gram): the runs of names that may be grams."""
    kept = names.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bitmap, shift = kept.value, np.uint64(61 - (len(kept.value).bit_length() - 1))

        def may_be(mixed):
            place = mixed >> shift
            return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for batch in batches:
            texts, values = batch.column(1), batch.column(1).to_pylist()
            size = pc.binary_length(texts).to_numpy()
            start = np.cumsum(size) - size
            for length, at, text, (one, two) in _runs(texts, lengths):
                found = np.flatnonzero(may_be(one))
                found = found[may_be(two[found])]
                if len(found):
                    text, first = text[found], at[found] - start[text[found]]
                    runs = [values[t][f : f + length] for t, f in zip(text.tolist(), first.tolist())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(runs, pa.binary())], names=["_tested", "_gram"])

    return names.select("_tested", F.col("_tested").cast("binary").alias("_bytes")).mapInArrow(run, "_tested string, _gram binary")
