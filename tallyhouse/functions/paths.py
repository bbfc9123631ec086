"""Columns read off a `/`-separated path."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def base_name(path: Column | str) -> Column:
    """Text after the last `/`."""
    return F.substring_index(_col(path), "/", -1)


def parent_dir(path: Column | str) -> Column:
    """The path without its last segment.

    Equals `regexp_replace(path, '/[^/]+$', '')`, written with substrings so
    that the hottest expression of the package stays off the regex engine.
    """
    path = _col(path)
    tail = base_name(path)
    whole = (tail == "") | (tail == path)
    return F.when(whole, path).otherwise(
        F.substring(path, F.lit(1), F.length(path) - F.length(tail) - 1)
    )


def extension(name: Column | str) -> Column:
    """Lower-cased text after the last dot; NULL without one or when it is empty."""
    name = _col(name)
    return F.when(
        F.contains(name, F.lit(".")),
        F.lower(F.nullif(F.substring_index(name, ".", -1), F.lit(""))),
    )


def slash_count(path: Column | str) -> Column:
    return F.size(F.split(_col(path), "/", -1)) - 1


def depth_below(path: Column | str, root: str) -> Column:
    """Distance from `root`, which itself has depth 0."""
    trimmed = F.rtrim(_col(path), F.lit("/"))
    return (slash_count(trimmed) - root.rstrip("/").count("/")).cast("int")


def contains_any(value: Column | str, needles) -> Column:
    """True where `value` holds at least one of a short list of substrings.

    Byte searches, several times as fast as one pattern; meant for a stored
    column, as a computed value would be computed once per needle.
    """
    value = _col(value)
    return reduce(or_, (F.contains(value, F.lit(needle)) for needle in needles), F.lit(False))


def explode_ancestors(df: DataFrame, path: str, into: str, include_self: bool = False) -> DataFrame:
    """One row per ancestor directory of `path`, in column `into`.

    Positions are exploded rather than strings, so each ancestor is cut out by
    a generated projection and no array of prefixes is built per row.  `into`
    may equal `path`.
    """
    cuts = slash_count(path) + (1 if include_self else 0)
    positions = F.when(cuts >= 1, F.sequence(F.lit(1), cuts))
    others = [c for c in df.columns if c not in (path, into)]
    keep = others if into == path else [*others, path]
    return (
        df.select(*dict.fromkeys([*others, path]), F.explode(positions).alias("_cut"))
        .withColumn("_ancestor", F.expr(f"substring_index(`{path}`, '/', _cut)"))
        .where(F.col("_ancestor") != "")
        .select(*keep, F.col("_ancestor").alias(into))
    )
