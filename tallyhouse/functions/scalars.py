"""Sizes, durations, dates and small arithmetic as columns."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.functions.paths import _col

LONG_MAX = 2**63 - 1


def size_of(physical: bool = False) -> Column:
    """Logical size, or allocated size with the logical one where unknown."""
    return F.coalesce("physical_size", "size") if physical else F.col("size")


def rfc3339(seconds: Column | str) -> Column:
    """Unix seconds as `YYYY-MM-DDTHH:MM:SSZ`; does not depend on the session zone."""
    seconds = _col(seconds).cast("long")
    of_day = F.pmod(seconds, F.lit(S.SECONDS_PER_DAY))
    day = F.date_from_unix_date(F.floor((seconds - of_day) / S.SECONDS_PER_DAY).cast("int"))
    clock = F.format_string(
        "%02d:%02d:%02d",
        F.floor(of_day / 3600),
        F.floor(of_day / 60) % 60,
        of_day % 60,
    )
    dated = seconds.between(S.FIRST_DATED_SECOND, S.LAST_DATED_SECOND)
    return F.when(dated, F.concat(day.cast("string"), F.lit("T"), clock, F.lit("Z")))


def _unit_factor(unit: Column, units: dict) -> Column:
    pairs = [part for name, factor in units.items() for part in (F.lit(name), F.lit(factor))]
    return F.element_at(F.create_map(*pairs), unit)


def duration_seconds(text: Column | str) -> Column:
    """`30d`, `2w`, `6mo`, ... in seconds; NULL for anything else."""
    text = F.trim(_col(text))
    shape = r"^([0-9]+)(s|m|h|d|w|mo|y)$"
    count = F.nullif(F.regexp_extract(text, shape, 1), F.lit("")).try_cast("long")
    unit = F.nullif(F.regexp_extract(text, shape, 2), F.lit(""))
    return F.try_multiply(count, _unit_factor(unit, S.DURATION_UNITS).cast("long"))


def seconds_in(text: str) -> int:
    """`duration_seconds` for an argument given on the driver."""
    found = re.fullmatch(r"([0-9]+)(s|m|h|d|w|mo|y)", text.strip())
    if not found:
        raise ValueError(f"not a duration: {text!r} (use s, m, h, d, w, mo or y)")
    return int(found[1]) * S.DURATION_UNITS[found[2]]


def size_bytes(text: Column | str) -> Column:
    """`10`, `5KB`, `2GiB`, ... in bytes, saturating; NULL for anything else."""
    text = F.upper(F.trim(_col(text)))
    shape = r"^([+-]?[0-9]+)\s*(TIB|GIB|MIB|KIB|TB|GB|MB|KB|B|)$"
    count = F.nullif(F.regexp_extract(text, shape, 1), F.lit("")).try_cast("long")
    unit = F.regexp_extract(text, shape, 2)
    factor = _unit_factor(F.when(unit == "", F.lit("B")).otherwise(unit), S.SIZE_UNITS)
    limit = F.when(count < 0, F.lit(-LONG_MAX - 1)).otherwise(F.lit(LONG_MAX))
    return F.when(
        count.isNotNull(), F.coalesce(F.try_multiply(count, factor.cast("long")), limit)
    )


def bytes_in(text: str) -> int | None:
    """`size_bytes` for an argument given on the driver; None when it is no size."""
    found = re.fullmatch(r"([+-]?[0-9]+)\s*([KMGT]?I?B)?", text.strip().upper())
    unit = found and (found[2] or "B")
    if not found or unit not in S.SIZE_UNITS:
        return None
    return max(-LONG_MAX - 1, min(LONG_MAX, int(found[1]) * S.SIZE_UNITS[unit]))


def human_size(size: Column | str) -> Column:
    """Binary-unit text: `0 B`, `16 KiB`, `1.50 MiB`."""
    size = _col(size)
    text = F.lit(None).cast("string")
    for power, unit in enumerate(("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")):
        scaled = size / F.lit(float(1024**power))
        shown = F.when(scaled == F.floor(scaled), F.floor(scaled).cast("string")).otherwise(
            F.format_string("%.2f", F.bround(scaled, 2))
        )
        text = F.when(size >= 1024**power, F.concat(shown, F.lit(f" {unit}"))).otherwise(text)
    return F.when(size < 1, F.concat(size.cast("string"), F.lit(" B"))).otherwise(text)


def truncate_path(path: Column | str, width: int) -> Column:
    """The tail of a long path behind `...`, `width` characters in all."""
    path = _col(path)
    return F.when(F.length(path) <= width, path).otherwise(
        F.concat(F.lit("..."), F.right(path, F.lit(width - 3)))
    )


def snapshot_ts(snapshot_id: Column | str) -> Column:
    """The UTC second named by an id such as `2026-05-15_11-56`, or NULL."""
    stamped = F.concat(_col(snapshot_id), F.lit("Z"))
    return F.unix_timestamp(F.try_to_timestamp(stamped, F.lit("yyyy-MM-dd_HH-mmX")))


def file_stem(path: Column | str) -> Column:
    """File name without its last suffix; a leading dot is part of the stem."""
    name = F.substring_index(F.rtrim(_col(path), F.lit("/")), "/", -1)
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def day_of(seconds: Column | str) -> Column:
    return F.date_from_unix_date(F.floor(_col(seconds) / S.SECONDS_PER_DAY).cast("int"))


#: Retention buckets: the first day of the span a moment falls in (weeks start on Monday).
BUCKETS = {
    "daily": day_of,
    "weekly": lambda seconds: F.trunc(day_of(seconds), "week"),
    "monthly": lambda seconds: F.trunc(day_of(seconds), "month"),
    "yearly": lambda seconds: F.trunc(day_of(seconds), "year"),
}


def file_change_kind(size_a: Column, size_b: Column) -> Column:
    """How one file changed; two empty sides count as `shrank`."""
    return (
        F.when((size_a == 0) & (size_b > 0), "added")
        .when((size_a > 0) & (size_b == 0), "removed")
        .when(size_b > size_a, "grew")
        .otherwise("shrank")
    )


def dir_change_kind(size_a: Column, size_b: Column) -> Column:
    """How one directory's total changed."""
    return (
        F.when(size_a == 0, "added")
        .when(size_b == 0, "removed")
        .when(size_b > size_a, "grew")
        .otherwise("shrank")
    )


def safe_ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole, or 0.0 when there is no whole."""
    part, whole = _col(part), _col(whole)
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def fill_second(last_ts: Column, budget: Column, bytes_per_day: Column) -> Column:
    """Second at which `budget` more bytes are used up; NULL when it has no date."""
    seconds = budget.cast("double") / bytes_per_day * S.SECONDS_PER_DAY
    return F.when(bytes_per_day > 0, (last_ts.cast("double") + seconds).try_cast("long"))
