"""A bitmap of hashes that spares most rows of a large side a join."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bitmap has 2 to the power of so many bits at most, 32 MB; more keys let more others pass, and none of themselves be missed.
MOST_BITS = 28


def hash_test(keys: DataFrame, n: int) -> Callable[..., Column]:
    """A test of columns like those of `keys`, about `n` rows: true for all of these, false for most others, never NULL."""
    spark, power = keys.sparkSession, min(max((32 * n).bit_length(), 12), MOST_BITS)
    place = _place(keys.columns, power)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = keys.select(F.floor(place / 64).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << power - 6, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    held = spark.createDataFrame(pa.table({"bits": pa.ListArray.from_arrays([0, len(bits)], pa.array(bits))}))

    def test(*columns: str | Column) -> Column:
        at = _place(columns, power)
        return F.getbit(F.get(held.scalar(), F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1

    return test


def _place(columns, power: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - power)
