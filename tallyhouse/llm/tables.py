"""Reading the corpus tables, the fixed folds, and columns that Python computes."""

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "array<bigint>": pa.list_(pa.int64()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def strip_blank(text: Column) -> Column:
    """Without blanks, tabs and line ends (x20, x09 to x0D) at both ends."""
    return F.call_function("btrim", text, F.lit("\x20\x09\x0a\x0b\x0c\x0d"))


def ascii_lower(text: Column) -> Column:
    """A to Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(name: str, columns: list[str]) -> str:
    """`name`, with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Return the memory that Arrow and numpy hold unused, since Spark keeps the worker for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def lean(function):
    """`function` from batches to batches, which gives memory back when its task ends."""

    def run(batches):
        yield from function(batches)
        give_back()

    return run


def answered(source: DataFrame, answers: T.StructType, start, drop: int = 0) -> DataFrame:
    """`source` with the columns `answers`, computed batch by batch in Python.

    `start()` begins a task and gives a function from a record batch of `source` to one
    list or array for each answer.  The last `drop` columns are for that function only.
    All others stay as they are, Arrow arrays that are never made into Python values, so
    that large numbers beside nulls, decimals and times keep every digit; those named as
    an answer are replaced in place.  Names may repeat and hold any characters.  Spark
    bounds a batch by its bytes (`spark.sql.execution.arrow.maxBytesPerBatch`).
    """
    fields = source.schema.fields[: len(source.columns) - drop]
    made = {f.name: i for i, f in enumerate(answers)}
    old = [f.name for f in fields]
    new = [f for f in answers if f.name not in old]
    schema = T.StructType([*(answers[f.name] if f.name in made else f for f in fields), *new])
    kinds = [_ARROW[f.dataType.simpleString()] for f in answers]

    def run(batches):
        work = start()
        for batch in batches:
            found = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind) for x, kind in zip(work(batch), kinds)]
            columns = [found[made[name]] if name in made else batch.column(i) for i, name in enumerate(old)]
            columns += [found[made[f.name]] for f in new]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    plain = source.toDF(*(f"c{i}" for i in range(len(source.columns))))
    return plain.mapInArrow(lean(run), schema)
