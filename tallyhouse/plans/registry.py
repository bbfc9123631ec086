"""Named queries and the SQL each is checked against."""

import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from tallyhouse.plans.inventory import DIR_MTIME, IDS, ROOT, file_rows
from tallyhouse.session import PACKED, working_folder
from tallyhouse.sources.store import SnapshotStore

QUERIES = {}
ORACLES = {}
_STORES = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under `name`, with its SQL when there is one."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def store(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """The derived inventory committed to a snapshot table, once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        made = SnapshotStore(spark, working_folder(spark, "store"))
        made.write(file_rows(spark, sf_dir), snapshot_ids=IDS, root=ROOT, directories=True, dir_mtime=DIR_MTIME, tree=True)
        _STORES[key] = made
    return _STORES[key]


def entries(spark: SparkSession, sf_dir: str, *ids: str) -> DataFrame:
    """Files and directories of the named snapshots, or of all."""
    return store(spark, sf_dir).files(*ids)


def landing_folder(spark: SparkSession, rows: DataFrame, fmt: str) -> str:
    """Write `rows` to a new shared folder and return it."""
    folder = working_folder(spark, f"export-{uuid.uuid4().hex[:8]}")
    export(rows, fmt).save(folder)
    return folder


def export(rows: DataFrame, fmt: str) -> DataFrameWriter:
    """A writer of listing exports, compressed; a Parquet file in parts that several tasks can read."""
    if fmt == "parquet":
        return rows.write.format(fmt).options(**PACKED).option("parquet.block.size", 16 << 20)
    writer = rows.write.format(fmt).option("compression", "gzip")
    return writer.option("header", True) if fmt == "csv" else writer
