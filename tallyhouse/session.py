"""Session settings and shared working folders."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder of its
    own: executors of a cluster cannot see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tallyhouse-")
    return f"{base.rstrip('/')}/tallyhouse/{label}-{uuid.uuid4().hex}"


#: Files a task writes to at once; the rows of further partitions are sorted.
OPEN_FILES = 32


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block; streams keep those they are started under."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: Shuffled rows leave the executors' disks when the job that made them ends, in place of when the driver collects garbage.
NO_SHUFFLE_KEPT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def unsorted_partitions(spark: SparkSession):
    """Writes by partition go to open files, without a sort of all rows by partition before; they keep no shuffled rows."""
    return settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES), **NO_SHUFFLE_KEPT})


#: Options of Parquet files: prefixes that follow each other and differences of numbers are stored, then compressed.
PACKED = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    # a list of their values is seldom smaller, and is left only after many rows
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("path", "size", "mtime")},
}


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path; a job cannot list, move or remove files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(rows: DataFrame, label: str) -> DataFrame:
    """`rows` written to a new working folder and read back.

    This cuts the lineage in a way that survives lost executors, and the planner
    then knows the true size, which it only guesses for a computed result.  Like
    checkpoint files, the folder is left to the owner of `spark.checkpoint.dir`.
    """
    folder = working_folder(rows.sparkSession, label)
    with settings(rows.sparkSession, NO_SHUFFLE_KEPT):
        rows.write.options(**PACKED).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tallyhouse")
    defaults = {
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        # Off: recording the Python call site of every column costs milliseconds each.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
