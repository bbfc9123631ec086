"""Steps whose memory, shuffles or writes must not grow faster than the tables."""

import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.functions.hashes import hash_test
from tallyhouse.functions.paths import parent_dir
from tallyhouse.operators import ignore
from tallyhouse.plans import ingest as plans
from tallyhouse.plans import inventory, registry
from tallyhouse.session import unsorted_partitions, written
from tallyhouse.sources import manifest
from tallyhouse.streaming import ingest as streaming


def _lines(spark, folder, rows):
    made = spark.range(rows).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") * 7919 % 100).alias("l_partkey"),
        (F.col("id") * 104729 % 53).alias("l_suppkey"), (F.col("id") % 900 + 0.5).alias("l_extendedprice"),
    )
    made.repartition(4).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_files_come_directory_by_directory_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inventory, "TASK_ROWS", 4000)
    rows = inventory.file_rows(spark, _lines(spark, tmp_path, 30_000), inventory.IDS[:1])
    found = rows.select(F.spark_partition_id().alias("task"), parent_dir("path").alias("dir"), "path").collect()
    tasks = {r["task"] for r in found}
    assert len(tasks) > 5
    # a directory lies in one task, but for those at a border
    assert len({(r["task"], r["dir"]) for r in found}) < len({r["dir"] for r in found}) + 20 * len(tasks)
    of_task = [r["dir"] for r in found if r["task"] == min(tasks)]
    assert sum(a != b for a, b in zip(of_task, of_task[1:])) + 1 == len(set(of_task))


def test_a_write_by_partition_sorts_no_rows(spark, tmp_path):
    plans = []
    for name, before in (("sorted", False), ("open", True)):
        rows = spark.range(1000).withColumn("part", F.col("id") % 3)
        if before:
            with unsorted_partitions(spark):
                rows.write.partitionBy("part").parquet(f"{tmp_path}/{name}")
        else:
            rows.write.partitionBy("part").parquet(f"{tmp_path}/{name}")
        plans.append(len(glob.glob(f"{tmp_path}/{name}/part=*/*.parquet")))
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 1000
    assert plans[0] == plans[1]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_text_exports_are_compressed_and_read_back(spark):
    rows = spark.createDataFrame([("2024-01-01_06-00", f"/vol/{i}", i, None, i, False) for i in range(50)], S.MANIFEST)
    for fmt in ("json", "csv"):
        folder = registry.landing_folder(spark, rows, fmt)
        assert all(f.endswith(".gz") for f in os.listdir(folder) if f.startswith("part-"))
        reader = spark.read.schema(S.MANIFEST).option("header", True).format(fmt)
        assert sorted(map(tuple, reader.load(folder).collect())) == sorted(map(tuple, rows.collect()))


def test_paths_a_stream_has_seen_are_kept_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01_06-00", f"/vol/{i}", i, None, i, False) for i in range(40)], S.MANIFEST)
    rows.write.parquet(f"{tmp_path}/in")
    arriving = streaming.stream_manifest(spark, f"{tmp_path}/in", root="/vol")
    streaming.stream_counts(arriving, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    assert glob.glob(f"{tmp_path}/progress/state/0/*/*.changelog")
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert [tuple(r) for r in streaming.latest_counts(spark, f"{tmp_path}/out").collect()] == [("2024-01-01_06-00", 40, sum(range(40)))]


def test_a_hash_test_passes_its_keys_and_few_others(spark):
    keys = spark.range(5000).select(F.when(F.col("id") > 0, F.concat(F.lit("/vol/"), F.col("id"))).alias("path"), (F.col("id") % 3).alias("n"))
    test = hash_test(keys, 5000)
    assert keys.where(test("path", "n")).count() == 5000
    assert keys.where(test("path", F.col("n") + 3)).count() < 500
    assert keys.where(test("path", "n").isNull()).isEmpty()


def test_paths_seen_before_are_not_shuffled_for_a_batch_without_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "MOST_FOLDERS", 3)
    seen = f"{tmp_path}/seen"

    def batch(n, first, last):
        rows = spark.range(first, last).select(F.lit("2024-01-01_06-00").alias("snapshot_id"), F.concat(F.lit("/vol/"), F.col("id")).alias("path"), F.col("id").alias("size"))
        return streaming._keep_new(rows.unionByName(rows.limit(2)), n, seen, delay).count()

    delay = "7 days"
    assert [batch(n, 1000 * n, 1000 * n + 1000) for n in range(5)] == [1000] * 5
    assert len(os.listdir(seen)) == 2  # the first four are one
    assert batch(5, 4900, 5100) == 100
    assert batch(5, 4900, 5100) == 100  # an attempt after a failure
    assert batch(6, 0, 5100) == 0
    both = spark.read.schema(streaming._SEEN).parquet(*(f"{seen}/{f}" for f in os.listdir(seen)))
    few = both.where("size BETWEEN 100 AND 109").select("snapshot_id", "path")
    assert both.where(hash_test(few, 10)("snapshot_id", "path")).count() < 500
    delay = "0 seconds"
    assert batch(7, 0, 10) == 10 and len(os.listdir(seen)) == 1  # what has expired is counted again, and gone


def test_counts_of_a_stream_hold_no_row_of_state_for_a_path(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01_06-00", f"/vol/{i}", i, None, i, False) for i in range(40)], S.MANIFEST)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    arriving = streaming.stream_manifest(spark, f"{tmp_path}/in", root="/vol")
    query = streaming.stream_counts(arriving, f"{tmp_path}/out", f"{tmp_path}/progress")
    query.awaitTermination()
    state = [o["numRowsUpdated"] for p in query.recentProgress for o in p["stateOperators"]]
    assert sum(state) == 1 and [tuple(r) for r in streaming.latest_counts(spark, f"{tmp_path}/out").collect()] == [("2024-01-01_06-00", 40, sum(range(40)))]


def test_names_meet_only_the_patterns_they_hold(spark, entries):
    # all patterns share each run of four characters with many others
    patterns = spark.range(2000).select(F.format_string("f%04d_", F.col("id")).alias("pattern"))
    names = spark.range(3000).select(F.format_string("f%04d_x.log", F.col("id")).alias("_tested"))
    index = ignore.pattern_index(patterns)
    met = ignore._held(names, [6], ignore._bitmap(index, [6], 2000)).join(index, F.col("_gram") == F.col("gram"))
    assert met.count() == 2000
    assert ignore._held(names, [6], ignore._bitmap(index, [6], 2000)).count() < 2100
    long = spark.createDataFrame([("a" * 30 + "é",), ("b" * 16,), ("é" * 9,)], "pattern string")
    files = entries(("/" + "x" + "a" * 30 + "éy", 1), ("/" + "a" * 31, 1), ("/" + "é" * 9, 1), ("/" + "é" * 8, 1), ("/c" + "b" * 17, 1))
    assert sorted(r["path"] for r in ignore.ignore_by_table(files, long).collect()) == sorted(["/" + "a" * 31, "/" + "é" * 8])


def test_entries_that_hold_no_pattern_are_not_shuffled(spark, entries):
    names = [f"f{i:04d}_x.log" for i in range(2000)]
    files = entries(*((f"/vol/{n}", 1) for n in names)).withColumn("name", F.when(F.col("name") != "f0100_x.log", F.col("name")))
    patterns = spark.createDataFrame([("f0007_",), ("f0100_",), ("f0200",), (None,), ("",)], "pattern string")
    kept = ignore.ignore_by_table(files, patterns)
    assert sorted(r["path"] for r in kept.collect()) == [f"/vol/{n}" for n in names if n[:5] not in ("f0007", "f0200")]
    # of the two halves only the one whose names pass the bitmap goes into a join
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1 and plan.index("Union") < plan.index("Join LeftAnti")
    assert plan.count("getbit") >= 2
    assert ignore.ignore_by_table(files, patterns.where("pattern = 'nowhere'")) is files
    none = ignore.ignore_by_table(files, spark.createDataFrame([("nowhere",)], "pattern string"))
    assert none is files


def test_paths_and_numbers_are_stored_by_their_differences(spark, tmp_path):
    # five snapshots of each file, one after the other, as exports have them
    rows = spark.range(40_000).select(
        F.concat(F.lit("2024-01-0"), F.col("id") % 5 + 1, F.lit("_06-00")).alias("snapshot_id"), F.format_string("/vol/s%d/web/f%d_%d.log", F.col("id") % 7, F.floor(F.col("id") / 5), F.xxhash64(F.floor(F.col("id") / 5)) % 20000).alias("path"),
        (F.xxhash64("id") % 1000 + 5000).alias("size"), F.lit(None).cast("long").alias("physical_size"), (F.col("id") * 7919 % 4000000).alias("mtime"), F.lit(False).alias("is_dir"),
    ).coalesce(1)
    folder = registry.landing_folder(spark, rows, "parquet")
    store = registry.SnapshotStore(spark, f"{tmp_path}/store")
    store.write(manifest.ingest_manifest(spark, folder, root="/vol"), root="/vol", directories=True)
    for file in (*glob.glob(f"{folder}/*.parquet"), *glob.glob(f"{tmp_path}/store/files/**/*.parquet", recursive=True)):
        group = pq.ParquetFile(file).metadata.row_group(0)
        packed = {group.column(i).path_in_schema: set(group.column(i).encodings) for i in range(group.num_columns)}
        assert "DELTA_BYTE_ARRAY" in packed["path"] and all("DELTA_BINARY_PACKED" in packed[c] for c in ("size", "mtime"))
    assert sorted(map(tuple, spark.read.schema(S.MANIFEST).parquet(folder).collect())) == sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, store.files().where("NOT is_dir").select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_an_export_sent_in_parts_is_derived_once(spark, tmp_path, monkeypatch):
    sf_dir, derived, inner = _lines(spark, tmp_path, 3000), [], inventory.listing_export
    monkeypatch.setattr(inventory, "listing_export", lambda *a: derived.append(1) or inner(*a))
    folder, send, once = plans._sent_in_parts(spark, sf_dir)
    assert len(derived) == 1
    rows = inner(spark, sf_dir)
    first = F.pmod(F.xxhash64("path"), F.lit(3))
    came = lambda: sorted(map(str, spark.read.schema(S.MANIFEST).parquet(folder).collect()))
    assert came() == sorted(map(str, rows.where(first == 0).collect()))
    assert sorted(map(str, once.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    send()
    again = rows.where(first > 0).unionByName(rows.where((first == 0) & (F.col("mtime") % 2 == 0)))
    assert came() == sorted(map(str, rows.where(first == 0).unionByName(again).collect()))


def test_a_write_keeps_no_shuffled_rows(spark, tmp_path):
    def left():
        return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))

    folder = spark.conf.get("spark.local.dir", None) or spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].getPath()
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("part")).repartitionByRange(4, "id")
    before = left()
    with unsorted_partitions(spark):
        rows.write.partitionBy("part").parquet(f"{tmp_path}/rows")
    written(rows, "kept")
    assert left() <= before
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 200_000
