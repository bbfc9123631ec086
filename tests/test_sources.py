import json
import os

import pytest
from conftest import records
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.operators import listings, reclaim, sqlview, trend
from tallyhouse.operators.retention import Policy, retention_plan
from tallyhouse.operators.usage import dir_usage
from tallyhouse.sources import envelope, manifest
from tallyhouse.sources.store import SnapshotStore, new_snapshot_id, scan_meta
from tallyhouse.streaming import ingest as streaming

LISTING = [
    ("2026-05-14_10-00", "/vol/a/x.LOG", 10, 512, 1700000000, False),
    ("2026-05-14_10-00", "/vol/a/b/y", 20, None, -5, None),
    ("2026-05-14_10-00", "/vol/a", 96, 96, 1600000000, True),
    ("2026-05-15_10-00", "/vol/z.tar.gz", 0, 0, None, False),
]


@pytest.fixture
def listing(spark):
    return spark.createDataFrame(LISTING, S.MANIFEST)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_manifests(spark, listing, tmp_path, fmt):
    folder = str(tmp_path / "export")
    listing.write.format(fmt).option("header", True).save(folder)
    files = manifest.ingest_manifest(spark, folder, fmt, "/vol", directories=True)
    rows = {(r["snapshot_id"][8:10], r["path"]): r for r in records(files)}
    assert set(rows) == {
        ("14", "/vol"), ("14", "/vol/a"), ("14", "/vol/a/b"), ("14", "/vol/a/x.LOG"), ("14", "/vol/a/b/y"),
        ("15", "/vol"), ("15", "/vol/z.tar.gz"),
    }
    log, nested, listed = rows["14", "/vol/a/x.LOG"], rows["14", "/vol/a/b/y"], rows["14", "/vol/a"]
    assert (log["name"], log["ext"], log["size"], log["physical_size"], log["depth"]) == ("x.LOG", "log", 10, 512, 2)
    assert (nested["ext"], nested["mtime"], nested["is_dir"]) == (None, None, False)
    assert (listed["size"], listed["physical_size"], listed["mtime"], listed["depth"]) == (0, None, 1600000000, 1)
    assert rows["14", "/vol/a/b"]["mtime"] is None and rows["15", "/vol"]["depth"] == 0


def test_listing_of_a_folder(spark, tmp_path):
    (tmp_path / "sub" / "inner").mkdir(parents=True)
    (tmp_path / "big.bin").write_bytes(b"0" * 16384)
    (tmp_path / "sub" / "inner" / "nested.png").write_bytes(b"0" * 8192)
    files = manifest.ingest_listing(spark, f"file://{tmp_path}/", "2026-05-15_10-00")
    rows = {r["path"].removeprefix(str(tmp_path)): r for r in records(files)}
    assert set(rows) == {"", "/big.bin", "/sub", "/sub/inner", "/sub/inner/nested.png"}
    assert (rows["/sub/inner/nested.png"]["size"], rows["/sub/inner/nested.png"]["depth"]) == (8192, 3)
    assert rows[""]["depth"] == 0 and rows["/big.bin"]["mtime"] > 1700000000


@pytest.fixture
def snaps(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "snapshots"))


def test_store_round_trip(spark, snaps, listing):
    assert snaps.ids() == [] and records(snaps.listing()) == [] and records(snaps.files()) == []
    files = manifest.derive_columns(listing, "/vol")
    assert snaps.write(files, root="/vol", directories=True) == ["2026-05-14_10-00", "2026-05-15_10-00"]
    assert snaps.files("2026-05-14_10-00").count() == 5
    assert records(snaps.usage("@latest")) == [
        {"snapshot_id": "2026-05-15_10-00", "dir": "/vol", "files": 1, "bytes": 0, "physical_bytes": 0}
    ]
    meta = {r["snapshot_id"]: r for r in records(snaps.meta())}
    assert (meta["2026-05-14_10-00"]["entries"], meta["2026-05-14_10-00"]["bytes"]) == (5, 30)
    listed = records(snaps.listing())
    assert [r["id"] for r in listed] == sorted(meta) and all(r["bytes"] > 0 for r in listed)
    assert listed[0]["created"] == "2026-05-14T10:00:00Z"
    assert snaps.resolve(listed[0]["path"]) == "2026-05-14_10-00"


def test_snapshots_are_immutable(spark, snaps, entries):
    snaps.write(entries(("/a", 1)), "2026-05-15_10-00")
    with pytest.raises(ValueError, match="immutable"):
        snaps.write(entries(("/b", 2)), "2026-05-15_10-00")
    snaps.write(entries(("/b/c", 2), ("/b/d", 3)), "2026-05-15_10-00", replace=True, sort_by_path=True)
    assert sorted(r["path"] for r in records(snaps.files())) == ["/b/c", "/b/d"]
    assert records(snaps.meta())[0]["bytes"] == 5
    with pytest.raises(ValueError, match="letters"):
        snaps.write(entries(("/b", 2)), "a/b")


def test_references_into_the_store(snaps, entries):
    for day in range(11, 16):
        snaps.write(entries((f"/d/{day}", day), ("/d", None)), f"2026-05-{day}_10-00")
    snaps.write(entries(("/only-dirs", None)), "0-manual")
    assert snaps.resolve() == "2026-05-15_10-00" and snaps.resolve("@latest~4") == "2026-05-11_10-00"
    assert [one for one, _ in snaps.last_n(3)] == [f"2026-05-{d}_10-00" for d in (13, 14, 15)]
    assert snaps.at_age(86400, now=1778846400) == "2026-05-14_10-00"
    # a snapshot without files has its root only
    assert [(r["dir"], r["files"]) for r in records(snaps.usage("0-manual"))] == [("/", 0)]
    for call in (lambda: snaps.resolve("@latest~9"), lambda: snaps.resolve("nope"), lambda: snaps.last_n(9), lambda: snaps.at_age(10**9, 1778846400)):
        with pytest.raises(LookupError):
            call()
    # Only the folders asked for are read, and the roll-up equals the files.
    pair = snaps.files("@latest", "@latest~1")
    assert len({f.rsplit("/", 3)[-3] for f in pair.inputFiles()}) == 2
    assert sorted(map(tuple, snaps.usage().where("files > 0").collect())) == sorted(map(tuple, dir_usage(snaps.files()).select(snaps.usage().columns).collect()))
    assert records(trend.predict(snaps.meta(), 100))[0]["samples"] == 5


def test_new_ids_are_dates():
    assert new_snapshot_id(1700000000) == "2023-11-14_22-13"


def test_envelope(spark, seeded):
    df = envelope.envelope_json(listings.top_files(seeded), "top", [F.desc("size"), F.asc("path")], 2, {"over": "1d"})
    document = json.loads(df.first()["json"])
    assert (document["schema_version"], document["kind"], document["over"]) == (1, "top", "1d")
    assert [r["path"] for r in document["records"]] == ["/a/big.bin", "/b/other.bin"]
    none = envelope.envelope_json(listings.empty_files(seeded), "empty", ["path"], 5)
    assert json.loads(none.first()["json"])["records"] == []


def test_cleanup_document(entries):
    files = entries(
        ("/p1/node_modules", None), ("/p1/node_modules/a", 4096), ("/p2/node_modules", None), ("/p2/node_modules/b", 1024),
        ("/p1/target", None), ("/p1/target/c", 8192), ("/p3/venv", None),
    )
    document = json.loads(envelope.cleanup_json(reclaim.cleanup_scan(files)).first()["json"])
    assert (document["kind"], document["applied"], document["removed"]) == ("cleanup", False, [])
    assert [h["path"] for h in document["records"]] == ["/p1/target", "/p1/node_modules", "/p2/node_modules", "/p3/venv"]
    assert document["summary"][:2] == [
        {"category": "target", "paths": 1, "bytes": 8192, "files": 1},
        {"category": "node_modules", "paths": 2, "bytes": 5120, "files": 2},
    ]
    assert document["total_bytes"] == 13312
    empty = json.loads(envelope.cleanup_json(reclaim.cleanup_scan(files, ["gradle"])).first()["json"])
    assert (empty["records"], empty["summary"], empty["total_bytes"]) == ([], [], 0)


def test_forget_document(spark):
    catalog = spark.createDataFrame(
        [("2026-05-13_10-00", "/s/13", 10), ("2026-05-14_10-00", "/s/14", 20), ("manual", "/s/m", 5)], "id string, path string, bytes long"
    )
    document = json.loads(envelope.forget_json(retention_plan(catalog, Policy(last=1))).first()["json"])
    assert [k["id"] for k in document["kept"]] == ["2026-05-14_10-00"] and document["kept"][0]["reasons"] == ["last"]
    assert [(r["id"], r["created"]) for r in document["removed"]] == [("2026-05-13_10-00", "2026-05-13T10:00:00Z")]
    assert (document["skipped_unparseable"], document["total_removed_bytes"]) == (["manual"], 10)


def test_forget_document_of_many_snapshots_is_whole(spark):
    rows = [(f"2024-01-01_{i // 60 % 24:02d}-{i % 60:02d}", f"/s/{i}", 100) for i in range(1440)]
    catalog = spark.createDataFrame(rows, "id string, path string, bytes long")
    document = json.loads(envelope.forget_json(retention_plan(catalog, Policy(last=1))).first()["json"])
    assert (len(document["removed"]), document["total_removed_bytes"]) == (1439, 143900)
    assert [r["id"] for r in document["removed"]] == sorted((r[0] for r in rows[:-1]), reverse=True)


@pytest.mark.parametrize("odd", ['1', '{"path":"/x","size":"many"}', '{"path":"/x","size":99999999999999999999}', '[]'])
def test_a_record_that_does_not_fit_fails(spark, odd):
    good = '{"path":"/b","size":2}'
    texts = spark.createDataFrame([(f'{{"schema_version":1,"kind":"top","records":[{good},{odd}]}}',)], "value string")
    with pytest.raises(Exception, match="MALFORMED_RECORD|CANNOT_PARSE"):
        envelope.parse_envelopes(texts, "value", "path string, size long").collect()
    texts = spark.createDataFrame([(f'{{"schema_version":1,"kind":"top","records":[{good},{good}]}}',)], "value string")
    assert [tuple(r) for r in envelope.parse_envelopes(texts, "value", "path string, size long").collect()] == [("top", "/b", 2)] * 2


def test_times_are_microseconds(spark):
    df = spark.sql("SELECT TIME'01:02:03.5' AS t, nullif(TIME'01:00:00', TIME'01:00:00') AS n, array(TIME'00:00:01') AS a")
    assert json.loads(envelope.rows_as_json(df).first()["value"]) == {"t": 3723500000, "n": None, "a": [1000000]}


def test_an_unfinished_scan_has_no_duration(spark, seeded):
    from tallyhouse.sources.store import scan_meta, with_duration

    for end, wanted in ((None, None), (5, 0), (1800000000, 21157200)):
        meta = scan_meta(seeded, started_at=1778842800, ended_at=end)
        assert with_duration(meta).first()["duration_s"] == wanted
        assert listings.with_scan_meta(listings.stats(seeded), meta).first()["scan_duration_s"] == wanted


def test_ancestors_of_listed_directories_are_derived(spark):
    listing = spark.createDataFrame([("s", "/vol/a/b", 0, None, None, True)], S.MANIFEST)
    found = manifest.derive_directories(manifest.derive_columns(listing, "/vol"), "/vol")
    assert sorted(r["path"] for r in found.collect()) == ["/vol", "/vol/a", "/vol/a/b"]


def test_the_store_hides_no_rows(spark, snaps, seeded, tmp_path):
    import shutil

    snaps.write(seeded, "2026-05-15_10-00")
    snaps.write(seeded, "2026-05-15_11-00")
    both = seeded.withColumn("snapshot_id", F.lit("2026-05-16_10-00")).unionByName(seeded.withColumn("snapshot_id", F.lit("2026-05-17_10-00")))
    with pytest.raises(Exception, match="not named"):
        snaps.write(both, snapshot_ids=["2026-05-16_10-00"])
    with pytest.raises(LookupError, match="2026-05-18_10-00"):
        snaps.write(both, snapshot_ids=["2026-05-16_10-00", "2026-05-17_10-00", "2026-05-18_10-00"])
    assert snaps.ids() == ["2026-05-15_10-00", "2026-05-15_11-00"]
    listed = {r["id"]: r for r in snaps.listing().collect()}
    for one, row in listed.items():
        folder = snaps.root.removeprefix("file:") + f"/files/snapshot_id={one}"
        assert row["path"].endswith(f"/files/snapshot_id={one}")
        assert row["bytes"] == sum(os.path.getsize(f"{at}/{x}") for at, _, names in os.walk(folder) for x in names if x.endswith(".parquet"))
    shutil.move(snaps.root.removeprefix("file:") + "/files/snapshot_id=2026-05-15_10-00", str(tmp_path / "moved"))
    with pytest.raises(LookupError, match="damaged"):
        snaps.files()


def test_replacing_by_nothing_leaves_nothing(snaps, seeded):
    snaps.write(seeded, "2026-05-15_10-00")
    assert snaps.write(seeded.limit(0), "2026-05-15_10-00", replace=True) == []
    assert snaps.ids() == [] and snaps.files().count() == 0
    snaps.write(seeded, "2026-05-15_10-00")
    assert snaps.write(seeded.limit(2), "2026-05-15_10-00", replace=True) == ["2026-05-15_10-00"]
    assert snaps.files("@latest").count() == 2 and snaps.meta().first()["entries"] == 2


def test_the_catalog_opens_no_data_files(snaps, seeded):
    snaps.write(seeded, "2026-05-15_10-00")
    assert "binaryFile" not in snaps.listing()._jdf.queryExecution().executedPlan().toString()


def test_predict_document(spark):
    totals = spark.createDataFrame([("2026-05-01_00-00", 100), ("2026-05-02_00-00", 200)], "snapshot_id string, bytes long")
    record = json.loads(envelope.predict_json(trend.predict(totals, 1000)).first()["json"])["record"]
    assert record["fill_at"] == "2026-05-12T00:00:00Z" and "reason" not in record
    record = json.loads(envelope.predict_json(trend.predict(totals)).first()["json"])["record"]
    assert record["fill_at"] is None and record["free_bytes_now"] is None and record["reason"]


def test_null_fields_are_left_out(entries):
    df = envelope.records_ndjson(listings.empty_files(entries(("/x", 0, None))))
    assert json.loads(df.first()["value"]) == {"path": "/x", "size": 0}


def test_envelopes_come_back(spark, seeded, tmp_path):
    folder = str(tmp_path / "docs")
    rows = listings.top_dirs(dir_usage(seeded))
    envelope.envelope_json(rows, "dirs", [F.desc("total_size")], 30).write.text(folder)
    (tmp_path / "docs" / "bare.txt").write_text('{"schema_version":1,"kind":"top"}\n')
    back = envelope.envelope_read(spark, folder, "path string, total_size long")
    assert sorted(map(tuple, back.collect())) == [("dirs", "/a", 20736), ("dirs", "/b", 8192)]


@pytest.mark.parametrize("text, fault", [
    ('{"schema_version":999,"kind":"top","records":[]}', "incompatible"),
    ("[]", "not a document"),
    ("not json", "not a document"),
    ('{"kind":"top","records":[]}', "schema_version"),
    ('{"schema_version":1,"records":[]}', "without a kind"),
    ('{"schema_version":1,"kind":"churn","records":[]}', "not accepted"),
])
def test_bad_envelopes(spark, text, fault):
    docs = spark.createDataFrame([(text,)], "value string")
    with pytest.raises(Exception, match=fault):
        envelope.parse_envelopes(docs, "value", "path string").collect()


def test_any_result_as_json(spark):
    df = spark.sql("""
      SELECT 1L AS i, CAST(1.50 AS DECIMAL(38, 2)) AS d, CAST('NaN' AS DOUBLE) AS nan, CAST('Infinity' AS FLOAT) AS inf, 2.5D AS f,
        TIMESTAMP'2024-01-01 00:00:00' AS t, DATE'1970-01-11' AS day, X'CAFE' AS b, map('k', X'00') AS m,
        array(CAST(1 AS DECIMAL(5, 1)), NULL) AS l, named_struct('x', DATE'1970-01-02') AS s,
        INTERVAL '1 02:03:04.5' DAY TO SECOND AS w, INTERVAL '1-2' YEAR TO MONTH AS y, CAST(NULL AS STRING) AS z
    """)
    assert json.loads(envelope.rows_as_json(df).first()["value"]) == {
        "i": 1, "d": "1.50", "nan": None, "inf": None, "f": 2.5, "t": 1704067200000000, "day": 10, "b": "<blob:2 bytes>",
        "m": [{"key": "k", "value": "<blob:1 bytes>"}], "l": ["1.0", None], "s": {"x": 1},
        "w": {"months": 0, "days": 1, "nanos": 7384500000000}, "y": {"months": 14, "days": 0, "nanos": 0}, "z": None,
    }


def test_free_sql(spark, snaps, seeded):
    snaps.write(seeded, "2026-05-15_10-00")
    df = sqlview.sql_query(spark, "SELECT name, root FROM files JOIN scan_meta USING (snapshot_id) ORDER BY size DESC", snaps.files(), snaps.meta(), 2)
    assert [r["name"] for r in df.collect()] == ["big.bin", "other.bin"]
    assert not spark.catalog.tableExists("files")


def test_free_sql_leaves_the_views_of_the_session_alone(spark, snaps, seeded):
    snaps.write(seeded, "2026-05-15_10-00")
    snaps.write(seeded, "2026-05-16_10-00")
    spark.range(3).createOrReplaceTempView("files")
    try:
        one = sqlview.sql_query(spark, "WITH n AS (SELECT count(*) AS n FROM scan_meta) SELECT n, path FROM files CROSS JOIN n;", snaps.files("@latest"), snaps.meta())
        assert {r["n"] for r in one.collect()} == {1} and one.count() == seeded.count()
        assert spark.table("files").count() == 3
        with pytest.raises(ValueError, match="only queries"):
            sqlview.sql_query(spark, "DROP VIEW files", snaps.files("@latest"), snaps.meta())
    finally:
        spark.catalog.dropTempView("files")


def test_streaming(spark, listing, tmp_path):
    source, landing, progress = (str(tmp_path / n) for n in ("in", "landing", "progress"))

    def run():
        stream = streaming.stream_manifest(spark, source, root="/vol", files_per_trigger=1)
        streaming.stream_ingest(stream, landing, progress).awaitTermination()
        return {r["snapshot_id"]: (r["entries"], r["bytes"]) for r in records(streaming.running_counts(streaming.landed(spark, landing)))}

    first = listing.where("snapshot_id = '2026-05-14_10-00'")
    first.repartition(3).write.parquet(source)
    assert run() == {"2026-05-14_10-00": (3, 30)}
    assert run() == {"2026-05-14_10-00": (3, 30)}  # nothing new, nothing twice
    listing.where("snapshot_id = '2026-05-15_10-00'").write.mode("append").parquet(source)
    assert run() == {"2026-05-14_10-00": (3, 30), "2026-05-15_10-00": (1, 0)}
    store = SnapshotStore(spark, str(tmp_path / "snapshots"))
    store.write(streaming.landed(spark, landing), root="/vol", directories=True)
    assert store.files("2026-05-14_10-00").count() == 5


def test_running_counts_on_a_stream(spark, listing, tmp_path):
    source = str(tmp_path / "in")
    listing.write.parquet(source)
    counts = streaming.running_counts(streaming.stream_manifest(spark, source, root="/vol"))
    query = counts.writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["snapshot_id"]: r["entries"] for r in records(spark.table("counts"))} == {"2026-05-14_10-00": 3, "2026-05-15_10-00": 1}


def test_counts_of_the_stream_itself(spark, listing, tmp_path):
    source, folder, progress = (str(tmp_path / n) for n in ("in", "counts", "progress"))

    def run():
        stream = streaming.stream_manifest(spark, source, root="/vol", files_per_trigger=1)
        streaming.stream_counts(stream, folder, progress).awaitTermination()
        return {r["snapshot_id"]: (r["entries"], r["bytes"]) for r in records(streaming.latest_counts(spark, folder))}

    first = listing.where("snapshot_id = '2026-05-14_10-00'")
    first.repartition(3).write.parquet(source)
    assert run() == {"2026-05-14_10-00": (3, 30)}
    # after a restart: the same export again, and one that is new
    first.coalesce(1).write.mode("append").parquet(source)
    assert run() == {"2026-05-14_10-00": (3, 30)}
    listing.where("snapshot_id = '2026-05-15_10-00'").write.mode("append").parquet(source)
    assert run() == {"2026-05-14_10-00": (3, 30), "2026-05-15_10-00": (1, 0)}


def test_a_stream_commits_a_snapshot_once_when_it_is_complete(spark, listing, tmp_path):
    source, marks, landing, progress = (str(tmp_path / n) for n in ("in", "marks", "landing", "progress"))
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def run():
        stream = streaming.stream_manifest(spark, source, root="/vol")
        streaming.stream_commit(stream, streaming.stream_marks(spark, marks), store, landing, progress, root="/vol", directories=True).awaitTermination()
        return store.ids()

    def mark(one, entries):
        row = spark.createDataFrame([(one, entries, 5, 9)], streaming.END_MARK)
        row.write.mode("append").json(marks)

    one = "2026-05-14_10-00"
    first = listing.where(F.col("snapshot_id") == one)
    first.orderBy("path").limit(2).write.parquet(source)
    mark(one, 3)
    assert run() == []  # marked, but not all in
    first.orderBy("path").limit(1).write.mode("append").parquet(source)
    assert run() == []  # an entry that came again makes up for none
    first.write.mode("append").parquet(source)
    assert run() == [one]
    assert store.files(one).count() == 5 and store.files(one).select("path").distinct().count() == 5
    assert [(r["started_at"], r["ended_at"], r["bytes"]) for r in store.meta().collect()] == [(5, 9, 30)]
    generations = store._heads()
    first.write.mode("append").parquet(source)
    mark(one, 3)
    listing.where(F.col("snapshot_id") != one).write.mode("append").parquet(source)
    assert run() == [one] and store._heads() == generations  # sent twice, committed once
    mark("2026-05-15_10-00", None)
    assert run() == [one, "2026-05-15_10-00"] and store.files(one).count() == 5


def test_a_stream_commit_writes_no_waiting_snapshot_and_lands_no_derived_name(spark, listing, tmp_path, monkeypatch):
    source, marks, landing, progress = (str(tmp_path / n) for n in ("in", "marks", "landing", "progress"))
    store, tried, inner = SnapshotStore(spark, str(tmp_path / "store")), [], SnapshotStore.write

    def write(self, files, *a, **b):
        tried.append(files._jdf.queryExecution().executedPlan().toString())
        return inner(self, files, *a, **b)

    def run():
        stream = streaming.stream_manifest(spark, source, root="/vol", files_per_trigger=1)
        odd = F.col("path") == paths[0]
        stream = stream.withColumn("name", F.when(odd, F.lit("odd")).otherwise(F.col("name"))).withColumn("ext", F.when(odd, F.lit("x")).otherwise(F.col("ext")))
        streaming.stream_commit(stream, streaming.stream_marks(spark, marks), store, landing, progress, root="/vol").awaitTermination()
        return store.ids()

    monkeypatch.setattr(SnapshotStore, "write", write)
    one = "2026-05-14_10-00"
    first = listing.where(F.col("snapshot_id") == one)
    paths = sorted(r["path"] for r in first.collect())
    spark.createDataFrame([(one, 3, 5, 9)], streaming.END_MARK).write.json(marks)

    def send(n):
        first.orderBy("path").limit(n).coalesce(1).write.mode("append").parquet(source)

    send(1)
    assert run() == [] and not tried
    for _ in range(3):  # when three are in it is tried; as two were lacking then, one more is not enough
        send(1)
    assert run() == [] and len(tried) == 1
    assert not [f for f in (tmp_path / "store" / "files").rglob("*.parquet")]
    send(3)
    assert run() == [one] and len(tried) == 2
    # one shuffle, and no sort before it
    assert tried[-1].count("Exchange ") == 1 and "Sort" not in tried[-1][tried[-1].index("Exchange ") :]
    assert {r["path"]: (r["name"], r["ext"]) for r in store.files(one).collect()} == {
        p: ("odd", "x") if p == paths[0] else (p.rsplit("/", 1)[1], p.rsplit("/", 1)[1].rsplit(".", 1)[1].lower() if "." in p.rsplit("/", 1)[1] else None) for p in paths
    }
    landed = spark.read.parquet(landing).where("NOT is_mark")
    assert landed.where(F.col("path") != paths[0]).where("name IS NOT NULL OR ext IS NOT NULL").isEmpty()


def test_a_snapshot_can_be_replaced_by_what_it_holds(snaps, seeded):
    snaps.write(seeded, "2026-05-15_10-00", directories=True, tree=True)
    before = snaps.files("@latest")
    n = before.count()
    snaps.write(before.where("is_dir OR size > 300"), "2026-05-15_10-00", replace=True)
    # who had resolved the old snapshot goes on reading it
    assert before.count() == n and snaps.ids() == ["2026-05-15_10-00"]
    assert snaps.files("@latest").count() == snaps.meta().first()["entries"] == n - 1


def test_a_write_that_fails_changes_nothing(snaps, seeded):
    snaps.write(seeded, "2026-05-15_10-00")
    broken = seeded.withColumn("size", F.when(F.col("path") == "/a/big.bin", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("size")))
    with pytest.raises(Exception, match="lost"):
        snaps.write(broken, "2026-05-15_10-00", replace=True)
    assert snaps.ids() == ["2026-05-15_10-00"] and snaps.files().count() == seeded.count()
    # the repetition takes a generation of its own
    snaps.write(seeded.limit(1), "2026-05-15_10-00", replace=True)
    assert snaps.files().count() == 1 and snaps._heads() == {"2026-05-15_10-00": 3}


def test_two_writers_cannot_mix(snaps, entries, monkeypatch):
    one, two = entries(("/one", 1), ("/one/b", 2)), entries(("/two", 1))
    inner, put = [], SnapshotStore._put

    def between(self, table, rows, generations):
        if table == "usage" and not inner:
            inner.append(1)
            SnapshotStore(self.spark, self.root).write(two, "2026-05-15_10-00")
        return put(self, table, rows, generations)

    monkeypatch.setattr(SnapshotStore, "_put", between)
    with pytest.raises(ValueError, match="immutable"):
        snaps.write(one, "2026-05-15_10-00")
    assert [r["path"] for r in records(snaps.files())] == ["/two"] and records(snaps.usage())[0]["files"] == 1
    # with replace the one that claimed later stays, whoever ends last
    inner.clear()
    monkeypatch.setattr(SnapshotStore, "_put", lambda self, t, r, g: between(self, t, r, g) if t != "usage" or inner else (inner.append(1), SnapshotStore(self.spark, self.root).write(two, "2026-05-15_10-00", replace=True), put(self, t, r, g)))
    snaps.write(one, "2026-05-15_10-00", replace=True)
    assert [r["path"] for r in records(snaps.files())] == ["/two"]


def test_expired_generations_go(snaps, seeded):
    for n in (6, 3, 2):
        snaps.write(seeded.limit(n), "2026-05-15_10-00", replace=True)
    assert snaps.expire() == []
    gone = snaps.expire(older_than=-60)
    assert {f.rsplit("=", 1)[-1] for f in gone} == {"1", "2"} and len(gone) == 6
    assert snaps.files().count() == 2 and snaps.expire(older_than=-60) == []


@pytest.mark.parametrize(
    "sql",
    [
        "WITH q AS (SELECT 1 AS a) INSERT INTO tgt SELECT a FROM q",
        "FROM files INSERT INTO tgt SELECT 1",
        "FROM files INSERT INTO tgt SELECT 1 INSERT INTO tgt SELECT 2",
        "-- harmless\nDROP TABLE tgt",
        "/* a /* b */ c */ CREATE TABLE t2 AS SELECT 1",
        "WITH q AS (SELECT 1) DELETE FROM tgt",
        "SET spark.sql.ansi.enabled = false",
    ],
)
def test_only_queries_run(spark, seeded, sql, tmp_path):
    spark.sql(f"CREATE TABLE IF NOT EXISTS tgt (a INT) USING parquet LOCATION '{tmp_path}/tgt'")
    try:
        with pytest.raises(ValueError, match="only queries"):
            sqlview.sql_query(spark, sql, seeded, scan_meta(seeded))
        assert spark.table("tgt").count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS tgt")


def test_queries_may_begin_with_comments(spark, seeded):
    ids = ["2026-05-15_11-00"]
    for sql in ("-- all of them\nSELECT count(*) AS n FROM files -- end", "/* x /* y */ */ WITH q AS (SELECT * FROM files) SELECT count(*) AS n FROM q;", "(SELECT count(*) AS n FROM files)"):
        assert sqlview.sql_query(spark, sql, seeded, scan_meta(seeded), snapshot_ids=ids).first()["n"] == 6
    assert sqlview.sql_query(spark, "SELECT count(*) AS n FROM scan_meta", seeded, scan_meta(seeded), snapshot_ids=["other"]).first()["n"] == 0
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        sqlview.sql_query(spark, "SELECT count(, FROM files", seeded, scan_meta(seeded))


RECORDS = [
    {"path": "a", "size": 5, "name": "x.log"},
    {"path": "b", "size": "5"},
    {"path": "c", "size": 5.5, "na'me": "q"},
    {"path": "d", "size": None, "name": 7},
    {"path": "e", "size": 9007199254740993, "name": {"deep": "x.log"}},
    {"path": "f"},
    [1, 2],
    "size",
    7,
    None,
]


@pytest.mark.parametrize(
    "where, paths",
    [
        ("size >= 5", "ace"),
        ("size = 5", "a"),
        ("size = '5'", "b"),
        ("size != 5", "bcdef----"),
        ("size < 5.6", "ac"),
        ("size = 9007199254740993", "e"),
        ("size = 9007199254740992", ""),
        ("name LIKE '%.log'", "a"),
        ("name > 'a'", ""),
        ([("name", "LIKE", 7)], ""),
        ("name != 'x.log' AND size > 1", "ce"),
        ("na'me = 'q'", None),
        ([("na'me", "=", "q")], "c"),
        ([("size", "=", 5), ("gone", "!=", 1)], "a"),
    ],
)
def test_conditions_on_records_of_unknown_shape(spark, where, paths):
    text = json.dumps({"schema_version": 1, "kind": "find", "records": RECORDS})
    records = envelope.parse_untyped(spark.createDataFrame([(text,)], "value string"), "value")
    assert records.count() == len(RECORDS)
    if paths is None:
        with pytest.raises(ValueError):
            envelope.filter_untyped(records, where)
        return
    found = envelope.filter_untyped(records, where).selectExpr("coalesce(try_variant_get(record, '$.path', 'string'), '-') AS p").collect()
    assert "".join(sorted((r["p"] for r in found), key=lambda p: (p == "-", p))) == paths


def test_untyped_records_come_of_accepted_documents_only(spark):
    for text in ("{", '{"kind": "find", "records": []}', '{"schema_version": 99, "kind": "find"}', '{"schema_version": 1, "kind": "other"}'):
        with pytest.raises(Exception, match="schema_version|kind not accepted"):
            envelope.parse_untyped(spark.createDataFrame([(text,)], "value string"), "value").collect()


def test_untyped_records_are_ordered_and_limited(spark):
    text = json.dumps({"schema_version": 1, "kind": "find", "records": [{"path": p, "n": i} for i, p in enumerate("cabab")]})
    records = envelope.parse_untyped(spark.createDataFrame([(text,)], "value string"), "value")
    first = envelope.filter_untyped(records, [], 3, ["path"]).selectExpr("try_variant_get(record, '$.n', 'int') AS n").collect()
    assert [r["n"] for r in first] == [1, 3, 2]
