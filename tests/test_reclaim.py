import random

import pytest
from conftest import records
from pyspark.sql import functions as F

from tallyhouse import schema as S
from tallyhouse.operators import ignore, reclaim
from tallyhouse.operators.usage import dir_usage


def hits(df):
    return [(r["category"], r["path"], r["bytes"], r["files"]) for r in records(df)]


def test_cleanup_scan_and_summary(entries):
    files = entries(
        ("/h/p1/node_modules", None), ("/h/p1/node_modules/a.js", 4096),
        ("/h/p2/node_modules", None), ("/h/p2/node_modules/b.js", 1024),
        ("/h/p1/target", None), ("/h/p1/target/x/y.o", 8192), ("/h/p1/targets/z", 1),
        ("/h/p3/venv", None), ("/h/src/main.c", 7), ("/h/p1/target.txt", 3),
    )
    found = hits(reclaim.cleanup_scan(files))
    assert found == [
        ("target", "/h/p1/target", 8192, 1),
        ("node_modules", "/h/p1/node_modules", 4096, 1),
        ("node_modules", "/h/p2/node_modules", 1024, 1),
        ("venv", "/h/p3/venv", 0, 0),
    ]
    assert hits(reclaim.cleanup_scan(files, usage=dir_usage(files))) == found
    assert len(hits(reclaim.cleanup_scan(files, limit=2))) == 2
    summary = records(reclaim.cleanup_summary(reclaim.cleanup_scan(files), total=True))
    assert [(r["category"], r["paths"], r["bytes"]) for r in summary] == [
        (None, 4, 13312), ("target", 1, 8192), ("node_modules", 2, 5120), ("venv", 1, 0),
    ]
    assert records(reclaim.cleanup_summary(reclaim.cleanup_scan(files, ["no-such"]))) == []


def test_categories():
    assert set(reclaim.category_names(["venv", "totally-fake"])) == {".venv", "venv"}
    assert len(set(reclaim.category_names().values())) == 9


def test_protected(spark):
    """Each protected part protects wherever it stands whole; with a letter missing or another in it, it does not."""
    cases = [(f"/srv/one{part}two/build", True) for part in S.PROTECTED_SUBSTRINGS]
    for part in S.PROTECTED_SUBSTRINGS:
        middle = len(part) // 2
        cases += [(f"/srv/one/{part[1:middle]}-{part[middle:-1]}/build", False), (f"/srv/{part[:middle].strip('/')}/build", False)]
    cases = [(p, w) for p, w in cases if w or not any(s in p for s in S.PROTECTED_SUBSTRINGS)]
    rows = spark.createDataFrame(cases, "path string, wanted boolean").select("path", "wanted", reclaim.protected("path").alias("found"))
    assert len(cases) > len(S.PROTECTED_SUBSTRINGS) and [r["path"] for r in rows.collect() if r["found"] != r["wanted"]] == []


def test_nested_targets_and_outermost(entries):
    files = entries(
        ("/p/node_modules", None), ("/p/node_modules/q/dist", None), ("/p/node_modules/q/dist/f", 10),
        ("/p/node_modules/g", 5), ("/s/site-packages/x/build", None), ("/s/site-packages/x/build/f", 9),
    )
    assert hits(reclaim.cleanup_scan(files)) == [
        ("node_modules", "/p/node_modules", 15, 2), ("dist", "/p/node_modules/q/dist", 10, 1),
    ]
    assert [h[1] for h in hits(reclaim.cleanup_scan(files, outermost_only=True))] == ["/p/node_modules"]


def test_after_cleanup(entries):
    files = entries(
        ("/p", None), ("/p/target", None), ("/p/target/a", 1), ("/p/target/d", None), ("/p/target/d/b", 2),
        ("/p/target2", None), ("/p/target2/c", 3), ("/p/e", 4),
    )
    rest = reclaim.after_cleanup(files, reclaim.cleanup_scan(files))
    assert sorted(r["path"] for r in records(rest)) == ["/p", "/p/e", "/p/target2", "/p/target2/c"]


def test_cleanup_agrees_with_prefix_search(entries):
    """Random trees against a direct search for path prefixes."""
    rng = random.Random(7)
    parts = ["a", "b", "target", "build", "node_modules", "site-packages", "venv", "target0", "x-build"]
    dirs, rows = set(), []
    for i in range(400):
        segments = [rng.choice(parts) for _ in range(rng.randint(1, 6))]
        path = "/" + "/".join(segments)
        rows.append((f"{path}/f{i}", rng.randint(0, 9)))
        dirs |= {"/" + "/".join(segments[:n]) for n in range(1, len(segments) + 1)}
    names = reclaim.category_names()
    expected = {}
    for d in dirs:
        name = d.rsplit("/", 1)[1]
        if name in names and not any(s in d for s in S.PROTECTED_SUBSTRINGS):
            inside = [size for path, size in rows if path.startswith(d + "/")]
            expected[d] = (names[name], sum(inside), len(inside))
    files = entries(*rows, *((d, None) for d in dirs))
    found = {path: (c, b, n) for c, path, b, n in hits(reclaim.cleanup_scan(files, limit=10_000))}
    assert found == expected


def test_ignore_patterns(spark, tmp_path):
    (tmp_path / "one").write_text("# header\n\nfoo\n   \n# trailing\n\tbar \r\n*.log\n!keepme\n? maybe\n")
    (tmp_path / "two").write_text("bar\nbaz")
    rows = records(ignore.ignore_patterns(ignore.read_ignore_lines(spark, str(tmp_path))))
    assert {r["pattern"]: (r["source"].rsplit("/", 1)[1], r["line_no"]) for r in rows} == {
        "foo": ("one", 2), "bar": ("one", 5), "baz": ("two", 1),
    }


def test_ignore_filter(entries):
    files = entries(("/x/foo", 1), ("/x/myfoodir", None), ("/foo/bar", 1), ("/x/a.b", 2), ("/x/axb", 3))
    assert sorted(r["name"] for r in records(ignore.ignore_filter(files, ["foo", "a.b"]))) == ["axb", "bar"]
    assert ignore.ignore_filter(files, defaults=False).count() == 5
    assert sorted(r["name"] for r in records(ignore.ignore_filter(files, ["foo"], subtrees=True))) == ["a.b", "axb"]
    assert sorted(r["name"] for r in records(ignore.ignore_filter(files.where("path LIKE '/x/%'"), ["/x/"], subtrees=True, root="/x"))) == ["a.b", "axb", "foo", "myfoodir"]


def test_own_patterns_add_to_the_default_ones(entries):
    name = S.DEFAULT_IGNORES[0]
    files = entries((f"/x/{name}", 1), ("/x/foo", 1), ("/x/bar", 1))
    assert [r["name"] for r in records(ignore.ignore_filter(files, ["foo"]))] == ["bar"]
    assert [r["name"] for r in records(ignore.ignore_filter(files))] == ["foo", "bar"]


def test_after_cleanup_with_one_hot_directory(spark, entries, monkeypatch):
    """A directory with most rows, too large to broadcast: split, and nothing lost."""
    rows = [(f"/hot/f{i}", 1) for i in range(3000)] + [(f"/p{i}/target/g", 1) for i in range(300)]
    files = entries(*rows, *((f"/p{i}/target", None) for i in range(300))).repartition(8)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rest = reclaim.after_cleanup(files, reclaim.cleanup_totals(files))
        assert {r["path"] for r in records(rest)} == {f"/hot/f{i}" for i in range(3000)}
        assert "skew" in rest._jdf.queryExecution().executedPlan().toString().lower()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_table_of_patterns_equals_the_test_of_each(spark, entries):
    rng = random.Random(11)
    word = lambda low, high: "".join(rng.choices("abé.", k=rng.randint(low, high)))
    files = entries(*((f"/r/{word(1, 9)}/{n}{word(0, 12)}", 1) for n in range(300)), root="/r")
    given = [word(1, 9) for _ in range(6)] + [word(6, 9) for _ in range(60)] + [".ab", "9", "", None, "no such name at all"]
    patterns = spark.createDataFrame([(p, 1) for p in given + given[:4]], "pattern string, name int")
    for subtrees in (False, True):
        kept = ignore.ignore_by_table(files, patterns, subtrees=subtrees, root="/r")
        tested = {r["path"]: r["path"][2:] if subtrees else r["name"] for r in files.collect()}
        wanted = {path for path, text in tested.items() if not any(p in text for p in given if p)}
        got = [r["path"] for r in kept.collect()]
        assert kept.columns == files.columns and set(got) == wanted and len(got) == len(wanted) and (subtrees or 0 < len(got) < 300)
    assert ignore.ignore_by_table(files, patterns.where("pattern = ''")).count() == 300
    unnamed = files.withColumn("name", F.lit(None).cast("string"))
    assert ignore.ignore_by_table(unnamed, patterns).count() == 300


def test_a_hundred_thousand_patterns_without_a_loop(spark, entries):
    files = entries(*((f"/d/file-{n * 37:07d}.log", 1) for n in range(5000)))
    patterns = spark.range(100_000).select(F.format_string("file-%07d", F.col("id") * 3).alias("pattern"))
    kept = ignore.ignore_by_table(files, patterns)
    plan = kept._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    named = [int(r["name"][5:12]) for r in kept.collect()]
    assert sorted(named) == [n * 37 for n in range(5000) if (n * 37) % 3 or n * 37 >= 300_000]
