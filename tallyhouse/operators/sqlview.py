"""Free SQL over a snapshot."""

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Spark's parser makes of statements that do more than ask.
_NO_QUERIES = ("Command", "ParsedStatement")


def _without_comments(sql: str) -> str:
    """The text from its first word on; comments may be nested."""
    depth = 0
    while sql:
        if depth and sql.startswith("*/"):
            depth, sql = depth - 1, sql[2:]
        elif sql.startswith("/*"):
            depth, sql = depth + 1, sql[2:]
        elif depth:
            sql = sql[1:]
        elif sql.startswith("--"):
            sql = sql.partition("\n")[2]
        elif sql[0].isspace():
            sql = sql[1:]
        else:
            break
    return sql


def _only_asks(spark: SparkSession, sql: str) -> bool:
    """Whether no part of the statement, at any depth, is a command or a write."""
    jvm = spark._jvm
    kinds = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}") for name in _NO_QUERIES]
    nodes = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while nodes:
        node = nodes.pop()
        if any(kind.isInstance(node) for kind in kinds):
            return False
        for some in (node.children(), node.innerChildren()):
            nodes += [some.apply(i) for i in range(some.size())]
    return True


def sql_query(
    spark: SparkSession, sql: str, files: DataFrame, meta: DataFrame, limit: int = 1000, snapshot_ids: list[str] | None = None
) -> DataFrame:
    """At most `limit` rows of a Spark SQL query over `files` and `scan_meta`.

    The query is put behind two common table expressions of those names, which
    hide the session's own tables of the same name and leave them alone; they
    read views with names of their own that are dropped again.  Spark's parser
    decides whether it is a query: a statement with a command or a write in any
    place is refused before anything runs.  Comments may come first.  Of `meta`
    the snapshots in `snapshot_ids` are seen, or, without it, those that a pass
    over `files` finds there.
    """
    body = _without_comments(sql).rstrip().rstrip(";")
    recursive, rest = "", body
    if start := re.match(r"with\b(\s+recursive\b)?", body, re.I):
        recursive, rest = start[1] or "", body[start.end() :]
    elif not re.match(r"(select|values|from|table)\b|\(", body, re.I):
        raise ValueError("only queries are accepted")
    if snapshot_ids is None:
        held = meta.join(files.select(F.col("snapshot_id")).distinct(), "snapshot_id", "left_semi")
    else:
        held = meta.where(F.col("snapshot_id").isin(list(snapshot_ids)))
    views = {name: f"tallyhouse_{uuid.uuid4().hex}" for name in ("files", "scan_meta")}
    heads = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
    whole = f"WITH{recursive} {heads}{',' + rest if rest is not body else ' ' + body}"
    try:
        asks = _only_asks(spark, whole)
    except Py4JJavaError:
        # not SQL: spark.sql says what is wrong with it
        asks = True
    if not asks:
        raise ValueError("only queries are accepted")
    for name, rows in (("files", files), ("scan_meta", held)):
        rows.createOrReplaceTempView(views[name])
    try:
        return spark.sql(whole).limit(limit)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
