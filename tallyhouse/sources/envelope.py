"""Results as JSON documents and back."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse import schema as S
from tallyhouse.functions.predicates import _member, all_of_untyped

INPUT_KINDS = ("top", "find", "dirs", "ext", "empty", "old", "filter", "growth")


def _json(value: Column, keep_nulls: bool) -> Column:
    return F.to_json(value, {"ignoreNullFields": str(not keep_nulls).lower()})


def _document(kind: str, parts: dict, keep_nulls: bool = False) -> Column:
    """{schema_version, kind, ...} as JSON text; parts are columns or plain values."""
    columns = [F.lit(S.SCHEMA_VERSION).alias("schema_version"), F.lit(kind).alias("kind")]
    for name, value in parts.items():
        column = value if isinstance(value, Column) else F.lit(value)
        columns.append((column.cast("string") if value is None else column).alias(name))
    return _json(F.struct(*columns), keep_nulls).alias("json")


def records_list(rows: DataFrame, order_by, limit: int) -> DataFrame:
    """One row, one column `records`: the first `limit` rows by `order_by` as an ordered list."""
    first = rows.orderBy(*order_by).limit(limit)
    placed = first.select(
        F.row_number().over(Window.orderBy(*order_by)).alias("_at"),
        F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_record"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_record")))
    return placed.agg(F.transform(ordered, lambda r: r["_record"]).alias("records"))


def envelope_json(
    rows: DataFrame, kind: str, order_by, limit: int, extra: dict | None = None, keep_nulls: bool = False
) -> DataFrame:
    """One row, one column `json`: {schema_version, kind, ..., records}.

    The document holds the first `limit` rows by `order_by`; that bound is what
    makes a single document possible, so larger results go to `records_ndjson`.
    NULL fields are left out unless `keep_nulls` is set.
    """
    listed = records_list(rows, order_by, limit)
    return listed.select(_document(kind, {**(extra or {}), "records": F.col("records")}, keep_nulls))


def cleanup_json(hits: DataFrame, limit: int = 100) -> DataFrame:
    """The document of a cleanup preview: hits, totals per category, and their sum.

    The totals are taken over the listed hits, so the hits are computed once.
    """
    listed = records_list(hits, [F.desc("bytes"), F.asc("path")], limit)

    def total(items, field):
        return F.aggregate(items, F.lit(0).cast("long"), lambda acc, r: acc + r[field])

    def of_category(category):
        own = F.filter("records", lambda r: r["category"] == category)
        return F.struct(
            category.alias("category"),
            F.size(own).cast("long").alias("paths"),
            total(own, "bytes").alias("bytes"),
            total(own, "files").alias("files"),
        )

    categories = F.array_sort(F.array_distinct(F.transform("records", lambda r: r["category"])))
    by_bytes = F.array_sort(
        F.transform(categories, of_category),
        lambda a, b: F.when(a["bytes"] > b["bytes"], -1).when(a["bytes"] < b["bytes"], 1).otherwise(0),
    )
    parts = {
        "applied": False,
        "removed": F.array().cast("array<string>"),
        "records": F.col("records"),
        "summary": by_bytes,
        "total_bytes": total(F.col("records"), "bytes"),
    }
    return listed.select(_document("cleanup", parts))


def forget_json(plan: DataFrame) -> DataFrame:
    """The document of a retention plan: all its snapshots, newest id first.

    One row per snapshot is what a single document can hold; nothing is cut.
    """
    fields = ("id", "path", "bytes", "created", "reasons", "action")
    listed = plan.agg(F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("records"))

    def with_action(action, *fields):
        chosen = F.filter("records", lambda r: r["action"] == action)
        return F.transform(chosen, lambda r: F.struct(*(r[f].alias(f) for f in fields)))

    skipped = F.filter("records", lambda r: r["action"] == "skipped")
    removed = with_action("removed", "id", "path", "bytes", "created")
    parts = {
        "applied": False,
        "kept": with_action("kept", "id", "path", "bytes", "reasons"),
        "removed": removed,
        "skipped_unparseable": F.transform(skipped, lambda r: r["id"]),
        "total_removed_bytes": F.aggregate(removed, F.lit(0).cast("long"), lambda acc, r: acc + r["bytes"]),
    }
    return listed.select(_document("forget", parts))


def growth_n_json(rows: DataFrame, n_snapshots: int, limit: int, fill_target: int | None = None) -> DataFrame:
    """The document of `growth_over_n`, each sample a pair of second and bytes."""
    pairs = F.transform("sample_paths_ts", lambda s: F.array(s["ts"], s["bytes"]))
    extra = {"n_snapshots": n_snapshots, "fill_target": fill_target}
    order = [F.desc("slope_bytes_per_day"), F.asc("path")]
    return envelope_json(rows.withColumn("sample_paths_ts", pairs), "growth_n", order, limit, extra, keep_nulls=True)


def predict_json(prediction: DataFrame) -> DataFrame:
    """The document of a prediction: one record, NULLs included except for the reason."""
    named = [c for c in prediction.columns if c != "reason"]

    def with_record(*fields):
        return _document("predict", {"record": F.struct(*fields)}, keep_nulls=True)

    text = F.when(F.col("reason").isNull(), with_record(*named)).otherwise(with_record(*named, "reason"))
    return prediction.select(text.alias("json"))


def records_ndjson(rows: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """One JSON text per row, column `value`; write it with `.write.text`."""
    return rows.select(_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), keep_nulls).alias("value"))


def envelope_read(
    spark: SparkSession, path: str, record_schema, kinds=INPUT_KINDS, whole_files: bool = False
) -> DataFrame:
    """Records of every document below `path`, with `kind` in front.

    There is one document per line, or per file with `whole_files`.  Reading
    fails on anything that is no such document, has another schema version or
    a kind not in `kinds`, and on any record that does not fit `record_schema`.
    """
    texts = spark.read.text(path, wholetext=whole_files).where(F.trim("value") != "")
    return parse_envelopes(texts, "value", record_schema, kinds)


def _checked(version: Column, kind: Column, records: Column, kinds) -> Column:
    """`records`, or a failure where they are no document's that is accepted here."""
    fault = (
        F.when(version.isNull(), "not a document with a schema_version")
        .when(version != S.SCHEMA_VERSION, F.concat(F.lit("incompatible schema_version "), version))
        .when(kind.isNull(), "document without a kind")
        .when(~kind.isin(list(kinds)), F.concat(F.lit("kind not accepted here: "), kind))
    )
    # The check sits inside the exploded value, so no plan can skip it.
    return F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(records)


def parse_envelopes(texts: DataFrame, column: str, record_schema, kinds=INPUT_KINDS) -> DataFrame:
    record = T.StructType.fromDDL(record_schema) if isinstance(record_schema, str) else record_schema
    shape = T.StructType(
        [
            T.StructField("schema_version", T.LongType()),
            T.StructField("kind", T.StringType()),
            # as text first: one record that does not fit must not take its neighbours along
            T.StructField("records", T.ArrayType(T.StringType())),
        ]
    )
    parsed = texts.select(F.from_json(column, shape).alias("doc"))
    kind = F.col("doc.kind")
    checked = _checked(F.col("doc.schema_version"), kind, F.col("doc.records"), kinds)
    texts = parsed.select(kind.alias("kind"), F.explode(checked).alias("text"))
    fitted = F.from_json("text", record, {"mode": "FAILFAST"})
    return texts.select("kind", fitted.alias("record")).select("kind", "record.*")


def read_untyped(spark: SparkSession, path: str, kinds=INPUT_KINDS, whole_files: bool = False) -> DataFrame:
    """(kind, record) for every record of every document below `path`, the record a VARIANT.

    Records may have any shape, each its own; what is no document fails as in `envelope_read`.
    """
    texts = spark.read.text(path, wholetext=whole_files).where(F.trim("value") != "")
    return parse_untyped(texts, "value", kinds)


def parse_untyped(texts: DataFrame, column: str, kinds=INPUT_KINDS) -> DataFrame:
    document = texts.select(F.try_parse_json(column).alias("doc"))
    parts = {"schema_version": "long", "kind": "string", "records": "array<variant>"}
    version, kind, records = (F.try_variant_get("doc", f"$.{name}", target) for name, target in parts.items())
    return document.select(kind.alias("kind"), F.explode(_checked(version, kind, records, kinds)).alias("record"))


def filter_untyped(records: DataFrame, where, limit: int = 1000, order_by=()) -> DataFrame:
    """Rows (kind, record) whose record meets `where`, at most `limit`, ordered by text fields of the record.

    A record that lacks a field or has another type there satisfies only `!=`, and never
    keeps the others from being read.  Equal fields are ordered by the whole record.
    """
    kept = records.where(all_of_untyped("record", where))
    if order_by:
        fields = [F.try_variant_get("record", _member(field), "string") for field in order_by]
        kept = kept.orderBy(*fields, F.to_json("record"))
    return kept.limit(limit)


def rows_as_json(rows: DataFrame) -> DataFrame:
    """Any result as one JSON object per row, column `value`, NULLs included.

    Decimals become strings, timestamps and times microseconds, dates days, binary a size
    note, maps lists of {key, value}, intervals {months, days, nanos}, and
    floating numbers without a JSON form NULL.
    """
    ready = [_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.select(_json(F.struct(*ready), keep_nulls=True).alias("value"))


def _plain(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType):
        return value.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        # Read as UTC whatever the session zone is.
        return F.unix_micros(F.concat(value.cast("string"), F.lit("Z")).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(value)
    if isinstance(kind, T.TimeType):
        return (value.cast("decimal(20,6)") * 1_000_000).cast("long")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("<blob:"), F.octet_length(value).cast("string"), F.lit(" bytes>"))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _plain(item, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        return F.transform(
            F.map_entries(value),
            lambda entry: F.struct(
                _plain(entry["key"], kind.keyType).alias("key"),
                _plain(entry["value"], kind.valueType).alias("value"),
            ),
        )
    if isinstance(kind, T.DayTimeIntervalType):
        def part(name):
            return F.extract(F.lit(name), value)

        seconds = (part("HOUR") * 60 + part("MINUTE")) * 60 + part("SECOND")
        nanos = (seconds * 1_000_000_000).cast("long")
        parts = {"months": F.lit(0), "days": part("DAY").cast("int"), "nanos": nanos}
        return F.when(value.isNotNull(), F.struct(*(p.alias(n) for n, p in parts.items())))
    if isinstance(kind, T.YearMonthIntervalType):
        months = F.extract(F.lit("YEAR"), value) * 12 + F.extract(F.lit("MONTH"), value)
        parts = {"months": months, "days": F.lit(0), "nanos": F.lit(0).cast("long")}
        return F.when(value.isNotNull(), F.struct(*(p.alias(n) for n, p in parts.items())))
    return value
