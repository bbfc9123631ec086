"""One query for each operator, on the whole of its table, and SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import functions as F

from tallyhouse.llm import decontaminate, html_text, langid, licenses, line_dedup, neardup, packing, quality, runs, sharding, spelling, toxicity, warc
from tallyhouse.llm.tables import fold, table
from tallyhouse.session import working_folder, written

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op4_sharding")
def op4_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    rows = written(rows, "sizes")
    return sharding.shuffle_shards(rows, 24, by=["doc_id", "size", "text_crc32"]).select(
        "*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    )


_LINES = r"""
WITH lines AS (
  SELECT doc_id, line, pos,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common ON lines.k = common.k
GROUP BY doc_id
"""


@query("op8_line_dedup", _LINES)
def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_docs=10).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_licenses")
def op10_licenses(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), by=["doc_id"])
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@query("op6_quality")
def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    return quality.judge(docs, labels, by=["doc_id"], strata=["lang"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("rejected_by", ",").alias("rejected_by"),
    )


@query("op7_packing")
def op7_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), by=["doc_id"])


@query("op9_language")
def op9_language(spark, sf_dir):
    held_out = fold(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"), (~held_out).alias("teaches"))
    return langid.identify(docs, "teaches", ["doc_id", "held_out"])


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0), by="doc_id")
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return toxicity.score_toxicity(rows, model).drop("text")


@query("op5_neardup")
def op5_neardup(spark, sf_dir):
    return neardup.join_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), by="doc_id").drop("node", "twins")


@query("op1_decontamination")
def op1_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.overlaps(docs, items, by="doc_id", item="item_id").drop("text_hash")


@query("op3_html_text")
def op3_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    """Every tenth text or so repeats itself from some word on, as the contract plants it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    docs = docs.withColumns({"n": n, "a": (g % F.when(n > 0, n)).cast("int"), "eighth": (g % 8).cast("int")})
    left = F.col("n") - F.col("a")
    docs = docs.withColumn("p", (F.floor(left / (F.col("eighth") + 3)) + 1).cast("int"))
    copies = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), left)), " ")
    text = F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text")
    return runs.periodic_runs(docs.select("doc_id", text), collapsed=False)


@query("op13_spelling_variants")
def op13_spelling_variants(spark, sf_dir):
    """Every 97th or so pair of document and run of letters loses a letter, as the contract plants it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(spelling.runs_of_letters("text")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    docs = docs.withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run"))
    return spelling.group_variants(spelling.vocabulary_of(docs, F.array(word)))


_RECORDS = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
  CASE WHEN bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


@query("op12_warc", _RECORDS)
def op12_warc(spark, sf_dir):
    folder = working_folder(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), folder, by="page_id", uri="url", payload="html")
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return warc.read_archive(spark, folder, payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
