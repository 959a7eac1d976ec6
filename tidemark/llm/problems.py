"""Queries p4 and p6 to p8: keys seen before, documents and evaluation items; with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import sqlhash
from ..session import table
from .leak import PLANE, leak_hits, leaks
from .lookalike import confusable_tokens, consistent_text, lookalike_classes, lookalike_pairs
from .seen import REMAINDER_BITS, SHARD_KEYS, answered, error_report
from .tokens import edit_check, token_ids


def _seen(query, spark: SparkSession, d: str) -> DataFrame:
    """Both queries build the same filter: one for the log of each writing node, merged."""
    return query(table(spark, d, "kv_request"), table(spark, d, "wal_record"), "pos", "key", "log_end", "lsn", segment="node")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _seen(answered, spark, d).filter("seen").select("pos")


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    """How often the filter of p4_found alone is wrong, measured over all requests and as derived from its widths."""
    return _seen(error_report, spark, d).select("requests", "stored", "positives", "wrong", F.round("measured_rate", 9).alias("measured_rate"), F.round("expected_rate", 9).alias("expected_rate"))


def p4_size(spark: SparkSession, d: str) -> DataFrame:
    """Bits that the filter of p4_found takes for a key, first position included."""
    return _seen(error_report, spark, d).select("stored", F.round("bits_per_key", 3).alias("bits_per_key"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and characters for each layout of texts."""
    rows = token_ids(table(spark, d, "documents").select("source", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "text"), keep=("source", "chars"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("ids")).alias("tokens"), F.sum("chars").alias("chars"))


def p6_edits(spark: SparkSession, d: str) -> DataFrame:
    """Texts of each language, and those of them for which appending, editing and editing the prefix table give the ids of encoding anew."""
    rows = edit_check(table(spark, d, "documents"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(c).alias(c) for c in ("appended", "edited", "table")]).withColumnRenamed("table", "prefixes")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak_hits(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """All overlaps, those with one or two changed words in a window too, with their extent."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), changed=2, masks=PLANE)


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item with the number of documents that hold 13 of its words in a row, and the longest run."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), changed=0)
    per_item = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.max("run_words").alias("longest"))
    items = table(spark, d, "eval_items").select("item_id", "task", "split")
    return items.join(per_item, "item_id", "left").select("item_id", "task", "split", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("longest", F.lit(0)).alias("longest"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its text in consistent form and whether that differs from the text stored."""
    rows = consistent_text(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "form", (~F.col("form").eqNullSafe(F.col("text"))).alias("changed"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each document that has a double in other characters, with its class and the number of its links."""
    return lookalike_classes(table(spark, d, "documents"))


def p8_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words in mixed scripts or wholly in letters that look like another script's."""
    return confusable_tokens(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_errors, p4_size, p6_ids, p6_totals, p6_edits, p7_found, p7_overlaps, p7_items, p8_found, p8_classes, p8_tokens, p8_forms)}

_BITS = "CAST(greatest(0, ceil(log2(greatest(1, {n}) / {keys}))) AS INTEGER)"
#: The filter as a set of fingerprints with first positions: the leading bits of the hash, as many as the widths give.
_FILTER = f"""WITH {{CTES}}, f AS (SELECT node, hash, min(lsn) AS lsn FROM (SELECT w.node, w.lsn, z.hash FROM wal_record w JOIN z ON w.key = z.key WHERE w.lsn IS NOT NULL) GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM f) AS n, (SELECT count(DISTINCT z.hash) FROM kv_request r JOIN z ON r.key = z.key WHERE log_end IS NOT NULL) AS asked),
s AS (SELECT n, greatest({_BITS.format(n='n', keys=SHARD_KEYS)}, {_BITS.format(n='asked', keys=SHARD_KEYS)}) AS sb FROM n),
p AS (SELECT sb + CAST(greatest(3, ceil(log2(greatest(1, n) / pow(2, sb) / 0.75))) AS INTEGER) + {REMAINDER_BITS} AS bits FROM s),
g AS (SELECT hash // CAST(pow(2, 64 - bits) AS UHUGEINT) AS fp, min(lsn) AS lsn FROM f, p GROUP BY 1),
q AS (SELECT DISTINCT r.pos, r.log_end, z.hash // CAST(pow(2, 64 - bits) AS UHUGEINT) AS fp, z.hash FROM kv_request r JOIN z ON r.key = z.key, p WHERE log_end IS NOT NULL),
a AS (SELECT q.pos, bool_or(q.log_end >= f.lsn) AS seen FROM q JOIN g ON q.fp = g.fp AND g.lsn <= q.log_end LEFT JOIN (SELECT hash, min(lsn) AS lsn FROM f GROUP BY hash) f ON f.hash = q.hash GROUP BY q.pos)"""
_HASHED = "keys AS (SELECT DISTINCT key FROM (SELECT key FROM wal_record UNION ALL SELECT key FROM kv_request) WHERE key <> ''), " + sqlhash.hash_texts("z", "keys", "key", "key")

SQL: dict[str, str] = {
    "p4_found": """WITH f AS (SELECT key, min(lsn) AS lsn FROM wal_record WHERE key <> '' GROUP BY key)
SELECT DISTINCT pos FROM kv_request r JOIN f ON r.key = f.key WHERE f.lsn <= r.log_end""",
    "p6_edits": "SELECT lang, count(*) AS docs, count(*) AS appended, count(*) AS edited, count(*) AS prefixes FROM documents GROUP BY lang",
    "p4_errors": _FILTER.replace("{CTES}", _HASHED) + """, c AS (SELECT (SELECT count(DISTINCT pos) FROM q) AS requests, (SELECT count(*) FROM g) AS stored,
  (SELECT count(*) FROM a) AS positives, (SELECT count(*) FROM a WHERE seen IS DISTINCT FROM true) AS wrong)
SELECT requests, stored, positives, wrong, round(CASE WHEN requests - positives + wrong > 0 THEN wrong / (requests - positives + wrong) ELSE 0 END, 9) AS measured_rate,
  round(1 - exp(-stored / pow(2.0, bits)), 9) AS expected_rate FROM c, p""",
}
