"""Queries p1 to p3 and p5: the general data-quality problems over the store's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import replay
from ..operators.difference import diff_copies
from ..operators.incremental import Feed
from ..operators.skew import compress, heavy_keys, key_counts, key_profile, weighted_percentiles
from ..session import table

ENTRY_FIELDS = ["value", "version", "tombstone"]
HEAVY_PERCENT = 2


def _newest_entries(log: DataFrame, node: str) -> DataFrame:
    """The entry a node holds of each key: its row of the highest version, a null version being lowest."""
    top = F.max(F.struct("version", "ts_ns", "tombstone", "value")).alias("e")
    return log.filter(F.col("node") == node).groupBy("key").agg(top).select("key", "e.value", "e.version", "e.tombstone")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "replica_log")
    rows = diff_copies(_newest_entries(log, "node-1"), _newest_entries(log, "node-2"), "key", ENTRY_FIELDS)
    side = F.when(F.col("kind") == "only_left", F.array(F.lit("only_node_1"))).when(F.col("kind") == "only_right", F.array(F.lit("only_node_2")))
    return rows.select("key", F.explode(F.coalesce(side, F.col("diff"))).alias("diff"))


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """All rows of both nodes, older versions too, compared as copies with repeated keys: per key the rows paired, the rows
    without partner on either side, and the fields in which pairs differ, which are as few as any pairing has."""
    log = table(spark, d, "replica_log")
    rows = diff_copies(log.filter("node = 'node-1'"), log.filter("node = 'node-2'"), "key", ENTRY_FIELDS)
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return rows.groupBy("key").agg(count("changed").alias("changed"), count("only_left").alias("only_left"), count("only_right").alias("only_right"),
                                   F.sum(F.when(F.col("kind") == "changed", F.size("diff")).otherwise(0)).alias("fields"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    wal = table(spark, d, "wal_record").select(F.lit("wal_record").alias("tbl"), "key", F.col("op").alias("v"))
    writes = table(spark, d, "replica_write").select(F.lit("replica_write").alias("tbl"), "key", F.col("target_node").alias("v"))
    weighted = compress(wal.unionByName(writes), ["tbl", "key"], "v")
    return heavy_keys(weighted, "tbl", "key", HEAVY_PERCENT).select("tbl", "key")


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """Records, distinct values, the most frequent value and its frequency for each key of the log."""
    return key_profile(compress(table(spark, d, "wal_record"), ["key"], "value"), ["key"], "value")


def p2_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Median and 95th percentile of the value's length for each key of the write requests."""
    writes = table(spark, d, "replica_write").select("key", F.octet_length("value").cast("long").alias("bytes"))
    weighted = compress(writes, ["key"], "bytes")
    counts = key_counts(weighted, ["key"]).withColumnRenamed("key", "k")
    found = weighted_percentiles(weighted, ["key"], "bytes", {"p50": 0.5, "p95": 0.95})
    return counts.join(found, F.col("k").eqNullSafe(F.col("key")), "left").select(F.col("k").alias("key"), "n", "p50", "p95")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return replay(table(spark, d, "wal_record"), "lsn").read().select("key", "ver", "ts")


def p3_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The same state after a compaction, with the value each key holds."""
    merged = replay(table(spark, d, "wal_record"), "lsn", runs=3, carry=["value"])
    merged.compact()
    return merged.read().select("key", "ver", "ts")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The next run after those of sync_run: their deliveries are adopted, then the log is run through the feed."""
    feed = Feed(spark)
    feed.adopt(table(spark, d, "sync_run"), table(spark, d, "sync_item"))
    commit = feed.run(table(spark, d, "wal_record"))
    found = feed.output(commit["id"]) if commit["rows"] else None
    return found if found is not None else table(spark, d, "sync_item").select("key", "ver", "ts").limit(0)


QUERIES = {f.__name__: f for f in (p1_found, p1_rows, p2_found, p2_profile, p2_lengths, p3_found, p3_compacted, p5_found)}

_CHANGES = """changes AS (SELECT key, ver, ts, upper(trim(op, ' ' || chr(9))) AS op FROM wal_record
  WHERE key <> '' AND ver IS NOT NULL AND ts IS NOT NULL AND upper(trim(op, ' ' || chr(9))) IN ('PUT', 'DEL'))"""

_STATE = f"""WITH {_CHANGES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ver DESC, ts DESC, op DESC) AS rn FROM changes)
SELECT key, ver, ts FROM ranked WHERE rn = 1 AND op = 'PUT'"""

SQL = {
    "p1_found": """WITH e AS (SELECT DISTINCT node, key, value, version, tombstone FROM (
  SELECT *, rank() OVER (PARTITION BY node, key ORDER BY version DESC NULLS LAST) AS rn FROM replica_log) WHERE rn = 1),
j AS (SELECT coalesce(a.key, b.key) AS key, a.key AS ka, b.key AS kb, a.value AS va, b.value AS vb, a.version AS ra, b.version AS rb,
  a.tombstone AS ta, b.tombstone AS tb FROM (SELECT * FROM e WHERE node = 'node-1') a FULL JOIN (SELECT * FROM e WHERE node = 'node-2') b ON a.key = b.key)
SELECT key, 'only_node_1' AS diff FROM j WHERE kb IS NULL UNION ALL SELECT key, 'only_node_2' FROM j WHERE ka IS NULL
UNION ALL SELECT key, 'value' FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND va IS DISTINCT FROM vb
UNION ALL SELECT key, 'version' FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND ra IS DISTINCT FROM rb
UNION ALL SELECT key, 'tombstone' FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND ta IS DISTINCT FROM tb""",
    "p1_rows": """WITH RECURSIVE net AS (SELECT key, value, version, tombstone, CAST(sum(CASE node WHEN 'node-1' THEN 1 WHEN 'node-2' THEN -1 ELSE 0 END) AS BIGINT) AS s FROM replica_log GROUP BY ALL HAVING s <> 0),
e AS (SELECT key, value, version, tombstone, s > 0 AS own FROM (SELECT *, unnest(range(abs(s))) AS copy FROM net)),
x AS (SELECT *, row_number() OVER (PARTITION BY key, own) AS i FROM e),
n AS (SELECT key, count(*) FILTER (own) AS nl, count(*) FILTER (NOT own) AS nr FROM e GROUP BY key),
o AS (SELECT a.key, a.i, b.i AS j, (a.value IS DISTINCT FROM b.value)::BIGINT + (a.version IS DISTINCT FROM b.version)::BIGINT + (a.tombstone IS DISTINCT FROM b.tombstone)::BIGINT AS cost
  FROM x a JOIN x b ON a.key = b.key WHERE a.own AND NOT b.own UNION ALL SELECT key, i, 0, 0 FROM x WHERE own),
walk(key, i, used, pairs, cost) AS (SELECT key, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM n WHERE nl > 0 AND nr > 0 UNION ALL
  SELECT w.key, o.i, CASE WHEN j = 0 THEN used ELSE used | (CAST(1 AS BIGINT) << CAST(j - 1 AS INTEGER)) END, pairs + CAST(j > 0 AS BIGINT), w.cost + o.cost
  FROM walk w JOIN o ON o.key = w.key AND o.i = w.i + 1 WHERE j = 0 OR (used >> CAST(j - 1 AS INTEGER)) & 1 = 0),
best AS (SELECT w.key, min(w.cost) AS cost FROM walk w JOIN n ON n.key = w.key WHERE w.i = nl AND pairs = least(nl, nr) GROUP BY w.key)
SELECT n.key, least(nl, nr) AS changed, nl - least(nl, nr) AS only_left, nr - least(nl, nr) AS only_right, coalesce(best.cost, 0) AS fields FROM n LEFT JOIN best ON n.key = best.key""",
    "p2_found": """WITH u AS (SELECT 'wal_record' AS tbl, key FROM wal_record UNION ALL SELECT 'replica_write', key FROM replica_write),
t AS (SELECT tbl, count(*) AS total FROM u GROUP BY tbl), c AS (SELECT tbl, key, count(*) AS n FROM u WHERE key <> '' GROUP BY tbl, key)
SELECT c.tbl, c.key FROM c JOIN t ON c.tbl = t.tbl WHERE n * 100 >= total * 2""",
    "p2_profile": """WITH c AS (SELECT key, value, count(*) AS w FROM wal_record GROUP BY key, value),
m AS (SELECT key, value, w, row_number() OVER (PARTITION BY key ORDER BY w DESC, value) AS rn FROM c WHERE value IS NOT NULL),
k AS (SELECT key, CAST(sum(w) AS BIGINT) AS n, count(value) AS n_distinct FROM c GROUP BY key)
SELECT k.key, k.n, k.n_distinct, m.value AS mode, coalesce(m.w, 0) AS mode_n FROM k LEFT JOIN m ON k.key IS NOT DISTINCT FROM m.key AND m.rn = 1""",
    "p2_lengths": """SELECT key, count(*) AS n, quantile_disc(octet_length(value), 0.5) AS p50, quantile_disc(octet_length(value), 0.95) AS p95
FROM replica_write GROUP BY key""",
    "p3_found": _STATE,
    "p3_compacted": _STATE,
    "p5_found": f"""WITH {_CHANGES}, d AS (SELECT key, ver, ts FROM sync_item WHERE run_id IN (SELECT run_id FROM sync_run WHERE status = 'ok'))
SELECT DISTINCT key, ver, ts FROM changes c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.key = c.key AND d.ver = c.ver AND d.ts = c.ts)""",
}
