"""Queries over the log: reads, maintenance, scalar functions, files and expiry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import scalar
from ..operators import folds, maintain, snapshot
from ..operators.changes import MergeTable, changes
from ..operators.skew import distributed_rank
from ..session import scratch, stream_table, table
from ..sources import store_files
from ..streaming import state

PREFIX, KEY, SINCE, PATTERN = "profile:", "cfg/routing", 100_000_010_000, "tenant/?/*"
RUN_ROWS, BATCH, EXPORT_ROWS = 500, 1000, 200


def _wal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wal_record")


def kv_latest(spark, d):
    return snapshot.latest(_wal(spark, d))


def kv_scan_prefix(spark, d):
    return snapshot.scan(_wal(spark, d), PREFIX).select("key", "value", "ver")


def kv_keys(spark, d):
    return snapshot.scan(_wal(spark, d)).select("key")


def kv_get(spark, d):
    return snapshot.get(_wal(spark, d), KEY).select("key", "value", "ver", "ts")


def kv_since_version(spark, d):
    return snapshot.since(_wal(spark, d), SINCE).select("key", "ver")


def kv_stats(spark, d):
    return snapshot.stats(_wal(spark, d))


def kv_multiget(spark, d):
    return snapshot.multi_get(_wal(spark, d), table(spark, d, "kv_request")).select("key", "value", "ver")


def kv_batch_get_ordered(spark, d):
    return snapshot.batch_get(_wal(spark, d), table(spark, d, "kv_request"))


def kv_batch_get_counts(spark, d):
    got = snapshot.batch_get(_wal(spark, d), table(spark, d, "kv_request"))
    return got.agg(F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missing"))


def kv_seek_ge(spark, d):
    return snapshot.seek(_wal(spark, d), PREFIX).select("key", "ver")


def kv_prev(spark, d):
    return snapshot.previous(_wal(spark, d), PREFIX).select("key", "ver")


def kv_rank_cursor(spark, d):
    return snapshot.global_rank(snapshot.live(_wal(spark, d)).select("key"), [F.col("key")], "pos", "total")


def kv_exists_count(spark, d):
    return snapshot.exists_count(_wal(spark, d), table(spark, d, "kv_request"))


def kv_keys_glob(spark, d):
    return snapshot.glob(_wal(spark, d), PATTERN).select("key")


def kv_scan_page(spark, d):
    return snapshot.page(_wal(spark, d), PREFIX, 25, "p*").select("key")


def kv_delete_many(spark, d):
    dead = maintain.deletes(_wal(spark, d), table(spark, d, "kv_request"), 0)
    return dead.groupBy("existed").agg(F.count(F.lit(1)).alias("n"))


def kv_validate_status(spark, d):
    return maintain.admitted(_wal(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def kv_rmw(spark, d):
    return maintain.read_modify_write(_wal(spark, d), table(spark, d, "kv_request"), lambda v: F.concat(v, F.lit("x"))).select("key", "value", "ver")


def kv_append_puts(spark, d):
    """Writes appended behind the whole log: how many rows it gained and, counted from the highest version before, their first and last one."""
    log = _wal(spark, d)
    puts = changes(log, ["value"]).filter("op = 'PUT'").select("key", "value", "ts").distinct()
    before = log.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("ver"), F.lit(0)).alias("top")).first()
    added = F.when(F.col("ver") > before["top"], F.col("ver") - before["top"])
    return maintain.append_puts(log, puts, "ts").agg((F.count(F.lit(1)) - before["rows"]).alias("n"), F.min(added).alias("first"), F.max(added).alias("last"))


def kv_coalesce_batch(spark, d):
    return maintain.coalesce_batches(_wal(spark, d), "lsn", BATCH)


def log_merge_sorted(spark, d):
    rows = changes(_wal(spark, d), ["node"]).select("key", "ver", "ts", "op", "node").distinct()
    return maintain.merge_runs(rows.filter("node = 'node-1'"), rows.filter("node is null or node <> 'node-1'")).select("key", "ver", "ts", "op")


def log_dedup_ttl(spark, d):
    log = _wal(spark, d)
    now = changes(log).agg(F.max("ts")).first()[0] or 0
    return maintain.dedup_ttl(log, now).select("key", "ver", "ts", "op")


def _runs(spark, d):
    """Runs as the log's blocks of positions would have been flushed: level, bytes of keys and values."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    rows = changes(_wal(spark, d), ["lsn", "value"]).groupBy(F.floor(F.col("lsn") / RUN_ROWS).alias("run_id")).agg(F.sum(size).alias("bytes"))
    return rows.withColumn("level", (F.col("run_id") % 5).cast("int"))


def compact_level_plan(spark, d):
    return maintain.level_plan(_runs(spark, d))


def compact_tier_plan(spark, d):
    return maintain.tier_plan(_runs(spark, d))


def _appended(spark, d, policy):
    """The log appended in four parts, with compaction on the way."""
    merged = MergeTable(spark, carry=["value"], policy=policy, threshold=2)
    for part in range(4):
        merged.append(changes(_wal(spark, d).filter(F.pmod(F.crc32(F.col("ver").cast("string")), F.lit(4)) == part), ["value"]))
    return merged


def compact_equivalence(spark, d):
    """The state after leveled compactions on the way and a whole one at the end."""
    merged = _appended(spark, d, "leveled")
    merged.compact()
    return merged.read().select("key", "value", "ver", "ts")


def compact_tiered(spark, d):
    """The state after size-tiered compactions on the way."""
    return _appended(spark, d, "tiered").read().select("key", "value", "ver", "ts")


def run_stats(spark, d):
    return _runs(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("runs"), F.sum("bytes").alias("bytes"))


def scalar_functions(spark, d):
    keys = table(spark, d, "replica_log").select("key").distinct()
    return keys.select("key", scalar.ring_hash(F.col("key")).alias("crc"), scalar.fnv1a_32(F.col("key")).alias("fnv32"), scalar.byte_sum(F.col("key")).alias("bytesum"),
                       scalar.truncate_text(F.col("key"), 8).alias("short"), scalar.format_bytes(F.octet_length("key") * 1000).alias("size"))


def scalar_fnv64(spark, d):
    return table(spark, d, "replica_log").select("key").distinct().select("key", scalar.fnv1a_64(F.col("key")).alias("fnv64"), scalar.fnv1a_64_second(F.col("key")).alias("second"))


def scalar_hosts(spark, d):
    return table(spark, d, "cluster_member").select("node", "address", scalar.host_of(F.col("address")).alias("host"))


def quorum_validate(spark, d):
    n, w, r = F.floor(F.col("id") / 25), F.floor(F.col("id") / 5) % 5, F.col("id") % 5
    return spark.range(125).select(n.alias("n"), w.alias("w"), r.alias("r"), scalar.quorum_status(n, w, r).alias("status"))


def _ttl_ops(spark, d):
    hours = (F.col("ver") % 48 + 1) * 3_600_000
    return changes(_wal(spark, d)).select("key", F.when(F.col("op") == "PUT", "add").otherwise("remove").alias("op"), hours.alias("ttl_ms"), F.floor(F.col("ts") / 1_000_000).alias("ts_ms"))


def ttl_expired(spark, d):
    ops = _ttl_ops(spark, d)
    now = ops.agg(F.max("ts_ms")).first()[0] or 0
    return folds.expired(ops, F.lit(now))


def ttl_is_expired(spark, d):
    ops = _ttl_ops(spark, d)
    now = ops.agg(F.max("ts_ms")).first()[0] or 0
    return folds.is_expired(ops, table(spark, d, "kv_request").filter("key <> ''"), F.lit(now))


def ttl_remaining(spark, d):
    ops = _ttl_ops(spark, d)
    now = ops.agg(F.max("ts_ms")).first()[0] or 0
    return folds.remaining(ops, table(spark, d, "kv_request").filter("key <> ''"), F.lit(now))


def engine_state(spark, d):
    """The newest change of each key written through the engine with its clock, some keys deleted, and read back by prefix."""
    e = Engine(spark, buckets=4)
    log = snapshot.latest(_wal(spark, d))
    e.write(log.select(F.when(F.col("tombstone"), "DEL").otherwise("PUT").alias("op"), "key", "value", "ver", "ts", F.create_map(F.lit("n"), F.col("ver")).alias("vc")))
    e.delete(KEY, "no such key")
    e.put(PREFIX + "!new", "x", ts=5)
    rows = e.scan().filter(F.col("key").startswith(PREFIX) | F.col("key").startswith("cfg/"))
    return rows.join(e.clocks(), "key").select("key", "value", "ver", "clock")


def row_cache_stale(spark, d):
    """Cached rows (each key's requests at their log end) that a newer position has made stale, and those kept."""
    newest = _wal(spark, d).filter("key <> ''").groupBy("key").agg(F.max("lsn").alias("lsn"))
    cached = table(spark, d, "kv_request").filter("key <> ''").groupBy("key").agg(F.max("log_end").alias("at"))
    return cached.join(newest, "key").select(F.when(F.col("lsn") > F.col("at"), "stale").otherwise("kept").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def epoch_sequence(spark, d):
    """A sequence number within each attempt of the runs, in order of run_id, that starts again with each attempt."""
    runs = table(spark, d, "sync_run").select("run_id", "attempt")
    numbered = distributed_rank(runs, ["attempt"], [F.col("run_id")], "seq")
    return numbered.groupBy("attempt").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_distinct("seq").alias("n"))


def log_json_lines(spark, d):
    """The changes as JSON lines and read back."""
    lines = store_files.to_legacy_lines(changes(_wal(spark, d), ["value"]))
    return store_files.read_legacy_log(lines).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.max("ver").alias("max_ver"), F.sum(F.length("key")).alias("chars"))


def json_export(spark, d):
    return store_files.export_json(snapshot.live(_wal(spark, d)).filter(F.col("value").isNotNull()), EXPORT_ROWS)


def json_import(spark, d):
    texts = store_files.export_json(snapshot.live(_wal(spark, d)).filter(F.col("value").isNotNull()), EXPORT_ROWS)
    return store_files.import_json(texts, "json").select("key", "value", "ok")


def parquet_run(spark, d):
    """The state written as a sorted run with a Bloom filter and read back by prefix."""
    path = scratch(spark, "sorted-run")
    store_files.write_run(snapshot.live(_wal(spark, d)), path)
    return spark.read.parquet(path).filter(F.col("key").startswith(PREFIX)).select("key", "ver")


def stream_latest(spark, d):
    """The log tailed as a stream of files into a merge table."""
    log = _wal(spark, d)
    merged = MergeTable(spark)
    stream = stream_table(spark, d, "wal_record", log.schema, maxFilesPerTrigger=4)
    state.materialize(stream, merged).awaitTermination()
    return merged.read().select("key", "ver", "ts")


QUERIES = {f.__name__: f for f in (
    kv_latest, kv_scan_prefix, kv_keys, kv_get, kv_since_version, kv_stats, kv_multiget, kv_batch_get_ordered, kv_batch_get_counts, kv_seek_ge, kv_prev,
    kv_rank_cursor, kv_exists_count, kv_keys_glob, kv_scan_page, kv_delete_many, kv_validate_status, kv_rmw, kv_append_puts, kv_coalesce_batch, log_merge_sorted,
    log_dedup_ttl, compact_level_plan, compact_tier_plan, compact_equivalence, compact_tiered, run_stats, scalar_functions, scalar_fnv64, scalar_hosts, quorum_validate,
    ttl_expired, ttl_is_expired, ttl_remaining, engine_state, row_cache_stale, epoch_sequence, log_json_lines, json_export, json_import, parquet_run, stream_latest)}

CHANGES = """changes AS (SELECT key, ver, ts, upper(trim(op, ' ' || chr(9))) AS op, value, lsn, node FROM wal_record
  WHERE key <> '' AND ver IS NOT NULL AND ts IS NOT NULL AND upper(trim(op, ' ' || chr(9))) IN ('PUT', 'DEL'))"""
LATEST = CHANGES + """, latest AS (SELECT key, value, ver, ts, op = 'DEL' AS tombstone FROM (SELECT *, row_number() OVER
  (PARTITION BY key ORDER BY ver DESC, ts DESC, op DESC, value DESC NULLS LAST) AS rn FROM changes) WHERE rn = 1),
live AS (SELECT key, value, ver, ts FROM latest WHERE NOT tombstone)"""
_RUNS = CHANGES + f""", runs AS (SELECT lsn // {RUN_ROWS} AS run_id, CAST(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS bytes,
  CAST((lsn // {RUN_ROWS}) % 5 AS INT) AS level FROM changes GROUP BY 1, 3)"""
_TTL = CHANGES + """, ops AS (SELECT key, CASE op WHEN 'PUT' THEN 'add' ELSE 'remove' END AS op, (ver % 48 + 1) * 3600000 AS ttl_ms, ts // 1000000 AS ts_ms FROM changes),
ttl AS (SELECT key, ts_ms + ttl_ms AS expire_at, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, op DESC, ttl_ms DESC) AS rn FROM ops) WHERE rn = 1)"""
_TIERS = "CASE WHEN bytes < 1048576 THEN 0 WHEN bytes < 10485760 THEN 1 WHEN bytes < 104857600 THEN 2 WHEN bytes < 1073741824 THEN 3 ELSE 4 END"

#: CRC-32 in SQL: the table of a byte's remainders, and the hash of a text given in hexadecimal as h.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""
BYTES = "list_transform(range(1, length(h) // 2 + 1), lambda j: CAST('0x' || substr(h, 2 * j - 1, 2) AS BIGINT))"
CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {BYTES}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _with(body: str, ctes: str = LATEST) -> str:
    return f"WITH {ctes} {body}"


SQL = {
    "kv_latest": _with("SELECT * FROM latest"),
    "kv_scan_prefix": _with(f"SELECT key, value, ver FROM live WHERE starts_with(key, '{PREFIX}')"),
    "kv_keys": _with("SELECT key FROM live"),
    "kv_get": _with(f"SELECT key, value, ver, ts FROM live WHERE key = '{KEY}'"),
    "kv_since_version": _with(f"SELECT key, ver FROM live WHERE ver > {SINCE}"),
    "kv_stats": _with("""SELECT count(*) FILTER (NOT tombstone) AS live_keys, CAST(coalesce(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0))
  FILTER (NOT tombstone), 0) AS BIGINT) AS live_bytes, count(*) FILTER (tombstone) AS tombstones, max(ver) AS max_version FROM latest"""),
    "kv_multiget": _with("SELECT key, value, ver FROM live WHERE key IN (SELECT key FROM kv_request)"),
    "kv_batch_get_ordered": _with("SELECT r.pos, r.key, l.value, l.ver, l.ver IS NOT NULL AS found FROM kv_request r LEFT JOIN live l ON r.key = l.key"),
    "kv_batch_get_counts": _with("SELECT count(*) FILTER (l.ver IS NOT NULL) AS found, count(*) FILTER (l.ver IS NULL) AS missing FROM kv_request r LEFT JOIN live l ON r.key = l.key"),
    "kv_seek_ge": _with(f"SELECT key, ver FROM live WHERE key >= '{PREFIX}' ORDER BY key LIMIT 1"),
    "kv_prev": _with(f"SELECT key, ver FROM live WHERE key < '{PREFIX}' ORDER BY key DESC LIMIT 1"),
    "kv_rank_cursor": _with("SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS total FROM live"),
    "kv_exists_count": _with("SELECT count(*) AS n FROM kv_request r JOIN live l ON r.key = l.key"),
    "kv_keys_glob": _with("SELECT key FROM live WHERE key LIKE 'tenant/_/%'"),
    "kv_scan_page": _with(f"SELECT key FROM live WHERE key > '{PREFIX}' AND key LIKE 'p%' ORDER BY key LIMIT 25"),
    "kv_delete_many": _with("SELECT existed, count(*) AS n FROM (SELECT k.key, l.key IS NOT NULL AS existed FROM (SELECT DISTINCT key FROM kv_request WHERE key <> '') k LEFT JOIN live l ON k.key = l.key) GROUP BY existed"),
    "kv_validate_status": """SELECT CASE WHEN key IS NULL OR key = '' THEN 'empty_key' WHEN octet_length(encode(key)) > 1024 THEN 'key_too_long'
  WHEN octet_length(encode(value)) > 1048576 THEN 'value_too_large' ELSE 'ok' END AS status, count(*) AS n FROM wal_record GROUP BY 1""",
    "kv_rmw": _with("SELECT key, value || 'x' AS value, (SELECT max(ver) FROM wal_record) + row_number() OVER (ORDER BY key) AS ver FROM live WHERE key IN (SELECT key FROM kv_request WHERE key <> '')"),
    "kv_append_puts": _with("SELECT count(*) AS n, CAST(1 AS BIGINT) AS first, count(*) AS last FROM (SELECT DISTINCT key, value, ts FROM changes WHERE op = 'PUT')"),
    "kv_coalesce_batch": _with(f"""SELECT batch, key, ver, ts, op FROM (SELECT *, row_number() OVER (PARTITION BY batch, key ORDER BY lsn DESC, ver DESC, ts DESC, op DESC) AS rn
  FROM (SELECT *, lsn // {BATCH} AS batch FROM changes)) WHERE rn = 1"""),
    "log_merge_sorted": _with("SELECT key, ver, ts, op FROM (SELECT DISTINCT key, ver, ts, op, node FROM changes)"),
    "log_dedup_ttl": _with("SELECT key, ver, ts, CASE WHEN tombstone THEN 'DEL' ELSE 'PUT' END AS op FROM latest WHERE NOT (tombstone AND (SELECT max(ts) FROM changes) - ts > 86400000000000)"),
    "compact_level_plan": _with("""SELECT level, n, capacity FROM (SELECT *, row_number() OVER (ORDER BY level) - 1 AS rn FROM (
  SELECT level, count(*) AS n, CAST(floor(4 * pow(2.0, level)) AS BIGINT) AS capacity FROM runs GROUP BY level) WHERE n >= capacity) WHERE rn = level""", _RUNS),
    "compact_tier_plan": _with(f"SELECT CAST({_TIERS} AS INT) AS tier, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM runs GROUP BY 1 HAVING count(*) >= 4 ORDER BY 1 LIMIT 1", _RUNS),
    "compact_equivalence": _with("SELECT key, value, ver, ts FROM live"),
    "compact_tiered": _with("SELECT key, value, ver, ts FROM live"),
    "run_stats": _with("SELECT level, count(*) AS runs, CAST(sum(bytes) AS BIGINT) AS bytes FROM runs GROUP BY level", _RUNS),
    "scalar_functions": f"""WITH {CRC_TABLE}, k AS (SELECT DISTINCT key, hex(encode(key)) AS h FROM replica_log)
SELECT key, {CRC} AS crc, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {BYTES}), lambda x, b: (xor(x, b) * 16777619) & 4294967295) AS fnv32,
  CAST(list_sum(list_transform(range(1, length(h) // 2 + 1), lambda j: j * CAST('0x' || substr(h, 2 * j - 1, 2) AS BIGINT))) AS BIGINT) AS bytesum,
  CASE WHEN length(key) > 8 THEN substr(key, 1, 5) || '...' ELSE key END AS short,
  CASE WHEN length(h) // 2 * 1000 >= 1024 THEN printf('%.2f KB', length(h) // 2 * 1000 / 1024.0) ELSE printf('%d B', length(h) // 2 * 1000) END AS size FROM k, crc_table""",
    "scalar_fnv64": f"""WITH k AS (SELECT DISTINCT key, hex(encode(key)) AS h FROM replica_log), a AS (SELECT key, list_reduce(list_prepend(CAST('{scalar.FNV64[0]}' AS UHUGEINT),
  list_transform({BYTES}, lambda b: CAST(b AS UHUGEINT))), lambda x, b: (xor(x, b) * CAST('{scalar.FNV64[1]}' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT)) AS f FROM k),
m AS (SELECT key, f, (xor(f, f // 131072) * CAST('{scalar.MIX}' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS s FROM a)
SELECT key, CAST(f AS VARCHAR) AS fnv64, CAST(xor(s, s // 2147483648) AS VARCHAR) AS second FROM m""",
    "scalar_hosts": "SELECT node, address, regexp_extract(address, '^(?:[a-z]+://)?([^:/]*)', 1) AS host FROM cluster_member",
    "quorum_validate": """SELECT n, w, r, CASE WHEN n <= 0 OR w <= 0 OR r <= 0 OR w > n OR r > n THEN 'invalid_quorum' WHEN w + r <= n THEN 'no_overlap' ELSE 'ok' END AS status
  FROM range(5) a(n), range(5) b(w), range(5) c(r)""",
    "ttl_expired": _with("SELECT key, expire_at FROM ttl WHERE op = 'add' AND expire_at < (SELECT max(ts_ms) FROM ops)", _TTL),
    "ttl_is_expired": _with("""SELECT k.key, coalesce(t.expire_at < (SELECT max(ts_ms) FROM ops), true) AS expired FROM (SELECT DISTINCT key FROM kv_request WHERE key <> '') k
  LEFT JOIN ttl t ON k.key = t.key AND t.op = 'add'""", _TTL),
    "ttl_remaining": _with("""SELECT k.key, t.expire_at - (SELECT max(ts_ms) FROM ops) AS left_ms FROM (SELECT DISTINCT key FROM kv_request WHERE key <> '') k
  LEFT JOIN ttl t ON k.key = t.key AND t.op = 'add'""", _TTL),
    "engine_state": _with(f"""SELECT key, value, ver, 'n=' || ver AS clock FROM live WHERE (starts_with(key, '{PREFIX}') OR starts_with(key, 'cfg/')) AND key <> '{KEY}'
UNION ALL SELECT '{PREFIX}!new', 'x', max(ver) + 2, '' FROM latest"""),
    "row_cache_stale": """SELECT CASE WHEN lsn > asked THEN 'stale' ELSE 'kept' END AS state, count(*) AS n FROM (SELECT key, max(log_end) AS asked FROM kv_request WHERE key <> '' GROUP BY key)
  JOIN (SELECT key, max(lsn) AS lsn FROM wal_record WHERE key <> '' GROUP BY key) USING (key) GROUP BY 1""",
    "epoch_sequence": "SELECT attempt, CAST(1 AS BIGINT) AS first, count(*) AS last, count(*) AS n FROM sync_run GROUP BY attempt",
    "log_json_lines": _with("SELECT op, count(*) AS n, max(ver) AS max_ver, CAST(sum(length(key)) AS BIGINT) AS chars FROM changes GROUP BY op"),
    "json_export": _with(f"""SELECT block, '{{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}}' AS json FROM (
  SELECT key, value, (row_number() OVER (ORDER BY key) - 1) // {EXPORT_ROWS} AS block FROM live WHERE value IS NOT NULL) GROUP BY block"""),
    "json_import": _with("SELECT key, value, true AS ok FROM live WHERE value IS NOT NULL"),
    "parquet_run": _with(f"SELECT key, ver FROM live WHERE starts_with(key, '{PREFIX}')"),
    "stream_latest": _with("SELECT key, ver, ts FROM live"),
}
