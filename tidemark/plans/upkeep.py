"""Queries over writes with clocks, cursors, log upkeep and the store's files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, vclock
from ..operators import maintain, snapshot, workload
from ..operators.changes import changes
from ..session import scratch, table
from ..sources import store_files
from .store import CHANGES, KEY, LATEST, PREFIX, SINCE

BATCH_ROWS, QUEUE, FLUSH = 15_000, 50, 100
#: What the cursor of kv_cursor_walk does.
MOVES = ("first", "next", "next", "prev", f"seek {PREFIX}", "next", "last", "next", "first", "prev")


def _wal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wal_record")


def kv_sync(spark, d):
    """Changes since a version, deleted keys too, with the version to go on from."""
    return snapshot.sync(_wal(spark, d), SINCE, tombstones=True).select("key", "ver", "tombstone", "upto")


def kv_dump(spark, d):
    return snapshot.dump(_wal(spark, d), KEY).select("key", "value", F.col("ver").alias("version"), "tombstone", "found")


def kv_scan_then_get(spark, d):
    return snapshot.scan_then_get(_wal(spark, d), PREFIX).select("key", "value", "ver")


def kv_cursor_walk(spark, d):
    """Where a cursor stands after each of some moves."""
    cursor, trace = snapshot.Cursor(snapshot.live(_wal(spark, d))), []
    for step, move in enumerate(MOVES):
        name, _, key = move.partition(" ")
        valid = getattr(cursor, name)(*([key] if key else []))
        trace.append((step, move, cursor.pos, cursor.total, valid, cursor.key))
    return spark.createDataFrame(trace, "step int, move string, pos long, total long, valid boolean, key string")


def _entries(spark, d):
    """Write requests as entries: half of them with a version of their own, times and clocks where the caller sent them."""
    rows = table(spark, d, "replica_write").filter("key <> ''")
    once = rows.groupBy("req_id").agg(F.min(F.struct("key", F.base64("value").alias("value"), F.unix_micros(F.col("sent_at").cast("timestamp")).alias("us"))).alias("e"), F.first("vector_clock", ignorenulls=True).alias("vc"))
    return once.select("req_id", "e.key", "e.value", F.when(F.col("req_id") % 2 == 0, F.col("req_id")).otherwise(0).alias("ver"), (F.col("e.us") * 1000).alias("ts"), "vc")


def kv_put_entries(spark, d):
    """Entries as they enter the log: the caller's version, time and clock kept, the others filled in."""
    got = maintain.completed(_wal(spark, d), _entries(spark, d), [F.col("req_id")], now=7, node="node-1")
    return got.select("key", "ver", "ts", vclock.text(F.col("vc")).alias("clock"))


def kv_append_entries(spark, d):
    """The whole log behind the same entries: rows, and how many of them have which clock."""
    got = maintain.append_entries(_wal(spark, d), _entries(spark, d), [F.col("req_id")], now=7)
    return got.groupBy(vclock.text(F.col("vc")).alias("clock")).agg(F.count(F.lit(1)).alias("n"), F.max("ver").alias("top"))


def batch_admission(spark, d):
    return maintain.batch_admission(table(spark, d, "replica_write"), F.when(F.col("req_id") % 5 < 3, 0).otherwise(F.col("req_id") % 5).cast("int"))


def replicate_acks(spark, d):
    """Replicated rows with their answer; rows without key aren't answered."""
    rows = maintain.acknowledged(table(spark, d, "replica_write"))
    return rows.groupBy("ack", "error").agg(F.count(F.lit(1)).alias("n"))


def replication_queue(spark, d):
    """A bounded queue that is flushed after so many requests: taken and dropped by flush."""
    rows = table(spark, d, "replica_write").filter("key <> ''").select("req_id", "key", "target_node").distinct()
    got = maintain.bounded_queue(rows, F.floor(F.col("req_id") / FLUSH), [F.col("req_id"), F.col("key"), F.col("target_node")], QUEUE)
    return got.groupBy("batch").agg(F.count_if("queued").alias("queued"), F.count_if(~F.col("queued")).alias("dropped"), F.min(F.when(~F.col("queued"), F.col("req_id"))).alias("first_dropped"))


def _bytes(spark, d):
    """The log's changes as the store's files hold them."""
    rows = changes(_wal(spark, d), ["value", "vc"])
    return rows.withColumn("value", F.coalesce(F.col("value"), F.lit("")).cast("binary"))


def _log_files(spark, d, noise=b""):
    path = scratch(spark, "log")
    store_files.write_log(_bytes(spark, d), path, 2000, noise).count()
    return path


def log_replay(spark, d):
    """The changes written as segments of the store's log and replayed."""
    rows = store_files.read_log(spark, _log_files(spark, d))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("ver").alias("ver"), F.sum(F.octet_length("value")).alias("bytes"), F.count("vc").alias("clocks"))


def log_salvage(spark, d):
    """The same with bytes between the records that belong to none."""
    rows = store_files.read_log(spark, _log_files(spark, d, b"\xff\xfe\xff\xff\xffbroken"))
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.max("ver").alias("ver"), F.count_distinct("key").alias("keys"))


def log_convert(spark, d):
    """JSON lines made segments of the binary log: nothing is merged or lost."""
    lines = store_files.to_legacy_lines(changes(_wal(spark, d), ["value"]))
    path = scratch(spark, "log")
    rows = store_files.read_legacy_log(lines).withColumn("vc", F.lit(None).cast("map<string,bigint>"))
    store_files.write_log(rows, path).count()
    return store_files.read_log(spark, path).groupBy("key", "op").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))


def log_count_and_size(spark, d):
    path = _log_files(spark, d)
    size = store_files.log_size(spark, path).select("bytes").scalar()
    return store_files.read_log(spark, path).agg(F.count(F.lit(1)).alias("records")).withColumn("bytes", size)


def log_reset(spark, d):
    """Records of a log before and after it was emptied."""
    path = _log_files(spark, d)
    before = store_files.read_log(spark, path).count()
    store_files.reset_log(spark, path)
    left = store_files.log_size(spark, f"{path}").first()
    return spark.createDataFrame([(before, left["files"], left["bytes"])], "before long, files long, bytes long")


def log_truncate(spark, d):
    """The log without what lies before a saved position, in two steps."""
    mark, log = store_files.LogMark(spark, scratch(spark, "mark")), _wal(spark, d)
    low, high = log.agg(F.min("lsn"), F.max("lsn")).first()
    for tenth in (2, 6):
        mark.save((low or 0) + ((high or 0) - (low or 0)) * tenth // 10)
        log = mark.truncate(log, "lsn")
    return log.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("lsn").alias("first"), F.max("lsn").alias("last"))


def _run_files(spark, d):
    state = snapshot.latest(_wal(spark, d))
    rows = state.select("key", F.coalesce(F.col("value"), F.lit("")).cast("binary").alias("value"), F.col("ver").alias("version"), F.col("ts").alias("ts_ns"), "tombstone", F.create_map(F.lit("n"), F.col("ver")).alias("vc"))
    path = scratch(spark, "runs")
    store_files.write_run_files(rows, path, 3, 1_700_000_000).count()
    return path


def run_file_rows(spark, d):
    """The state written as run files of the store and read back."""
    rows = store_files.read_runs(spark, _run_files(spark, d))
    return rows.select("level", "key", F.decode("value", "UTF-8").alias("value"), "version", "ts_ns", "tombstone", F.col("vc")["n"].alias("clock"))


def run_file_get(spark, d):
    """Some keys out of run files; the files' filters rule out most."""
    return store_files.read_runs(spark, _run_files(spark, d), [KEY, "no such key"]).select("key", "version", "tombstone")


def run_listing(spark, d):
    runs = store_files.list_runs(spark, _run_files(spark, d))
    return runs.agg(F.min("level").alias("level"), F.min("run_id").alias("first_run"), (F.count(F.lit(1)) >= 1).alias("some"), (F.min("bytes") > 32).alias("filled"))


def json_document(spark, d):
    """The visible rows as lines of one JSON object."""
    return store_files.export_document(snapshot.live(_wal(spark, d)))


def json_import_counts(spark, d):
    """Rows taken and refused by an import: null values and empty keys are refused and counted."""
    live = snapshot.live(_wal(spark, d)).select(F.when(F.col("ver") % 7 == 0, "").otherwise(F.col("key")).alias("key"), "value", "ver")
    texts = live.select(F.to_json(F.create_map("key", "value")).alias("value"))
    return store_files.import_json(texts).agg(F.count_if("ok").alias("taken"), F.count_if(~F.col("ok")).alias("refused"))


def scalar_paths(spark, d):
    """Keys out of URL paths, and addresses of the other port."""
    keys = table(spark, d, "replica_log").select("key").distinct()
    return keys.select("key", scalar.key_of_path(F.concat(F.lit("/api/v1/get/"), F.url_encode("key")), "/api/v1/get/").alias("found"),
                       scalar.grpc_address(F.concat(F.lit("http://"), F.regexp_replace("key", "[^a-z]", ""), F.lit(".local:9000/x")), 9100).alias("address"))


def scalar_times(spark, d):
    at = F.col("asked_at").cast("timestamp")
    return table(spark, d, "kv_request").filter("asked_at is not null").select("pos", scalar.unix_nanos(at).alias("ns"), scalar.display_time(at).alias("shown"), scalar.rfc3339(at).alias("rfc"))


def scalar_scramble(spark, d):
    return spark.range(20_000).select((F.col("id") * 7919 - 50_000).alias("id")).select("id", workload.scramble(F.col("id")).alias("hash"))


def quorum_feasible(spark, d):
    """Whether so many healthy nodes can serve the default quorums: three replicas, two for writes and reads."""
    return spark.range(5).select(F.col("id").alias("healthy"), scalar.quorum_feasible(F.col("id"), F.lit(2)).alias("write"), scalar.quorum_feasible(F.col("id"), F.lit(2)).alias("read"))


def bulk_load(spark, d):
    """Keys of a bulk loader: 20 clients with 50 batches of 100 keys."""
    return workload.bulk_keys(spark, 20, 50, 100).groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))


QUERIES = {f.__name__: f for f in (
    kv_sync, kv_dump, kv_scan_then_get, kv_cursor_walk, kv_put_entries, kv_append_entries, batch_admission, replicate_acks, replication_queue, log_replay, log_salvage, log_convert,
    log_count_and_size, log_reset, log_truncate, run_file_rows, run_file_get, run_listing, json_document, json_import_counts, scalar_paths, scalar_times, scalar_scramble, quorum_feasible, bulk_load)}

_RAW = CHANGES.replace("value, lsn, node FROM", "value, vc, lsn, node FROM")
_ENTRIES = """e AS (SELECT req_id, min(key) AS key, any_value(vector_clock) AS vc, min(epoch_us(sent_at)) * 1000 AS ts FROM replica_write WHERE key <> '' GROUP BY req_id),
b AS (SELECT coalesce(max(ver), 0) AS base FROM wal_record),
r AS (SELECT key, vc, coalesce(nullif(ts, 0), 7) AS ts, CASE WHEN req_id % 2 = 0 AND req_id <> 0 THEN req_id ELSE base + row_number() OVER (PARTITION BY req_id % 2 = 0 AND req_id <> 0 ORDER BY req_id) END AS ver, row_number() OVER () AS id FROM e, b),
t AS (SELECT id, string_agg(x.key || '=' || x.value, ',' ORDER BY x.key) AS clock FROM (SELECT id, unnest(map_entries(vc)) AS x FROM r) GROUP BY id)"""
_KNOWN = """, k AS (SELECT key, x.key AS n, max(x.value) AS c FROM (SELECT key, unnest(map_entries(vc)) AS x FROM wal_record WHERE key IN (SELECT key FROM r WHERE vc IS NULL)) GROUP BY 1, 2),
i AS (SELECT key, n, c + CASE WHEN n = 'node-1' THEN 1 ELSE 0 END AS c FROM k UNION ALL SELECT DISTINCT key, 'node-1', 1 FROM r WHERE vc IS NULL AND key NOT IN (SELECT key FROM k WHERE n = 'node-1')),
f AS (SELECT key, string_agg(n || '=' || c, ',' ORDER BY n) AS clock FROM i GROUP BY key)"""


def _with(body: str, ctes: str = LATEST) -> str:
    return f"WITH {ctes} {body}"


def _walk() -> str:
    """The moves as positions: each follows from the one before, the rows below the sought key and the number of rows."""
    at, pos = [], "-1"
    for step, move in enumerate(MOVES):
        name = move.partition(" ")[0]
        pos = {"first": "0", "last": "(total - 1)", "seek": "below", "next": f"least({pos} + 1, total)", "prev": f"greatest({pos} - 1, -1)"}[name]
        at.append(f"SELECT {step} AS step, '{move}' AS move, CAST({pos} AS BIGINT) AS pos, total FROM n")
    return " UNION ALL ".join(at)


SQL = {
    "kv_sync": _with(f"SELECT key, ver, tombstone, (SELECT max(ver) FROM latest) AS upto FROM latest WHERE ver > {SINCE}"),
    "kv_dump": _with(f"SELECT key, value, ver AS version, tombstone, NOT tombstone AS found FROM latest WHERE key = '{KEY}'"),
    "kv_scan_then_get": _with(f"SELECT key, value, ver FROM live WHERE starts_with(key, '{PREFIX}')"),
    "kv_cursor_walk": _with(f""", p AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM live), n AS (SELECT count(*) AS total, count(*) FILTER (key < '{PREFIX}') AS below FROM live),
w AS ({_walk()}) SELECT CAST(step AS INTEGER) AS step, move, w.pos, total, p.key IS NOT NULL AS valid, p.key FROM w LEFT JOIN p ON w.pos = p.pos""".replace("  ", " ").lstrip(), LATEST),
    "kv_put_entries": f"WITH {_ENTRIES}{_KNOWN} SELECT r.key, r.ver, r.ts, CASE WHEN r.vc IS NULL THEN f.clock ELSE coalesce(t.clock, '') END AS clock FROM r LEFT JOIN t ON r.id = t.id LEFT JOIN f ON r.key = f.key",
    "kv_append_entries": f"""WITH {_ENTRIES}, w AS (SELECT ver, vc, row_number() OVER () AS id FROM wal_record),
u AS (SELECT id, string_agg(x.key || '=' || x.value, ',' ORDER BY x.key) AS clock FROM (SELECT id, unnest(map_entries(vc)) AS x FROM w) GROUP BY id),
a AS (SELECT coalesce(u.clock, '') AS clock, ver FROM w LEFT JOIN u ON w.id = u.id UNION ALL SELECT coalesce(t.clock, ''), ver FROM r LEFT JOIN t ON r.id = t.id) SELECT clock, count(*) AS n, max(ver) AS top FROM a GROUP BY clock""",
    "batch_admission": """WITH s AS (SELECT CAST(CASE WHEN req_id % 5 < 3 THEN 0 ELSE req_id % 5 END AS INTEGER) AS batch, count(*) AS n,
  CAST(sum(coalesce(octet_length(encode(key)), 0) + coalesce(octet_length(value), 0)) AS BIGINT) AS bytes FROM replica_write GROUP BY 1)
SELECT *, CASE WHEN n > 10000 THEN 'too_many_keys' WHEN bytes > 67108864 THEN 'too_large' ELSE 'ok' END AS status FROM s""",
    "replicate_acks": """SELECT error IS NULL AS ack, error, count(*) AS n FROM (SELECT CASE WHEN key = '' THEN 'empty_key' WHEN octet_length(encode(key)) > 1024 THEN 'key_too_long'
  WHEN octet_length(value) > 1048576 THEN 'value_too_large' END AS error FROM replica_write WHERE key IS NOT NULL) GROUP BY 1, 2""",
    "replication_queue": f"""WITH u AS (SELECT DISTINCT req_id, key, target_node FROM replica_write WHERE key <> ''),
q AS (SELECT *, req_id // {FLUSH} AS batch, row_number() OVER (PARTITION BY req_id // {FLUSH} ORDER BY req_id, key, target_node NULLS FIRST) AS rn FROM u)
SELECT batch, count(*) FILTER (rn <= {QUEUE}) AS queued, count(*) FILTER (rn > {QUEUE}) AS dropped, min(req_id) FILTER (rn > {QUEUE}) AS first_dropped FROM q GROUP BY batch""",
    "log_replay": _with("SELECT key, count(*) AS n, max(ver) AS ver, CAST(sum(coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS bytes, count(vc) AS clocks FROM changes GROUP BY key", _RAW),
    "log_salvage": _with("SELECT op, count(*) AS n, max(ver) AS ver, count(DISTINCT key) AS keys FROM changes GROUP BY op", _RAW),
    "log_convert": _with("SELECT key, op, count(*) AS n, max(ts) AS ts FROM changes GROUP BY key, op", _RAW),
    "log_count_and_size": _with("""SELECT count(*) AS records, CAST(sum(4 + octet_length(encode(key)) + 4 + coalesce(octet_length(encode(value)), 0) + 21 +
  CASE WHEN vc IS NULL THEN 4 ELSE coalesce(list_sum(list_transform(map_entries(vc), lambda x: length(x.key) + length(CAST(x.value AS VARCHAR)) + 6)), 2) END) AS BIGINT) AS bytes FROM changes""", _RAW),
    "log_reset": _with("SELECT count(*) AS before, CAST(0 AS BIGINT) AS files, CAST(0 AS BIGINT) AS bytes FROM changes", _RAW),
    "log_truncate": "SELECT node, count(*) AS n, min(lsn) AS first, max(lsn) AS last FROM wal_record WHERE lsn IS NULL OR lsn >= (SELECT min(lsn) + (max(lsn) - min(lsn)) * 6 // 10 FROM wal_record) GROUP BY node",
    "run_file_rows": _with("SELECT CAST(3 AS INTEGER) AS level, key, coalesce(value, '') AS value, ver AS version, ts AS ts_ns, tombstone, ver AS clock FROM latest"),
    "run_file_get": _with(f"SELECT key, ver AS version, tombstone FROM latest WHERE key = '{KEY}'"),
    "run_listing": "SELECT CAST(3 AS INTEGER) AS level, CAST(1700000000 AS BIGINT) AS first_run, true AS some, true AS filled",
    "json_document": _with("""SELECT pos, '  ' || to_json(key) || ': ' || coalesce(CAST(to_json(value) AS VARCHAR), 'null') || CASE WHEN pos < total - 1 THEN ',' ELSE '' END AS line
FROM (SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS total FROM live)
UNION ALL SELECT -1, '{' UNION ALL SELECT 4611686018427387904, '}'"""),
    "json_import_counts": _with("SELECT count(*) FILTER (ver % 7 <> 0 AND value IS NOT NULL) AS taken, count(*) FILTER (ver % 7 = 0 OR value IS NULL) AS refused FROM live"),
    "scalar_paths": "SELECT DISTINCT key, key AS found, regexp_replace(key, '[^a-z]', '', 'g') || '.local:9100' AS address FROM replica_log",
    "scalar_times": """SELECT pos, epoch_us(asked_at) * 1000 AS ns, strftime(asked_at, '%Y-%m-%d %H:%M:%S') AS shown,
  regexp_replace(strftime(asked_at, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z' AS rfc FROM kv_request WHERE asked_at IS NOT NULL""",
    "scalar_scramble": f"""SELECT id, CAST(list_reduce(list_prepend(CAST('{scalar.FNV64[0]}' AS UHUGEINT), list_transform(range(8), lambda j: CAST((id >> CAST(8 * j AS INTEGER)) & 255 AS UHUGEINT))),
  lambda h, b: (xor(h, b) * CAST('{scalar.FNV64[1]}' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT)) % CAST('9223372036854775808' AS UHUGEINT) AS BIGINT) AS hash
FROM (SELECT CAST(i * 7919 - 50000 AS BIGINT) AS id FROM range(20000) r(i))""",
    "quorum_feasible": "SELECT CAST(i AS BIGINT) AS healthy, i >= 2 AS write, i >= 2 AS read FROM range(5) r(i)",
    "bulk_load": """SELECT c AS client, count(*) AS n, min(printf('bulk:%02d:%02d:%03d', c, b, k)) AS first, max(printf('bulk:%02d:%02d:%03d', c, b, k)) AS last
FROM range(20) x(c), range(50) y(b), range(100) z(k) GROUP BY c""",
}
SQL["kv_cursor_walk"] = SQL["kv_cursor_walk"].replace(") , p AS", "), p AS")
