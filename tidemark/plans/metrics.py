"""Queries over latencies, heartbeats, request metrics, alerts and workloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, folds, maintain, snapshot, workload
from ..operators.changes import changes
from ..operators.skew import floor_rank, nearest_rank, scaled_rank
from ..session import checkpoint, scratch, stream_table, table
from ..sources import store_files
from ..streaming import state
from . import sqlhash

#: Upper bounds of the histogram of request durations, in seconds.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]
STEP = 3600  # seconds between the scrapes of gauges and counters that are shown
SCRAPE = 5  # seconds between the scrapes that alerts work on
COMPACTION = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]
LATENCY = {"view": 0.1, "purchase": 0.05}  # views stand for reads, purchases for writes; bounds in seconds
NOW_LATER = 600  # seconds after the last event at which detectors are asked


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Requests: node, op, ms, ok, and their time."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("node-"), (F.col("event_id") % 3 + 1).cast("string")).alias("node"),
                    F.col("event_type").alias("op"), F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok"), "user_id")


def _now(events: DataFrame) -> Column:
    return F.lit(events.agg(F.max("ts")).first()[0]) + F.expr(f"interval {NOW_LATER} seconds")


def _summary(spark, d, rank):
    rows = analytics.latency_summary(_events(spark, d), "op", "ms", "ok", rank)
    return rows.withColumn("avg_ms", F.round("avg_ms", 6))


def latency_summary_nearest(spark, d):
    return _summary(spark, d, nearest_rank)


def latency_summary_ycsb(spark, d):
    return _summary(spark, d, scaled_rank)


def latency_summary_floor(spark, d):
    return _summary(spark, d, floor_rank)


def adaptive_timeout(spark, d):
    return analytics.adaptive_timeout(_events(spark, d), "node", "event_id", "ms")


def replica_timeout(spark, d):
    """The slowest node's timeout holds for a fan-out to all."""
    return analytics.adaptive_timeout(_events(spark, d), "node", "event_id", "ms").agg(F.max("timeout_ms").alias("timeout_ms"))


def phi_count_window(spark, d):
    e = _events(spark, d)
    return analytics.phi_count(e, "node", "ts", _now(e)).select("node", F.round("phi", 6).alias("phi"), "alive")


def phi_time_window(spark, d):
    e = _events(spark, d)
    nodes = e.select("node").unionByName(spark.createDataFrame([("node-9",)], "node string"))
    return analytics.phi_window(e, nodes, "node", "ts", _now(e), 86_400).select("node", F.round("phi", 6).alias("phi"), "alive")


def last_heartbeat(spark, d):
    return _events(spark, d).groupBy("node").agg(F.unix_micros(F.max("ts")).alias("last_us"), F.count(F.lit(1)).alias("n"))


def request_counters(spark, d):
    return analytics.request_counters(_events(spark, d), "op", F.col("ms") >= 10)


def error_ratio(spark, d):
    return analytics.error_ratio(analytics.request_counters(_events(spark, d), "op", F.col("ms") >= 10)).withColumn("ratio", F.round("ratio", 9))


def throughput(spark, d):
    return workload.throughput(_events(spark, d), F.lit(86_400.0)).select("op", F.round("per_s", 9).alias("per_s"))


def _hist(spark, d, by):
    rows = _events(spark, d).withColumn("s", F.col("ms") / 1000).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return analytics.histogram(rows, by, "s", BOUNDS)


def histogram_buckets(spark, d):
    return _hist(spark, d, ["op"]).select("op", F.round("le", 6).cast("string").alias("le"), "n", F.round("total", 6).alias("total"))


def histogram_quantile(spark, d):
    return analytics.histogram_quantile(_hist(spark, d, ["op", "day"]), ["op", "day"], 0.99).select("op", "day", "quantile")


def mean_latency(spark, d):
    """The dashboard's mean: sum over count of the histogram, in milliseconds."""
    h = _hist(spark, d, ["op"]).groupBy("op").agg(F.max("n").alias("n"), F.max("total").alias("total"))
    return h.select("op", F.round(F.col("total") / F.col("n") * 1000, 6).alias("mean_ms"))


def counter_rate(spark, d):
    s = analytics.scrapes(_events(spark, d), "ts", ["op"], STEP)
    return analytics.counter_rate(s, ["op"], "t", "n", seconds=float(STEP), block_s=7 * 86_400).select("op", "t", F.round("rate", 9).alias("rate"))


def rolling_history(spark, d):
    s = analytics.scrapes(_events(spark, d), "ts", ["op"], STEP)
    return analytics.rolling_history(s, ["op"], "t", 60).select("op", "t", "n")


def counter_rate_raw(spark, d):
    """The other view of a reset: what the counter has reached since."""
    s = analytics.scrapes(_events(spark, d), "ts", ["op"], STEP)
    return analytics.counter_rate(s, ["op"], "t", "n", seconds=float(STEP), block_s=7 * 86_400, raw_after_reset=True).select("op", "t", F.round("rate", 9).alias("rate"))


def _scraped(spark, d, series, ok=None):
    return analytics.scrapes(_events(spark, d), "ts", series, SCRAPE, ok)


def alert_error_rate(spark, d):
    """Share of errors over five minutes above 1 %, held for two."""
    r = analytics.rolling_sum(_scraped(spark, d, ["node"], F.col("ok")), ["node"], "t", ["n", "errors"], 300)
    return analytics.alert_hold(r, ["node"], "t", F.col("errors_sum") / F.col("n_sum") > 0.01, 120)


def _rolled_quantile(rows, by, bounds, seconds, q):
    h = analytics.histogram(rows.withColumn("t", F.floor(F.unix_micros("ts") / (SCRAPE * 1_000_000)) * SCRAPE), [*by, "t"], "s", bounds)
    rolled = analytics.rolling_sum(h.drop("total"), [*by, "le"], "t", ["n"], seconds).select(*by, "t", "le", F.col("n_sum").alias("n"))
    return analytics.histogram_quantile(rolled, [*by, "t"], q)


def alert_latency(spark, d):
    """99th percentile of five minutes above the bound of the operation, held for three."""
    e = _events(spark, d).withColumn("s", F.col("ms") / 1000).filter(F.col("op").isin(list(LATENCY)))
    q = _rolled_quantile(e, ["op"], BOUNDS, 300, 0.99)
    bound = F.create_map(*[F.lit(x) for pair in LATENCY.items() for x in pair])
    return analytics.alert_hold(q, ["op"], "t", F.col("quantile") > bound[F.col("op")], 180)


def alert_compaction(spark, d):
    """95th percentile of ten minutes of a level's compactions above 30 s, held for five; a request's value stands for seconds."""
    e = _events(spark, d).select("ts", (F.col("user_id") % 3).alias("level"), F.col("ms").alias("s"))
    return analytics.alert_hold(_rolled_quantile(e, ["level"], COMPACTION, 600, 0.95), ["level"], "t", F.col("quantile") > 30, 300)


def alert_sloppy_quorum(spark, d):
    """Any fallback within five minutes, held for two; clicks stand for fallbacks."""
    s = _scraped(spark, d, ["node"]).join(_scraped(spark, d, ["node", "op"]).filter("op = 'click'").select("node", "t", F.col("n").alias("falls")), ["node", "t"], "left")
    r = analytics.rolling_sum(s.withColumn("falls", F.coalesce("falls", F.lit(0))), ["node"], "t", ["falls"], 300)
    return analytics.alert_hold(r, ["node"], "t", F.col("falls_sum") / 300 > 0, 120)


def alert_gc_pause(spark, d):
    """Mean pause of five minutes above 10 ms, held for five; a request's value stands for a pause in milliseconds."""
    e = _events(spark, d).select("node", (F.floor(F.unix_micros("ts") / (SCRAPE * 1_000_000)) * SCRAPE).alias("t"), F.floor("ms").alias("ms"))
    s = e.groupBy("node", "t").agg(F.count("ms").alias("n"), F.sum("ms").alias("total"))
    r = analytics.rolling_sum(s, ["node"], "t", ["n", "total"], 300)
    return analytics.alert_hold(r, ["node"], "t", F.col("total_sum") / F.col("n_sum") > 10, 300)


#: Gauge rules: name, operation whose hourly count stands for the gauge, its factor, bound, whether above or below, seconds held.
RULES = [("target_down", "click", 0, 0, "=", 60), ("nodes_active_low", "signup", 1, 2, "<", 120), ("pending_hints_high", "view", 100, 1000, ">", 300),
         ("disk_bytes_high", "purchase", 1 << 30, 10 << 30, ">", 300), ("goroutines_high", "error", 500, 5000, ">", 300)]


def alert_gauges(spark, d):
    """Rules with one bound on a gauge and a hold time."""
    s = analytics.scrapes(_events(spark, d), "ts", ["op"], STEP)
    out = None
    for name, op, factor, bound, way, held in RULES:
        gauge = F.col("n") * factor
        over = {">": gauge > bound, "<": gauge < bound, "=": gauge == bound}[way]
        fired = analytics.alert_hold(s.filter(F.col("op") == op), ["op"], "t", over, held).select(F.lit(name).alias("rule"), "t", "firing")
        out = fired if out is None else out.unionByName(fired)
    return out


def dashboard_alerts(spark, d):
    """The dashboard's own conditions on totals, without hold times: errors over successes of reads and writes, nodes, hints, goroutines."""
    served = F.col("op").isin(list(LATENCY))
    c = _events(spark, d).agg(F.count_if(served & (F.col("ms") >= 10)).alias("good"), F.count_if(served & (F.col("ms") < 10)).alias("bad"), F.count_distinct("node").alias("nodes"), F.count_if(F.col("op") == "view").alias("hints"))
    return c.select(((F.col("good") > 0) & (F.col("bad") / F.greatest("good", F.lit(1)) > 0.01)).alias("errors_high"), (F.col("nodes") < 2).alias("nodes_low"), (F.col("hints") > 100).alias("hints_high"), (F.col("hints") > 5000).alias("goroutines_high"))


def breaker_states(spark, d):
    e = _events(spark, d).select("node", F.unix_seconds("ts").cast("double").alias("t"), "event_id", "ok")
    return folds.breaker_states(e, "node", "t", "ok", "event_id", threshold=2, timeout=60.0).select("event_id", "node", "allowed", "state")


def rate_limit_decisions(spark, d):
    e = _events(spark, d).select("user_id", F.unix_seconds("ts").cast("double").alias("t"), "event_id")
    return folds.rate_limits(e, "user_id", "t", "event_id", rate=1 / 7200, burst=2).groupBy("allowed").agg(F.count(F.lit(1)).alias("n"))


def metrics_text_parse(spark, d):
    c = analytics.request_counters(_events(spark, d), "op", F.col("ok"))
    lines = store_files.format_metrics(c.select(F.format_string('requests_total{operation="%s",status="%s"}', "operation", "status").alias("name"), F.col("n").alias("value")))
    extra = spark.createDataFrame([("# HELP requests_total requests",), ("bad NaN",), ("",), ("up 1",)], "value string")
    return store_files.parse_metrics(lines.unionByName(extra))


def ycsb_mix(spark, d):
    out = None
    for name in workload.MIXES:
        n = workload.operations(spark, name, 20_000, 1000).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys")).withColumn("workload", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


def zipf_counts(spark, d):
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return spark.range(100_000).select(workload.zipfian(u, 1000).alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def cli_mix(spark, d):
    """The command line's own mixes."""
    out = None
    for name in ("E", "mixed"):
        n = workload.operations(spark, name, 20_000, 1000, mixes=workload.CLI_MIXES).groupBy("op").agg(F.count(F.lit(1)).alias("n")).withColumn("workload", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


def zipf_library_counts(spark, d):
    """Draws of the weights 1/(1 + rank)^1.01 over 1000 ranks."""
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return spark.range(20_000).select(workload.go_zipf(u, 1000).alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def zipf_power_counts(spark, d):
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return spark.range(20_000).select(workload.power_zipf(u, 1024).alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def pressure_table(spark, d):
    """A mixed run of the command line with the latency of each operation: the table it prints for each kind."""
    ops = workload.operations(spark, "mixed", table(spark, d, "events").count(), 1000, mixes=workload.CLI_MIXES)
    timed = ops.join(_events(spark, d).select(F.col("event_id").alias("seq"), "ms", "ok"), "seq")
    return analytics.latency_summary(timed, "op", "ms", "ok", floor_rank).select("op", "ops", "errors", "min_ms", "max_ms", "p50", "p95", "p99")


def phase_timings(spark, d):
    e = _events(spark, d).select("op", F.floor(F.col("ms") * 1_000_000).alias("ns"))
    return analytics.phase_timings(e, "op", "ns").withColumn("mean_ns", F.round("mean_ns", 3))


def bench_report(spark, d):
    """A benchmark's round: puts, reads of them, deletes, and reads after that."""
    log = changes(table(spark, d, "wal_record"), ["value"])
    keys = spark.range(500).select(F.format_string("bench:key:%d", "id").alias("key"), F.lit("x").alias("value"), F.lit(1).cast("long").alias("ts"))
    put = checkpoint(maintain.append_puts(log, keys, "ts"), "bench")
    dead = maintain.deletes(put, keys, 2)
    left = put.select("op", "key", "value", "ver", "ts").unionByName(dead.select("op", "key", F.lit(None).cast("string").alias("value"), "ver", "ts"))
    counts = [("put", put.filter("key like 'bench:%'").count()), ("get", snapshot.multi_get(put, keys).count()), ("delete", dead.filter("existed").count()), ("get_again", snapshot.multi_get(left, keys).count())]
    return spark.createDataFrame(counts, "phase string, n long")


def _samples(spark, d, value):
    """Events as a stream of samples: node, seq, value."""
    e = stream_table(spark, d, "events", table(spark, d, "events").schema, maxFilesPerTrigger=4)
    return e.select(F.concat(F.lit("node-"), (F.col("event_id") % 3 + 1).cast("string")).alias("node"), F.col("event_id").alias("seq"), value.alias("value"))


def stream_timeouts(spark, d):
    """Adaptive timeouts kept by a stream of latencies: the last hundred of a node."""
    recent = state.recent_values(_samples(spark, d, F.floor("value")), 100)
    return state.last_rows(state.timeouts(recent), scratch(spark, "timeouts"), "node", "seq").select("node", "timeout_ms")


def stream_suspicion(spark, d):
    """Suspicion kept by a stream of heartbeats: the last thousand intervals of a node."""
    now = table(spark, d, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] + NOW_LATER * 1_000_000
    recent = state.recent_values(_samples(spark, d, F.unix_micros(F.col("ts").cast("timestamp"))), 1001)
    return state.last_rows(state.suspicion(recent, now), scratch(spark, "suspicion"), "node", "seq").select("node", F.round("phi", 6).alias("phi"), "alive")


def stream_rate_limits(spark, d):
    """The same token buckets kept by a stream."""
    e = stream_table(spark, d, "events", table(spark, d, "events").schema, maxFilesPerTrigger=4)
    asked = e.select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    got = _collected(state.rate_limit_stream(asked, 1 / 7200, 2), scratch(spark, "limits"))
    return got.groupBy("allowed").agg(F.count(F.lit(1)).alias("n"))


def _collected(stream: DataFrame, path: str) -> DataFrame:
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.parquet(path)


def load_phase(spark, d):
    return workload.load_phase(spark, 10_000).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))


QUERIES = {f.__name__: f for f in (
    latency_summary_nearest, latency_summary_ycsb, latency_summary_floor, adaptive_timeout, replica_timeout, phi_count_window, phi_time_window, last_heartbeat, request_counters,
    error_ratio, throughput, histogram_buckets, histogram_quantile, mean_latency, counter_rate, rolling_history, alert_error_rate, alert_latency, alert_gauges, dashboard_alerts,
    breaker_states, rate_limit_decisions, metrics_text_parse, ycsb_mix, zipf_counts, load_phase,
    counter_rate_raw, alert_compaction, alert_sloppy_quorum, alert_gc_pause, cli_mix, zipf_library_counts, zipf_power_counts, pressure_table, phase_timings, bench_report,
    stream_timeouts, stream_suspicion, stream_rate_limits)}

_E = "e AS (SELECT event_id, ts, 'node-' || (event_id % 3 + 1) AS node, event_type AS op, value AS ms, event_type <> 'error' AS ok, user_id FROM events)"
_PERCENTS = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))


def _latency(rank: str) -> str:
    picks = ", ".join(f"max(CASE WHEN rn = {rank.format(p=p)} THEN ms END) AS {name}" for name, p in _PERCENTS)
    return f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY ms) AS rn, count(*) OVER (PARTITION BY op) AS n FROM e)
SELECT op, count(*) AS ops, count(*) FILTER (NOT ok) AS errors, round(avg(ms), 6) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, {picks} FROM r GROUP BY op"""


_TIMEOUT = f"""WITH {_E}, r AS (SELECT node, floor(ms) AS ms, row_number() OVER (PARTITION BY node ORDER BY event_id DESC) AS rn FROM e),
l AS (SELECT node, ms, row_number() OVER (PARTITION BY node ORDER BY ms) AS k, count(*) OVER (PARTITION BY node) AS n FROM r WHERE rn <= 100),
p AS (SELECT node, max(n) AS n, max(CASE WHEN k = greatest(ceil(n * 0.95), 1) THEN ms END) AS p FROM l GROUP BY node),
t AS (SELECT node, CAST(CASE WHEN n < 3 THEN 500 ELSE least(greatest(floor(p * 2), 50), 5000) END AS BIGINT) AS timeout_ms FROM p)"""
_NOW = f"n AS (SELECT max(ts) + INTERVAL {NOW_LATER} SECOND AS now FROM e)"
_BUCKETS = ", ".join(f"({b})" for b in BOUNDS)
_HIST = f"""WITH {_E}, b(le) AS (VALUES {_BUCKETS}, (CAST('inf' AS DOUBLE)))"""
def _steps(seconds: int) -> str:
    return f"CAST(epoch_us(ts) // {seconds * 1_000_000} * {seconds} AS BIGINT) AS t"


def _scrapes(by: str, seconds: int = STEP) -> str:
    return f"s AS (SELECT {by}, {_steps(seconds)}, count(*) AS n, count(*) FILTER (NOT ok) AS errors FROM e GROUP BY 1, 2)"


def _hold(cond: str, by: str, held: int, source: str) -> str:
    return f"""m AS (SELECT {by}, t, CASE WHEN {cond} THEN 0 ELSE 1 END AS bad FROM {source}),
h AS (SELECT {by}, t, sum(bad) OVER (PARTITION BY {by} ORDER BY t RANGE BETWEEN {held} PRECEDING AND CURRENT ROW) = 0 AND t - min(t) OVER (PARTITION BY {by}) >= {held} AS firing FROM m)"""


def _over(by: str, seconds: int) -> str:
    return f"(PARTITION BY {by} ORDER BY t RANGE BETWEEN {seconds - 1} PRECEDING AND CURRENT ROW)"


def _operations(name: str, mixes: dict, n: str = "20000", records: int = 1000, seed: int = 42) -> str:
    """CTE ops (id, op, idx): draws are the hashes of the number, the seed and 0 or 1."""
    mix, kind = mixes[name]
    draw = lambda k: f"CAST({sqlhash.hash_int(k, sqlhash.hash_int(seed, sqlhash.hash_long('id')))} % CAST('{1 << 52}' AS UHUGEINT) AS DOUBLE) / {1 << 52}"
    upto, cases = 0, []
    for op, share in mix.items():
        upto += share
        cases.append(f"WHEN u0 * 100 < {upto} THEN '{op}'")
    if kind == "latest":
        idx = f"greatest({records - 1} - CAST(floor(abs(-ln(1 - u1) * {records - 1} * CAST(0.01 AS DOUBLE))) AS BIGINT), 0)"
    else:
        idx = f"{sqlhash.fnv_long(_zipfian('u1', records))} % {records}"
    return f"""draws AS (SELECT id, {draw(0)} AS u0, {draw(1)} AS u1 FROM (SELECT CAST(i AS BIGINT) AS id FROM range({n}) r(i))),
named AS (SELECT *, CASE {' '.join(cases)} ELSE '{list(mix)[-1]}' END AS op FROM draws),
ops AS (SELECT id, op, CASE WHEN op = 'insert' THEN {records} + id ELSE {idx} END AS idx FROM named)"""


def _zipfian(u: str, n: int) -> str:
    theta, total = workload.THETA, workload.zeta(n)
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - workload.zeta(2) / total)
    d = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    return f"""CASE WHEN {u} * {d(total)} < 1 THEN 0 WHEN {u} * {d(total)} < {d(1 + 0.5**theta)} THEN 1
  ELSE least(CAST(floor({d(float(n))} * pow({d(eta)} * {u} - {d(eta)} + 1, {d(1 / (1 - theta))})) AS BIGINT), {n - 1}) END"""


_U = f"CAST({sqlhash.hash_long('id')} % CAST('{1 << 52}' AS UHUGEINT) AS DOUBLE) / {1 << 52}"
_BREAKER = f"""WITH RECURSIVE {_E}, o AS (SELECT event_id, node, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS t, ok, row_number() OVER (PARTITION BY node ORDER BY epoch_us(ts) // 1000000, event_id, ok) AS rn FROM e),
b(node, rn, event_id, allowed, state, failures, successes, last) AS (SELECT DISTINCT node, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), true, 'closed', 0, 0, CAST(0 AS DOUBLE) FROM o UNION ALL
  SELECT node, rn, event_id, st <> 'open', CASE WHEN st = 'open' THEN 'open' WHEN ok THEN CASE WHEN st = 'half_open' AND su + 1 < 3 THEN 'half_open' ELSE 'closed' END
      WHEN st = 'half_open' OR failures + 1 >= 2 THEN 'open' ELSE 'closed' END,
    CASE WHEN st = 'open' THEN failures WHEN ok THEN CASE WHEN st = 'closed' OR su + 1 >= 3 THEN 0 ELSE failures END WHEN st = 'half_open' THEN failures ELSE failures + 1 END,
    CASE WHEN st = 'half_open' THEN CASE WHEN ok THEN su + 1 ELSE 0 END ELSE su END, CASE WHEN st <> 'open' AND NOT ok THEN t ELSE last END
  FROM (SELECT o.*, b.failures, b.last, CASE WHEN b.state = 'open' AND o.t - b.last > 60 THEN 'half_open' ELSE b.state END AS st, CASE WHEN b.state = 'open' AND o.t - b.last > 60 THEN 0 ELSE b.successes END AS su
    FROM b JOIN o ON o.node = b.node AND o.rn = b.rn + 1))"""
_LIMITS = f"""WITH RECURSIVE {_E}, o AS (SELECT user_id, epoch_us(ts) // 1000000 // 7200 AS tick, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS rn FROM e WHERE user_id IS NOT NULL),
b(user_id, rn, tick, tokens, allowed) AS (SELECT user_id, rn, tick, CAST(1 AS BIGINT), true FROM o WHERE rn = 1 UNION ALL
  SELECT user_id, rn, tick, CASE WHEN have > 0 THEN have - 1 ELSE have END, have > 0 FROM (SELECT o.*, least(2, b.tokens + o.tick - b.tick) AS have FROM b JOIN o ON o.user_id = b.user_id AND o.rn = b.rn + 1))"""

_QUANTILE = """q AS (SELECT {by}, le, n, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY {by}) * CAST({q} AS DOUBLE) AS rank FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY le)),
hit AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY le) AS rn FROM q WHERE n >= rank AND n > 0),
v AS (SELECT {by}, CASE WHEN isinf(le) THEN lo WHEN n = below THEN le ELSE lo + (le - lo) * (rank - below) / (n - below) END AS quantile FROM hit WHERE rn = 1)"""

SQL = {
    "latency_summary_nearest": _latency("greatest(ceil(n * CAST({p} AS DOUBLE)), 1)"),
    "latency_summary_ycsb": _latency("least(floor(n * CAST({p} AS DOUBLE)), n - 1) + 1"),
    "latency_summary_floor": _latency("floor((n - 1) * CAST({p} AS DOUBLE)) + 1"),
    "adaptive_timeout": f"{_TIMEOUT} SELECT node, timeout_ms FROM t",
    "replica_timeout": f"{_TIMEOUT} SELECT max(timeout_ms) AS timeout_ms FROM t",
    "phi_count_window": f"""WITH {_E}, {_NOW}, r AS (SELECT node, ts, row_number() OVER (PARTITION BY node ORDER BY ts DESC) AS rn FROM e),
i AS (SELECT node, ts, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY node ORDER BY ts))) / 1000) AS iv FROM r WHERE rn <= 1001),
a AS (SELECT node, count(iv) AS n, avg(iv) AS mean, max(ts) AS last FROM i GROUP BY node),
p AS (SELECT node, CASE WHEN a.n < 10 OR coalesce(mean, 0) <= 0 THEN 0.0 ELSE floor((epoch_us(now) - epoch_us(last)) / 1000) / mean / ln(10) END AS phi FROM a, n)
SELECT node, round(phi, 6) AS phi, phi < 8 AS alive FROM p""",
    "phi_time_window": f"""WITH {_E}, {_NOW}, l AS (SELECT node, max(epoch_us(ts)) AS last FROM e GROUP BY node),
a AS (SELECT e.node, count(*) AS n, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM e JOIN l ON e.node = l.node WHERE epoch_us(ts) >= l.last - 86400000000 GROUP BY e.node),
p AS (SELECT d.node, CASE WHEN a.n IS NULL THEN 9.0 WHEN a.n < 3 THEN 8.5 WHEN a.n < 2 OR last <= first THEN 0.0 ELSE (epoch_us(now) - last) / floor((last - first) / (a.n - 1)) / ln(10) END AS phi
  FROM (SELECT DISTINCT node FROM e UNION SELECT 'node-9') d LEFT JOIN a ON d.node = a.node, n)
SELECT node, round(phi, 6) AS phi, phi < 8 AS alive FROM p""",
    "last_heartbeat": f"WITH {_E} SELECT node, epoch_us(max(ts)) AS last_us, count(*) AS n FROM e GROUP BY node",
    "request_counters": f"WITH {_E} SELECT op AS operation, CASE WHEN ms >= 10 THEN 'success' ELSE 'error' END AS status, count(*) AS n FROM e GROUP BY 1, 2",
    "error_ratio": f"WITH {_E} SELECT count(*) FILTER (NOT coalesce(ms >= 10, false)) AS errors, count(*) AS requests, round(count(*) FILTER (NOT coalesce(ms >= 10, false)) / count(*), 9) AS ratio FROM e",
    "throughput": f"WITH {_E} SELECT op, round(count(*) / 86400.0, 9) AS per_s FROM e GROUP BY op",
    "histogram_buckets": f"""{_HIST} SELECT op, CASE WHEN isinf(le) THEN 'Infinity' ELSE CAST(le AS VARCHAR) END AS le, count(*) FILTER (ms / 1000 <= le) AS n, round(sum(ms / 1000), 6) AS total FROM e, b GROUP BY op, le""",
    "histogram_quantile": f"""{_HIST}, h AS (SELECT op, strftime(ts, '%Y-%m-%d') AS day, le, count(*) FILTER (ms / 1000 <= le) AS n FROM e, b GROUP BY ALL), {_QUANTILE.format(by='op, day', source='h', q=0.99)}
SELECT op, day, quantile FROM v""",
    "mean_latency": f"WITH {_E} SELECT op, round(sum(ms / 1000) / count(ms) * 1000, 6) AS mean_ms FROM e GROUP BY op",
    "counter_rate": f"""WITH {_E}, {_scrapes('op')} SELECT op, t, round(greatest(n - coalesce(lag(n) OVER (PARTITION BY op ORDER BY t), n), 0) / {float(STEP)}, 9) AS rate FROM s""",
    "rolling_history": f"WITH {_E}, {_scrapes('op')} SELECT op, t, n FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY t DESC) AS rn FROM s) WHERE rn <= 60",
    "counter_rate_raw": f"""WITH {_E}, {_scrapes('op')}, l AS (SELECT *, n - coalesce(lag(n) OVER (PARTITION BY op ORDER BY t), n) AS c FROM s)
SELECT op, t, round(CASE WHEN c < 0 THEN n ELSE c END / {float(STEP)}, 9) AS rate FROM l""",
    "alert_error_rate": f"""WITH {_E}, {_scrapes('node', SCRAPE)}, r AS (SELECT node, t, sum(n) OVER w AS n, sum(errors) OVER w AS errors FROM s WINDOW w AS {_over('node', 300)}),
{_hold('errors / n > 0.01', 'node', 120, 'r')} SELECT node, t, firing FROM h""",
    "alert_latency": f"""{_HIST}, x AS (SELECT op, {_steps(SCRAPE)}, le, count(*) FILTER (ms / 1000 <= le) AS n FROM e, b WHERE op IN ('view', 'purchase') GROUP BY ALL),
r AS (SELECT op, t, le, sum(n) OVER {_over('op, le', 300)} AS n FROM x), {_QUANTILE.format(by='op, t', source='r', q=0.99)},
{_hold("quantile > CASE op WHEN 'view' THEN 0.1 ELSE 0.05 END", 'op', 180, 'v')} SELECT op, t, firing FROM h""",
    "alert_compaction": f"""WITH {_E}, b(le) AS (VALUES {', '.join(f'({x})' for x in COMPACTION)}, (CAST('inf' AS DOUBLE))), x AS (SELECT user_id % 3 AS level, {_steps(SCRAPE)}, le, count(*) FILTER (ms <= le) AS n FROM e, b GROUP BY ALL),
r AS (SELECT level, t, le, sum(n) OVER {_over('level, le', 600)} AS n FROM x), {_QUANTILE.format(by='level, t', source='r', q=0.95)},
{_hold('quantile > 30', 'level', 300, 'v')} SELECT level, t, firing FROM h""",
    "alert_sloppy_quorum": f"""WITH {_E}, s AS (SELECT node, {_steps(SCRAPE)}, count(*) FILTER (op = 'click') AS falls FROM e GROUP BY 1, 2), r AS (SELECT node, t, sum(falls) OVER {_over('node', 300)} AS falls FROM s),
{_hold('falls / 300 > 0', 'node', 120, 'r')} SELECT node, t, firing FROM h""",
    "alert_gc_pause": f"""WITH {_E}, s AS (SELECT node, {_steps(SCRAPE)}, count(ms) AS n, sum(floor(ms)) AS total FROM e GROUP BY 1, 2), r AS (SELECT node, t, sum(n) OVER w AS n, sum(total) OVER w AS total FROM s WINDOW w AS {_over('node', 300)}),
{_hold('total / n > 10', 'node', 300, 'r')} SELECT node, t, firing FROM h""",
    "alert_gauges": f"WITH {_E}, {_scrapes('op')} " + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, t, firing FROM (WITH {_hold(f'n * {factor} {way} {bound}', 'op', held, '(SELECT * FROM s WHERE op = ' + chr(39) + op + chr(39) + ')')} SELECT * FROM h)" for name, op, factor, bound, way, held in RULES),
    "dashboard_alerts": f"""WITH {_E}, c AS (SELECT count(*) FILTER (op IN ('view', 'purchase') AND ms >= 10) AS good, count(*) FILTER (op IN ('view', 'purchase') AND ms < 10) AS bad, count(DISTINCT node) AS nodes, count(*) FILTER (op = 'view') AS hints FROM e)
SELECT good > 0 AND bad / greatest(good, 1) > 0.01 AS errors_high, nodes < 2 AS nodes_low, hints > 100 AS hints_high, hints > 5000 AS goroutines_high FROM c""",
    "breaker_states": f"{_BREAKER} SELECT event_id, node, allowed, state FROM b WHERE rn > 0",
    "rate_limit_decisions": f"{_LIMITS} SELECT allowed, count(*) AS n FROM b GROUP BY allowed",
    "stream_rate_limits": f"{_LIMITS} SELECT allowed, count(*) AS n FROM b GROUP BY allowed",
    "ycsb_mix": " UNION ALL ".join(f"SELECT * FROM (WITH {_operations(w, workload.MIXES)} SELECT op, count(*) AS n, count(DISTINCT idx) AS keys, '{w}' AS workload FROM ops GROUP BY op)" for w in workload.MIXES),
    "cli_mix": " UNION ALL ".join(f"SELECT * FROM (WITH {_operations(w, workload.CLI_MIXES)} SELECT op, count(*) AS n, '{w}' AS workload FROM ops GROUP BY op)" for w in ("E", "mixed")),
    "zipf_counts": f"WITH d AS (SELECT {_U} AS u FROM (SELECT CAST(i AS BIGINT) AS id FROM range(100000) r(i))) SELECT CAST({_zipfian('u', 1000)} AS BIGINT) AS rank, count(*) AS n FROM d GROUP BY 1",
    "zipf_power_counts": f"SELECT CAST(floor(pow(CAST(1024 AS DOUBLE), u)) AS BIGINT) AS rank, count(*) AS n FROM (SELECT {_U} AS u FROM (SELECT CAST(i AS BIGINT) AS id FROM range(20000) r(i))) GROUP BY 1",
    "zipf_library_counts": f"""WITH w AS (SELECT i, sum(pow(CAST(1 + i AS DOUBLE), CAST(-1.01 AS DOUBLE))) OVER (ORDER BY i) AS upto FROM range(1000) r(i)), c AS (SELECT upto / (SELECT max(upto) FROM w) AS edge FROM w),
d AS (SELECT id, {_U} AS u FROM (SELECT CAST(i AS BIGINT) AS id FROM range(20000) r(i))) SELECT rank, count(*) AS n FROM (SELECT id, count(edge) AS rank FROM d LEFT JOIN c ON c.edge <= d.u GROUP BY id) GROUP BY rank""",
    "pressure_table": f"""WITH {_operations('mixed', workload.CLI_MIXES, n='(SELECT count(*) FROM events)')}, {_E}, r AS (SELECT ops.op, ms, ok, row_number() OVER (PARTITION BY ops.op ORDER BY ms) AS rn, count(*) OVER (PARTITION BY ops.op) AS n FROM ops JOIN e ON ops.id = e.event_id)
SELECT op, count(*) AS ops, count(*) FILTER (NOT ok) AS errors, min(ms) AS min_ms, max(ms) AS max_ms, {', '.join(f"max(CASE WHEN rn = floor((n - 1) * CAST({p} AS DOUBLE)) + 1 THEN ms END) AS {name}" for name, p in _PERCENTS[:3])} FROM r GROUP BY op""",
    "phase_timings": f"""WITH {_E}, x AS (SELECT op, CAST(floor(ms * 1000000) AS BIGINT) AS ns FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY ns) AS rn, count(*) OVER (PARTITION BY op) AS c FROM x)
SELECT op, count(*) AS n, round(avg(ns), 3) AS mean_ns, max(ns) AS max_ns, {', '.join(f"max(CASE WHEN rn = floor((c - 1) * CAST({p} AS DOUBLE)) + 1 THEN ns END) AS {name}" for name, p in _PERCENTS[:3])} FROM r GROUP BY op""",
    "bench_report": "SELECT * FROM (VALUES ('put', CAST(500 AS BIGINT)), ('get', 500), ('delete', 500), ('get_again', 0)) t(phase, n)",
    "stream_timeouts": f"{_TIMEOUT} SELECT node, timeout_ms FROM t",
    "metrics_text_parse": f"""WITH {_E} SELECT 'requests_total' AS name, 'operation="' || op || '",status="' || CASE WHEN ok THEN 'success' ELSE 'error' END || '"' AS labels, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY op, ok
UNION ALL SELECT 'up', '', 1.0""",
    "load_phase": "SELECT i // 500 AS batch, count(*) AS n, min(printf('user%010d', i)) AS first, max(printf('user%010d', i)) AS last FROM range(10000) r(i) GROUP BY 1",
}
SQL["stream_suspicion"] = SQL["phi_count_window"]
