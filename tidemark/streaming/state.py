"""Structured Streaming forms of the store's background loops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import MergeTable, changes
from ..operators.folds import Breaker, Bucket
from ..operators.skew import nearest_rank
from ..session import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def materialize(log: DataFrame, table: MergeTable, checkpoint: str | None = None, trigger: dict | None = None):
    """Tail a log into a merge table: each micro-batch is appended as a run. Gives the streaming query.

    A batch that is repeated after a failure appends rows it has appended before, which changes nothing
    in the merged state. The bound of a batch is set at the source (maxFilesPerTrigger and the like).
    """
    def step(batch: DataFrame, _: int) -> None:
        table.append(changes(batch, table.carry))

    writer = log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or scratch(table.spark, "stream"))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def coalesced(log: DataFrame, path: str, position: str, checkpoint: str, trigger: dict | None = None):
    """Write buffer: of each micro-batch only the last change per key is written, then files of ``path`` grow by it."""
    def step(batch: DataFrame, n: int) -> None:
        last = F.max(F.struct(position, "ver", "ts", "op", "value")).alias("l")
        changes(batch, [position, "value"]).groupBy("key").agg(last).select("key", "l.*").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fan_out_queue(log: DataFrame, place, path: str, checkpoint: str, trigger: dict | None = None):
    """Replication queue: each micro-batch is placed (``place`` adds the column node) and written per peer, whole rows with tombstones and versions."""
    def step(batch: DataFrame, n: int) -> None:
        place(batch).write.mode("overwrite").partitionBy("node").parquet(f"{path}/batch={n}")

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_versions(log: DataFrame) -> DataFrame:
    """Streaming newest change per key (update or complete mode): the highest (ver, ts) and whether it is a put."""
    top = F.max(F.struct("ver", "ts", "op")).alias("t")
    return changes(log).groupBy("key").agg(top).select("key", "t.ver", "t.ts", "t.op")


def liveness_changes(contacts: DataFrame, suspect_s: int = 30, dead_s: int = 60) -> DataFrame:
    """State changes of nodes out of a stream of contacts (node, ts): alive on contact, suspect and dead by silence.

    Silence is measured in event time (the watermark), so results don't depend on when the stream runs.
    One state of two numbers per node.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        node = key[0]
        if state.hasTimedOut:
            last, now = state.get
            now = "suspect" if now == "alive" else "dead"
            state.update((last, now))
            if now == "suspect":
                state.setTimeoutTimestamp(last + dead_s * 1000)
            yield pd.DataFrame({"node": [node], "state": [now], "at_ms": [last + (suspect_s if now == "suspect" else dead_s) * 1000]})
            return
        last, now = state.get if state.exists else (0, "")
        newest = max(int(f["ms"].max()) for f in frames)
        last, was, now = max(last, newest), now, "alive"
        state.update((last, now))
        state.setTimeoutTimestamp(max(last + suspect_s * 1000, state.getCurrentWatermarkMs() + 1))
        if was != now:
            yield pd.DataFrame({"node": [node], "state": [now], "at_ms": [newest]})

    rows = contacts.filter(F.col("node").isNotNull() & F.col("ts").isNotNull()).select("node", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", "0 seconds")
    return rows.groupBy("node").applyInPandasWithState(step, "node string, state string, at_ms long", "last long, state string", "append", GroupStateTimeout.EventTimeTimeout)


class _BreakerProcessor(StatefulProcessor):
    """One breaker per peer; rows of a micro-batch are taken in order of time."""

    def __init__(self, threshold: int, timeout: float, limit: int):
        self.args = (threshold, timeout, limit)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "state string, failures long, successes long, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        saved = self.state.get() if self.state.exists() else None
        breaker = Breaker(*self.args, state=tuple(saved) if saved else None)
        calls = pd.concat(list(rows)).sort_values(["t", "seq"])
        out = [(key[0], int(s), *breaker.step(float(t), bool(ok))) for s, t, ok in zip(calls["seq"], calls["t"], calls["ok"])]
        self.state.update(breaker.dump())
        yield pd.DataFrame(out, columns=["peer", "seq", "allowed", "state"])

    def close(self) -> None:
        pass


def breaker_stream(calls: DataFrame, threshold: int = 3, timeout: float = 30.0, limit: int = 3) -> DataFrame:
    """Calls (peer, seq, t, ok) with the decision and state of their peer's breaker; needs the RocksDB state store."""
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return calls.groupBy("peer").transformWithStateInPandas(_BreakerProcessor(threshold, timeout, limit), "peer string, seq long, allowed boolean, state string", "Append", "None")


class _LimitProcessor(StatefulProcessor):
    """One token bucket per client; rows of a micro-batch are taken in order of time."""

    def __init__(self, rate: float, burst: int):
        self.args = (rate, burst)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens long, ticks long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bucket = Bucket(*self.args)
        if self.state.exists():
            bucket.tokens, bucket.ticks = self.state.get()
        asked = pd.concat(list(rows)).sort_values(["t", "seq"])
        out = [(key[0], int(s), bucket.step(float(t))) for s, t in zip(asked["seq"], asked["t"])]
        self.state.update((bucket.tokens, bucket.ticks))
        yield pd.DataFrame(out, columns=["client", "seq", "allowed"])

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, rate: float, burst: int) -> DataFrame:
    """Requests (client, seq, t) with the decision of their client's token bucket; needs the RocksDB state store."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return requests.groupBy("client").transformWithStateInPandas(_LimitProcessor(rate, burst), "client string, seq long, allowed boolean", "Append", "None")


def _recent(keep: int):
    """A step that keeps the ``keep`` rows of the highest seq of a node and gives them out whenever some have come."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, values = state.get if state.exists else ([], [])
        held = pd.DataFrame({"seq": pd.Series(list(seqs), dtype="int64"), "value": pd.Series(list(values), dtype="int64")})
        for f in frames:
            held = pd.concat([held, f[["seq", "value"]].astype("int64")]).nlargest(keep, "seq")
        held = held.sort_values("seq")
        state.update((held["seq"].tolist(), held["value"].tolist()))
        yield pd.DataFrame({"node": [key[0]], "seq": [int(held["seq"].iloc[-1])], "values": [held["value"].tolist()]})

    return step


def recent_values(samples: DataFrame, keep: int) -> DataFrame:
    """Streaming window of the last ``keep`` samples (node, seq, value) of each node: a row with all of them whenever it changes (update mode)."""
    rows = samples.filter("node is not null and seq is not null and value is not null").select("node", "seq", F.col("value").cast("long").alias("value"))
    return rows.groupBy("node").applyInPandasWithState(_recent(keep), "node string, seq long, values array<long>", "seqs array<long>, kept array<long>", "update", GroupStateTimeout.NoTimeout)


def timeouts(recent: DataFrame, percentile: float = 0.95, factor: float = 2.0, low: int = 50, high: int = 5000, default: int = 500, least: int = 3) -> DataFrame:
    """The adaptive timeout of each node from its window of latencies in whole milliseconds."""
    n = F.size("values")
    p = F.get(F.array_sort("values"), (nearest_rank(n, percentile) - 1).cast("int"))
    return recent.select("node", "seq", F.when(n < least, F.lit(default)).otherwise(F.least(F.greatest(F.floor(p * factor), F.lit(low)), F.lit(high))).cast("long").alias("timeout_ms"))


def suspicion(recent: DataFrame, now_us: int, least: int = 10, threshold: float = 8.0) -> DataFrame:
    """Suspicion of each node at a time from its window of heartbeats (microseconds), as ``analytics.phi_count`` has it."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("values") - 1, F.lit(1))), lambda i: F.floor((F.get("values", i) - F.get("values", i - 1)) / 1000))
    steps = F.when(F.size("values") > 1, steps).otherwise(F.array().cast("array<bigint>"))
    mean = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(steps)
    phi = F.when((F.size(steps) < least) | (F.coalesce(mean, F.lit(0.0)) <= 0), F.lit(0.0)).otherwise(F.floor((F.lit(now_us) - F.element_at("values", -1)) / 1000) / mean / F.log(F.lit(10.0)))
    return recent.select("node", "seq", phi.alias("phi")).withColumn("alive", F.col("phi") < threshold)


def last_rows(stream: DataFrame, path: str, key: str, order: str, trigger: dict | None = None) -> DataFrame:
    """Run an updating stream to its end into a folder, a part for each micro-batch, and give the last row of each key."""
    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{path}-checkpoint").trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(path)
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *others)).alias("l")).select(key, *[F.col(f"l.{c}").alias(c) for c in (order, *others) if c != "batch"])


class _ExpiryProcessor(StatefulProcessor):
    """Latest time to live per key; a timer emits the key when it has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ttl", "ts_ms long, expire_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ops = pd.concat(list(rows)).sort_values(["ts_ms", "op", "ttl_ms"])
        last = ops.iloc[-1]
        seen = self.state.get() if self.state.exists() else None
        if seen is None or int(last["ts_ms"]) >= seen[0]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            at = int(last["ts_ms"]) + int(last["ttl_ms"] or 0) if last["op"] == "add" else -1
            self.state.update((int(last["ts_ms"]), at))
            if at >= 0:
                self.handle.registerTimer(max(at + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": pd.Series(dtype=str), "expire_at": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, at = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"key": [key[0]], "expire_at": [at]})

    def close(self) -> None:
        pass


def expiry_stream(ops: DataFrame) -> DataFrame:
    """Keys as they expire out of a stream of TTL operations (key, op, ttl_ms, ts_ms, ts), in event time."""
    ops.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return ops.withWatermark("ts", "0 seconds").groupBy("key").transformWithStateInPandas(_ExpiryProcessor(), "key string, expire_at long", "Append", "EventTime")


def deliver(hints: DataFrame, outbox: str, send, max_attempts: int = 10, checkpoint: str | None = None, trigger: dict | None = None):
    """Hint outbox: each micro-batch joins what is still undelivered, is sent, and what failed stays with one more attempt.

    ``send`` maps a DataFrame of hints (key, target, version, attempts) to the same rows with ``ok``. The
    outbox is a folder of generations; the highest complete one holds. Hints tried ``max_attempts`` times
    stay in it but aren't sent again.
    """
    spark: SparkSession = hints.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        pending = batch.select("key", "target", "version", F.lit(0).alias("attempts"))
        if n > 0:
            pending = pending.unionByName(spark.read.parquet(f"{outbox}/{n - 1}"))
        tried = send(pending.filter(F.col("attempts") < max_attempts))
        left = tried.filter(~F.col("ok")).select("key", "target", "version", (F.col("attempts") + 1).alias("attempts"))
        left.unionByName(pending.filter(F.col("attempts") >= max_attempts)).write.mode("overwrite").parquet(f"{outbox}/{n}")

    return hints.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or scratch(spark, "stream")).trigger(**(trigger or {"availableNow": True})).start()
