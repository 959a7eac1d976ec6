"""Writing to the log and keeping it small: appends, coalescing, merging, expiry, compaction plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vclock
from ..functions.scalar import admission, level_capacity, size_tier
from .changes import DEL, PUT, changes, newest
from .snapshot import global_rank, live

DAY_NS = 24 * 3600 * 10**9


def admitted(writes: DataFrame, value: str = "value") -> DataFrame:
    """Every row with a ``status``: ok, empty_key, key_too_long or value_too_large."""
    return writes.withColumn("status", admission(F.col("key"), F.col(value)))


def completed(log: DataFrame, entries: DataFrame, order: list, now: int, node: str | None = None) -> DataFrame:
    """Entries (key, value, and ver, ts, vc where the caller has them) as rows of the log: op, key, value, ver, ts, vc.

    Only what is null or zero is filled: versions go on from the highest of the log in ``order`` (columns;
    value and key decide ties), times become ``now``, and a missing clock is the merged clock of the key in
    the log with one more at ``node`` (null without a node). All else stays as the caller set it.
    """
    base = log.agg(F.coalesce(F.max("ver"), F.lit(0))).first()[0]
    missing = lambda c, kind: F.when(F.col(c) != 0, F.col(c)) if c in entries.columns else F.lit(None).cast(kind)
    clock = F.col("vc") if "vc" in entries.columns else F.lit(None).cast("map<string,bigint>")
    rows = entries.select("key", "value", missing("ver", "long").cast("long").alias("ver"), F.coalesce(missing("ts", "long"), F.lit(now)).cast("long").alias("ts"),
                          clock.alias("vc"), *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    by = [*[F.col(f"__o{i}") for i in range(len(order))], F.col("key"), F.col("value")]
    kept, new = rows.filter("ver is not null"), global_rank(rows.filter("ver is null"), by, "__pos").withColumn("ver", F.col("__pos") + F.lit(base + 1)).drop("__pos")
    rows = kept.unionByName(new).select("key", "value", "ver", "ts", "vc")
    if node is not None and "vc" in log.columns:
        bare = rows.filter("vc is null").drop("vc")
        known = vclock.merge_all("vc", ["key"], log.join(bare.select("key").distinct(), "key", "left_semi"), "__c")
        bare = bare.join(known, "key", "left").withColumn("vc", vclock.increment(F.col("__c"), F.lit(node))).drop("__c")
        rows = rows.filter("vc is not null").unionByName(bare)
    return rows.select(F.lit(PUT).alias("op"), "key", "value", "ver", "ts", "vc")


def append_entries(log: DataFrame, entries: DataFrame, order: list, now: int = 0, node: str | None = None) -> DataFrame:
    """The log with entries appended, filled in by ``completed``; a batch is all or nothing: if a row isn't admitted nothing is appended."""
    clock = F.col("vc") if "vc" in log.columns else F.lit(None).cast("map<string,bigint>")
    old = log.select("op", "key", "value", "ver", "ts", clock.alias("vc"))
    ok = admitted(entries).agg(F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True))).first()[0]
    return old.unionByName(completed(log, entries, order, now, node)) if ok else old


def append_puts(log: DataFrame, puts: DataFrame, order: str) -> DataFrame:
    """The log with writes (key, value, ts) appended; versions go on from the highest in their order, ties by key and value."""
    return append_entries(log, puts.select("key", "value", "ts", F.col(order).alias("__by")), [F.col("__by")])


def deletes(log: DataFrame, keys: DataFrame, ts: int) -> DataFrame:
    """Tombstones for keys, with ``existed``: whether the key was visible. Versions follow the highest one."""
    base = log.agg(F.coalesce(F.max("ver"), F.lit(0))).first()[0]
    wanted = keys.filter(F.col("key") != "").select("key").distinct()
    old = live(log).select("key", F.lit(True).alias("existed"))
    return wanted.join(old, "key", "left").select(F.lit(DEL).alias("op"), "key", F.lit(base + 1).cast("long").alias("ver"), F.lit(ts).cast("long").alias("ts"), F.coalesce("existed", F.lit(False)).alias("existed"))


def read_modify_write(log: DataFrame, keys: DataFrame, change) -> DataFrame:
    """Rows to append for wanted keys that are visible: the value after ``change`` (Column to Column), the key's time, and
    versions that go on from the highest of the log, by key."""
    base = log.agg(F.coalesce(F.max("ver"), F.lit(0))).first()[0]
    wanted = keys.filter(F.col("key") != "").select("key").distinct()
    rows = live(log).join(wanted, "key", "left_semi").select("key", change(F.col("value")).alias("value"), "ts")
    numbered = global_rank(rows, [F.col("key")], "__pos")
    return numbered.select(F.lit(PUT).alias("op"), "key", "value", (F.col("__pos") + F.lit(base + 1)).alias("ver"), "ts")


def coalesce_batches(log: DataFrame, position: str, size: int) -> DataFrame:
    """Write buffer: of each block of ``size`` positions the last change per key (by position, then ver, ts)."""
    rows = changes(log, [position]).withColumn("batch", F.floor(F.col(position) / size))
    last = F.max(F.struct(position, "ver", "ts", "op")).alias("l")
    return rows.groupBy("batch", "key").agg(last).select("batch", "key", "l.ver", "l.ts", "l.op")


def merge_runs(*runs: DataFrame) -> DataFrame:
    """All rows of some runs by key, newest version first."""
    return reduce(DataFrame.unionByName, runs).orderBy("key", F.desc("ver"), F.desc("ts"))


def dedup_ttl(log: DataFrame, now: int, ttl: int = DAY_NS) -> DataFrame:
    """Newest change per key; a tombstone older than ``ttl`` (strictly) goes too. Only safe over the full log."""
    top = newest(changes(log, ["value"]), "key", ["ver", "ts"], ["op", "value"])
    return top.filter(~((F.col("op") == DEL) & (F.lit(now) - F.col("ts") > ttl)))


def level_plan(runs: DataFrame, threshold: int = 4, ratio: float = 2.0) -> DataFrame:
    """Levels to merge into the next: from level 0 on as long as each holds its capacity or more.

    ``runs`` has a row per run with its ``level``; a missing level ends the sequence.
    """
    counts = runs.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    full = counts.withColumn("capacity", level_capacity(F.col("level"), threshold, ratio)).withColumn("full", F.col("n") >= F.col("capacity"))
    # levels are few; the sequence 0, 1, 2, ... must be without gap and full up to the level itself
    order = Window.orderBy("level")
    ok = full.filter("full").withColumn("rn", F.row_number().over(order) - 1)
    return ok.filter(F.col("rn") == F.col("level")).select("level", "n", "capacity")


def tier_plan(runs: DataFrame, size: str = "bytes", threshold: int = 4) -> DataFrame:
    """The smallest size tier with at least ``threshold`` runs: tier, n, bytes; nothing if none has."""
    tiers = runs.groupBy(size_tier(F.col(size)).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    return tiers.filter(F.col("n") >= threshold).orderBy("tier").limit(1)


def drop_oldest(df: DataFrame, order: list, limit: int, share: int = 10) -> DataFrame:
    """Overflow of a bounded store: with ``limit`` or more rows the oldest 1/share of them go, else none."""
    ranked = global_rank(df, order, "__pos", "__n")
    return ranked.filter((F.col("__n") < limit) | (F.col("__pos") >= F.floor(F.col("__n") / share))).drop("__pos", "__n")


MAX_BATCH_KEYS, MAX_BATCH_BYTES = 10_000, 64 << 20


def batch_admission(writes: DataFrame, batch: Column, value: str = "value") -> DataFrame:
    """Per batch: rows, bytes of keys and values, and ``status``: ok, too_many_keys or too_large."""
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))
    sums = writes.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))
    return sums.withColumn("status", F.when(F.col("n") > MAX_BATCH_KEYS, "too_many_keys").when(F.col("bytes") > MAX_BATCH_BYTES, "too_large").otherwise("ok"))


def acknowledged(rows: DataFrame, value: str = "value") -> DataFrame:
    """Replicated rows with their answer: ``ack``, and ``error`` where a row wasn't admitted; rows without a key are skipped, not answered."""
    status = admission(F.col("key"), F.col(value))
    return rows.filter(F.col("key").isNotNull()).withColumn("ack", status == "ok").withColumn("error", F.when(status != "ok", status))


def bounded_queue(rows: DataFrame, batch: Column, order: list, limit: int) -> DataFrame:
    """Rows with ``queued``: of each batch (what comes between two flushes) the first ``limit`` are taken, the rest counted as dropped.

    The queue's bound is the feature here. Ranks are formed in blocks, so a batch needs no task of its own.
    """
    return distributed_rank_in_order(rows.withColumn("__batch", batch), order).withColumn("queued", F.col("__rank") <= limit).withColumnRenamed("__batch", "batch").drop("__rank")


def distributed_rank_in_order(rows: DataFrame, order: list) -> DataFrame:
    """Rank from 1 within ``__batch`` by ``order``, out of the position in the order of all rows less the rows of lower batches."""
    ranked = global_rank(rows, [F.col("__batch"), *order], "__pos")
    below = Window.orderBy("__batch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__batch").agg(F.count(F.lit(1)).alias("__n")).withColumn("__off", F.coalesce(F.sum("__n").over(below), F.lit(0))).drop("__n")
    return ranked.join(sizes, "__batch").withColumn("__rank", F.col("__pos") - F.col("__off") + 1).drop("__pos", "__off")
