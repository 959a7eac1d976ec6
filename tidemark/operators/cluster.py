"""Writes and deletes over replicas, the registry of nodes, health, caches, and what a node does with what it receives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vclock
from .ring import Ring, fan_out, place

LEAVING, DOWN = "leaving", "down"


def replicated(rows: DataFrame, ring: Ring, alive: list[str], need: int, replicas: int = 3) -> DataFrame:
    """Rows (writes or tombstones) by key with their replicas: ``acks`` of the living ones, the coordinator's included, and whether they reach ``need``.

    A dead replica is acknowledged by nobody. The list of a key is as long as ``replicas``, so nothing is shuffled.
    """
    living = F.array(*[F.lit(n) for n in alive]) if alive else F.array().cast("array<string>")
    placed = place(rows, "key", ring, replicas)
    acks = F.size(F.array_intersect("replicas", living))
    return placed.withColumn("acks", acks).withColumn("met", F.col("acks") >= need)


def replica_rows(rows: DataFrame, ring: Ring, replicas: int = 3) -> DataFrame:
    """Whole rows, versions, times, clocks and delete marks with them, once for each replica (``node``)."""
    return fan_out(place(rows, "key", ring, replicas)).drop("replicas")


def replicated_delete(keys: DataFrame, ring: Ring, alive: list[str], need: int, version: int, replicas: int = 3) -> DataFrame:
    """A tombstone of each wanted key with the answers of its replicas: key, version, tombstone, acks, met. Keys that are null, empty or repeated count once or not at all."""
    wanted = keys.filter(F.col("key") != "").select("key").distinct()
    marks = wanted.select("key", F.lit(version).cast("long").alias("version"), F.lit(True).alias("tombstone"))
    return replicated(marks, ring, alive, need, replicas).drop("replicas")


def quorum_read_some(log: DataFrame, ring: Ring, alive: list[str], need: int, replicas: int = 3) -> DataFrame:
    """Read with R of N: the first ``need`` living replicas of a key answer, the highest version among them holds.

    Per key: ``answers`` (living replicas asked that hold a row), ``met`` (enough of them live), version,
    value and ``visible``. Tombstones compete and then hide. A key with no answer has no version.
    """
    top = F.max(F.struct("version", "ts_ns", "tombstone", "value")).alias("e")
    entries = log.groupBy("node", "key").agg(top)
    living = F.array(*[F.lit(n) for n in alive]) if alive else F.array().cast("array<string>")
    held = entries.groupBy("key").agg(F.collect_list(F.struct("node", "e")).alias("held"))  # one for each node of the cluster
    placed = place(held, "key", ring, replicas).withColumn("asked", F.slice(F.filter("replicas", lambda n: F.array_contains(living, n)), 1, need))
    heard = F.filter("held", lambda h: F.array_contains(F.col("asked"), h["node"]))
    best = F.array_max(F.transform(heard, lambda h: h["e"]))
    return placed.select("key", F.size(heard).alias("answers"), (F.size("asked") >= need).alias("met"), best["version"].alias("version"), best["value"].alias("value"),
                         F.coalesce(~best["tombstone"], F.lit(False)).alias("visible"))


def node_batch_get(log: DataFrame, node: str, keys: DataFrame) -> DataFrame:
    """What one replica answers to a batch of keys: its entry of each distinct key, tombstones too, or ``found`` false."""
    top = F.max(F.struct("version", "ts_ns", "tombstone", "value")).alias("e")
    own = log.filter(F.col("node") == node).groupBy("key").agg(top).select("key", "e.version", "e.value", "e.tombstone", F.lit(True).alias("found"))
    wanted = keys.filter(F.col("key") != "").select("key").distinct()
    return wanted.join(own, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def received(rows: DataFrame, node: str, target: str = "target_node") -> DataFrame:
    """Replicated rows as a node takes them: ``taken`` is ``stored``, or ``hint`` where the row names another node as its target."""
    return rows.withColumn("taken", F.when(F.col(target).isNull() | (F.col(target) == node), "stored").otherwise("hint"))


def gossip_ring(ring: Ring, heard: DataFrame, bound: int = 100_000) -> Ring:
    """The ring with the nodes that gossip tells of, by name; one list of node names, refused beyond ``bound``."""
    names = [r[0] for r in heard.filter(F.col("node").isNotNull()).select("node").distinct().orderBy("node").limit(bound + 1).collect()]
    if len(names) > bound:
        raise ValueError("more nodes than a ring is laid out for")
    for name in names:
        ring = ring.add(name)
    return ring


# -- members and registry ------------------------------------------------------------------------------
def mark_dead(members: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    """Members with some of them dead since ``now``; unknown nodes are ignored, incarnations stay."""
    gone = nodes.select("node").distinct().withColumn("__gone", F.lit(True))
    joined = members.join(gone, "node", "left")
    return joined.select("node", F.when(F.col("__gone"), "dead").otherwise(F.col("state")).alias("state"), "incarnation", F.when(F.col("__gone"), now).otherwise(F.col("last_seen")).alias("last_seen"))


def projection(members: DataFrame) -> DataFrame:
    """Members as a status page lists them: node, address, heartbeat in milliseconds, state."""
    return members.select("node", "address", F.unix_millis(F.col("last_seen").cast("timestamp")).alias("heartbeat_ms"), "state")


def register(known: DataFrame | None, records: DataFrame, order: list[str]) -> DataFrame:
    """Registry (node, address, state) after registrations: the first of a node by ``order`` holds, known nodes keep theirs."""
    first = F.min(F.struct(*order, "address", "state")).alias("r")
    new = records.groupBy("node").agg(first).select("node", "r.address", "r.state")
    if known is None:
        return new
    return known.select("node", "address", "state").unionByName(new.join(known.select("node"), "node", "left_anti"))


def unregister(registry: DataFrame, nodes: list[str]) -> DataFrame:
    return registry.filter(~F.col("node").isin(nodes))


def set_state(registry: DataFrame, node: str, state: str) -> DataFrame:
    """Of a known node; an unknown one changes nothing."""
    return registry.withColumn("state", F.when(F.col("node") == node, state).otherwise(F.col("state")))


def checked(registry: DataFrame, checks: DataFrame, order: list[str]) -> DataFrame:
    """Registry after health checks (node, ok): the latest by ``order`` makes a node healthy or unhealthy; leaving and down nodes aren't checked."""
    last = checks.groupBy("node").agg(F.max(F.struct(*order, "ok")).alias("c")).select("node", "c.ok")
    state = F.when(F.col("state").isin(LEAVING, DOWN) | F.col("ok").isNull(), F.col("state")).when(F.col("ok"), "healthy").otherwise("unhealthy")
    return registry.join(last, "node", "left").select("node", "address", state.alias("state"))


# -- caches, queues, trees -----------------------------------------------------------------------------
def cached_rows(cached: DataFrame, writes: DataFrame, now: Column, seconds: int = 5) -> DataFrame:
    """Rows a row cache still answers with: cached (key, version, cached_at) at most ``seconds`` ago, and no write (key, version) at or above their version."""
    newest = writes.groupBy("key").agg(F.max("version").alias("__w"))
    kept = cached.join(newest, "key", "left").filter(F.col("__w").isNull() | (F.col("version") > F.col("__w"))).drop("__w")
    return kept.filter(F.unix_micros("cached_at") + seconds * 1_000_000 >= F.unix_micros(now))


def peer_stats(sent: DataFrame, peer: str, ok: Column, attempts: Column, at: str, max_attempts: int = 10) -> DataFrame:
    """Per peer: delivered, pending, failed for good, and when it was last reached."""
    return sent.groupBy(peer).agg(F.count_if(ok).alias("success"), F.count_if(~ok & (attempts < max_attempts)).alias("pending"), F.count_if(~ok & (attempts >= max_attempts)).alias("failures"), F.max(F.when(ok, F.col(at))).alias("last_sync"))


def random_peers(members: DataFrame, n: int, seed: int, own: str | None = None) -> DataFrame:
    """Up to ``n`` distinct other members, drawn by hash: the same seed gives the same ones, whatever the partitioning."""
    others = members.select("node").filter(F.col("node").isNotNull()).distinct()
    others = others if own is None else others.filter(F.col("node") != own)
    return others.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(n)


def incremented(log: DataFrame, node: Column) -> DataFrame:
    """Merged clock of each key with one more at ``node``: what the next write of the key carries."""
    return vclock.merge_all("vc", ["key"], log).withColumn("vc", vclock.increment(F.col("vc"), node))
