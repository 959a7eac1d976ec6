"""Replicas of the same keys: reconciliation, quorums, repair, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vclock
from ..session import checkpoint
from .skew import compress


def node_entries(log: DataFrame) -> DataFrame:
    """The entry each node holds of each key: highest version, then ts_ns; nulls lowest. Full rows decide ties."""
    top = F.max(F.struct("version", "ts_ns", "tombstone", "value")).alias("e")
    return log.groupBy("node", "key").agg(top).select("node", "key", "e.*")


def quorum_read(log: DataFrame) -> DataFrame:
    """Per key the entry of the highest version over all nodes and how many nodes hold that version.

    Tombstones compete like other entries; ``visible`` tells whether the winner is a value. Among nodes
    with equal version the first by (ts_ns desc, node asc) wins. Two aggregations on the key, no window.
    """
    entries = node_entries(log)
    best = F.max(F.struct("version", "ts_ns", "tombstone", "value")).alias("b")
    held = F.collect_list(F.struct("node", "version"))  # one element per node of the cluster
    picked = entries.groupBy("key").agg(best, held.alias("__h"))
    return picked.select(
        "key", "b.version", "b.value", (~F.col("b.tombstone")).alias("visible"),
        F.size(F.filter("__h", lambda x: x["version"].eqNullSafe(F.col("b.version")))).cast("long").alias("holders"),
    )


def ack_check(acks: DataFrame, need: int) -> DataFrame:
    """Per key: acks, whether the quorum is met, and whether it is met for all keys. acks: key, node, ok."""
    per_key = acks.groupBy("key").agg(F.count_if(F.col("ok")).alias("acks"))
    met = F.col("acks") >= need
    whole = per_key.agg(F.coalesce(F.bool_and(met), F.lit(True))).scalar()
    return per_key.select("key", "acks", met.alias("met"), whole.alias("all_met"))


def majority_repair(entries: DataFrame, value: Column) -> DataFrame:
    """Per key the most frequent value over its nodes and how many nodes differ from it.

    Ties go to the smallest value. A majority of empty values (or a null one) repairs nothing. ``value``
    is compared as text. Counts per (key, value) come first, so a key's copies are combined early.
    """
    votes = compress(entries.select("key", value.alias("v")), ["key"], "v", "w")
    best = F.min(F.struct((-F.col("w")).alias("w"), F.col("v").isNull().alias("z"), "v")).alias("m")
    agg = votes.groupBy("key").agg(best, F.sum("w").alias("n"))
    winner = F.col("m.v")
    return agg.select("key", winner.alias("winner"), F.when(F.coalesce(winner, F.lit("")) == "", F.lit(0)).otherwise(F.col("n") + F.col("m.w")).alias("repairs"))


def repair_plan(log: DataFrame) -> DataFrame:
    """Per key and node that holds an older version than the newest: key, node, has, wants."""
    entries = node_entries(log).select("node", "key", "version")
    top = entries.groupBy("key").agg(F.max("version").alias("wants"))
    return entries.join(top, "key").filter(F.coalesce(F.col("version"), F.lit(-1)) < F.col("wants")).select("key", "node", F.col("version").alias("has"), "wants")


def sync_actions(log: DataFrame, local: str, remote: str) -> DataFrame:
    """What anti-entropy does per key that differs: pull, push, or none where versions are equal.

    A key hidden by a tombstone counts as missing on that side, as a read would find it.
    """
    entries = node_entries(log).filter(~F.col("tombstone"))
    a = entries.filter(F.col("node") == local).select("key", F.col("version").alias("va"), F.col("value").alias("xa"), F.lit(True).alias("a"))
    b = entries.filter(F.col("node") == remote).select("key", F.col("version").alias("vb"), F.col("value").alias("xb"), F.lit(True).alias("b"))
    both = a.join(b, "key", "full")
    va, vb = F.coalesce("va", F.lit(-1)), F.coalesce("vb", F.lit(-1))
    action = F.when(F.col("a").isNull(), "pull").when(F.col("b").isNull(), "push").when(va < vb, "pull").when(va > vb, "push").otherwise("none")
    differs = F.col("a").isNull() | F.col("b").isNull() | (va != vb) | ~F.col("xa").eqNullSafe(F.col("xb"))
    return both.filter(differs).select("key", action.alias("action"))


def missing_keys(have: DataFrame, theirs: DataFrame) -> DataFrame:
    """Distinct keys stored here that the other side doesn't list."""
    return have.select("key").distinct().join(theirs.select("key"), "key", "left_anti")


def siblings(rows: DataFrame, clock: str = "vc") -> DataFrame:
    """Distinct clocks of each key that no other clock of the key is after, as canonical text.

    Null clocks count as empty. For each node the highest clock of the key is found first, by aggregation;
    whatever one of these few dominates is dropped. Only what is left is compared in pairs of one key.
    """
    base = rows.filter(F.col("key").isNotNull()).select("key", vclock.text(F.col(clock)).alias("t"), F.coalesce(F.col(clock), F.expr("cast(map() as map<string,bigint>)")).alias("c"))
    clocks = checkpoint(base.groupBy("key", "t").agg(F.first("c").alias("c")), "clocks")  # equal text, equal clock
    tops = (
        clocks.select("key", "t", "c", F.explode_outer(F.map_keys("c")).alias("n"))
        .groupBy("key", "n").agg(F.max(F.struct(F.element_at("c", F.col("n")).alias("x"), F.aggregate(F.map_values("c"), F.lit(0).cast("long"), lambda s, v: s + v).alias("s"), "t")).alias("top"))
        .groupBy("key").agg(F.collect_set("top.t").alias("tops"))
    )
    parse = lambda t: F.transform_values(F.str_to_map(t, F.lit(","), F.lit("=")), lambda k, v: v.cast("bigint"))
    safe = lambda t: F.when(t == "", F.expr("cast(map() as map<string,bigint>)")).otherwise(parse(t))
    left = clocks.join(tops, "key").filter(~F.exists("tops", lambda t: vclock.compare(F.col("c"), safe(t)) == vclock.BEFORE)).select("key", "t", "c")
    left = checkpoint(left, "maximal")
    other = left.select(F.col("key").alias("k2"), F.col("c").alias("c2"))
    beaten = (F.col("key") == F.col("k2")) & (vclock.compare(F.col("c"), F.col("c2")) == vclock.BEFORE)
    return left.join(other, beaten, "left_anti").select("key", F.col("t").alias("clock"))


def merge_members(known: DataFrame, contacted: DataFrame, now: Column) -> DataFrame:
    """Membership after contact: dead or suspect nodes revive with a higher incarnation, new ones enter with 1."""
    c = contacted.select("node").distinct().withColumn("seen", F.lit(True))
    both = known.join(c, "node", "full")
    seen, new = F.coalesce("seen", F.lit(False)), F.col("incarnation").isNull()
    return both.select(
        "node",
        F.when(seen, "alive").otherwise(F.col("state")).alias("state"),
        F.when(new, 1).when(seen & (F.col("state") != "alive"), F.col("incarnation") + 1).otherwise(F.col("incarnation")).cast("int").alias("incarnation"),
        F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def newest_incarnation(members: DataFrame) -> DataFrame:
    """Of the records of a node the one with the highest incarnation; of equal ones the one seen last, nulls first."""
    top = F.max(F.struct("incarnation", "last_seen", "state", "address")).alias("m")
    return members.groupBy("node").agg(top).select("node", "m.incarnation", "m.last_seen", "m.state", "m.address")


def liveness(members: DataFrame, now: Column, suspect_s: int = 30, dead_s: int = 60) -> DataFrame:
    """State by silence: suspect after more than ``suspect_s`` seconds, dead after more than ``dead_s``; never seen is dead."""
    silent = F.unix_micros(now) - F.unix_micros(F.col("last_seen"))
    state = F.when(F.col("last_seen").isNull() | (silent > dead_s * 1_000_000), "dead").when(silent > suspect_s * 1_000_000, "suspect").otherwise("alive")
    return members.withColumn("liveness", state)


def merge_gossip(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per node the state with the newer heartbeat; the other side's wins on equal heartbeats only if mine is missing."""
    both = mine.withColumn("own", F.lit(1)).unionByName(theirs.withColumn("own", F.lit(0)))
    top = F.max(F.struct("heartbeat", "own", "state")).alias("t")
    return both.groupBy("node").agg(top).select("node", "t.heartbeat", "t.state")
