"""Placement on a consistent-hash ring."""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import ring_hash

VNODES = 150
SPACE = 1 << 32


@dataclass(frozen=True)
class Ring:
    """Nodes in the order they were added, ``vnodes`` positions each.

    A ring is as small as its list of nodes, so it is laid out on the driver. Where two labels share a
    position the node added last owns it. Adding a known node or removing an unknown one changes nothing.
    """

    nodes: tuple[str, ...]
    vnodes: int = VNODES
    positions: tuple[tuple[int, str, int], ...] = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        owner = {}
        for node in self.nodes:
            for i in range(self.vnodes):
                owner[zlib.crc32(f"{node}#vnode{i}".encode())] = (node, i)
        object.__setattr__(self, "positions", tuple((p, *owner[p]) for p in sorted(owner)))

    def add(self, node: str) -> Ring:
        return self if node in self.nodes else Ring((*self.nodes, node), self.vnodes)

    def remove(self, node: str) -> Ring:
        return Ring(tuple(n for n in self.nodes if n != node), self.vnodes)

    def preference(self, at: int, n: int) -> list[str]:
        """First ``n`` distinct nodes clockwise from the index of a position."""
        found: list[str] = []
        for k in range(len(self.positions)):
            node = self.positions[(at + k) % len(self.positions)][1]
            if node not in found:
                found.append(node)
                if len(found) == min(n, len(self.nodes)):
                    break
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        """pos, node, vnode, and width: the share of the ring between the position before and this one."""
        p = self.positions
        rows = [(x[0], x[1], x[2], (x[0] - p[i - 1][0]) % SPACE or SPACE) for i, x in enumerate(p)]
        return spark.createDataFrame(rows, "pos long, node string, vnode int, width long")

    def slots(self, spark: SparkSession, replicas: int) -> tuple[DataFrame, int]:
        """The ring cut into 2^bits equal slots: per slot the vnodes a key of the slot can belong to.

        A key's vnode is the first at or after its hash: one inside its slot or the first one behind it.
        About four slots per vnode, so a slot lists one or two of them.
        """
        bits = max(4, min(24, (4 * len(self.positions)).bit_length()))
        shift, at = 32 - bits, [p[0] for p in self.positions]
        prefs = [self.preference(i, replicas) for i in range(len(at))]
        rows = []
        for s in range(1 << bits):
            lo, hi = bisect.bisect_left(at, s << shift), bisect.bisect_left(at, (s + 1) << shift)
            inside = [(at[i], prefs[i]) for i in range(lo, hi)]
            rows.append((s, [*inside, (SPACE, prefs[hi % len(at)])]))
        return spark.createDataFrame(rows, "slot long, vnodes array<struct<pos:long,replicas:array<string>>>"), shift


def place(df: DataFrame, key: str, ring: Ring, replicas: int = 3, out: str = "replicas", max_broadcast_slots: int = 1 << 18) -> DataFrame:
    """The input with the preference list of each key: first ``replicas`` distinct nodes clockwise.

    An equi-join with the ring's slots, whose number depends on the nodes alone; it is broadcast up to
    ``max_broadcast_slots`` (some 400 nodes of 150 positions) and shuffled beyond. A null key has a null
    list; so has every key of a ring without nodes.
    """
    if not ring.positions:
        return df.withColumn(out, F.lit(None).cast("array<string>"))
    slots, shift = ring.slots(df.sparkSession, replicas)
    if 1 << (32 - shift) <= max_broadcast_slots:
        slots = F.broadcast(slots)
    h = ring_hash(F.col(key))
    placed = df.withColumn("__h", h).withColumn("__slot", F.shiftright("__h", shift))
    joined = placed.join(slots.select(F.col("slot").alias("__slot"), F.col("vnodes").alias("__v")), "__slot", "left")
    return joined.withColumn(out, F.filter("__v", lambda v: v["pos"] >= F.col("__h"))[0]["replicas"]).drop("__slot", "__h", "__v")


def owner(df: DataFrame, key: str, ring: Ring, out: str = "node") -> DataFrame:
    return place(df, key, ring, 1, "__r").withColumn(out, F.col("__r")[0]).drop("__r")


def shares(df: DataFrame, key: str, ring: Ring) -> DataFrame:
    """Keys per node and their percentage. Nodes without keys have no row."""
    counts = owner(df, key, ring).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over a row per node
    return counts.select("node", "n", (F.col("n") * 100.0 / total).alias("percent"))


def movement(df: DataFrame, key: str, before: Ring, after: Ring) -> DataFrame:
    """Keys by old and new owner, where the owner changes."""
    both = owner(owner(df, key, before, "old_node"), key, after, "new_node")
    return both.filter("old_node <> new_node").groupBy("old_node", "new_node").agg(F.count(F.lit(1)).alias("n"))


def sloppy(preference: Column, alive: list[str], replicas: int, ring: Ring) -> Column:
    """Living preferred nodes in order, then other living nodes of the ring by name, up to ``replicas``."""
    living = F.array(*[F.lit(n) for n in alive]) if alive else F.array().cast("array<string>")
    names = sorted(n for n in ring.nodes if n in alive)
    others = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    healthy = F.filter(preference, lambda n: F.array_contains(living, n))
    return F.slice(F.concat(healthy, F.array_except(others, healthy)), 1, replicas)


def hint_targets(preference: Column, chosen: Column) -> Column:
    """Fallback nodes paired with the dead preferred nodes they stand in for, in order."""
    fallback, dead = F.array_except(chosen, preference), F.array_except(preference, chosen)
    n = F.least(F.size(fallback), F.size(dead))
    return F.arrays_zip(F.slice(fallback, F.lit(1), n).alias("fallback"), F.slice(dead, F.lit(1), n).alias("target"))


def fan_out(df: DataFrame, replicas: str = "replicas", out: str = "node") -> DataFrame:
    """One row per row and replica."""
    return df.withColumn(out, F.explode(replicas))
