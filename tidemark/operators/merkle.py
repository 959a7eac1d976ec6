"""Merkle summaries of sorted keys and values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import byte_sum
from ..session import checkpoint
from .snapshot import global_rank

LEAF_KEYS, BUCKETS = 4, 1024
EMPTY_ROOT = hashlib.sha256().hexdigest()


def leaf_size_steps(n: Column) -> Column:
    """Number of halvings until every part has at most four keys: depth of the deepest leaf."""
    return F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(1)) / LEAF_KEYS)), F.lit(0)).cast("int")


def leaves(rows: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Leaves of the tree over sorted distinct keys: lo, hi (positions), keys, hash.

    The interval of a key's leaf follows from its position and the number of keys by repeated halving, as
    a column expression; no table of intervals is built. A hash is over zero, key, zero, value, zero for
    each key; a null value counts as empty.
    """
    ranked = global_rank(rows.select(F.col(key).alias("key"), F.col(value).cast("binary").alias("value")), [F.col("key")], "pos", "n")
    start = F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))

    def halve(s, _):
        mid = s["lo"] + F.floor((s["hi"] - s["lo"]) / 2)
        left = F.col("pos") < mid
        return F.when(s["hi"] - s["lo"] <= LEAF_KEYS, s).otherwise(F.struct(F.when(left, s["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi")))

    at = F.aggregate(F.sequence(F.lit(0), leaf_size_steps(F.col("n"))), start, halve)
    zero = F.unhex(F.lit("00"))
    piece = F.concat(zero, F.col("key").cast("binary"), zero, F.coalesce("value", F.expr("X''")), zero)
    parts = ranked.select("key", "pos", "n", piece.alias("piece"), at.alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "key", "piece")))  # four at most
    grouped = parts.groupBy("at.lo", "at.hi", "n").agg(listed.alias("l"))
    body = F.aggregate("l", F.expr("X''"), lambda a, x: F.concat(a, x["piece"]))
    return grouped.select("lo", "hi", "n", F.transform("l", lambda x: x["key"]).alias("keys"), F.sha2(body, 256).alias("hash"))


def levels_up(leaf: DataFrame, n: int) -> DataFrame:
    """The root over leaves: nodes are joined to their parents level by level from the deepest.

    Parents are found from positions by the same halving, so each level is one aggregation of pairs on
    (lo, hi) of the parent, half as many rows as the level below.
    """
    spark = leaf.sparkSession
    if n == 0:
        return spark.createDataFrame([(EMPTY_ROOT,)], "hash string")
    depth = 0
    while (n + (1 << depth) - 1) >> depth > LEAF_KEYS:
        depth += 1
    nodes = leaf.select("lo", "hi", "hash")
    for d in range(depth - 1, -1, -1):
        start = F.struct(F.lit(0).cast("long").alias("lo"), F.lit(n).cast("long").alias("hi"))

        def halve(s, _):
            mid = s["lo"] + F.floor((s["hi"] - s["lo"]) / 2)
            left = F.col("lo") < mid
            return F.struct(F.when(left, s["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi"))

        parent = F.aggregate(F.sequence(F.lit(1), F.lit(d)), start, halve) if d else start
        up = nodes.withColumn("__p", parent)
        pair = F.array_sort(F.collect_list(F.struct("lo", "hi", "hash")))  # a node that is a leaf already, or two children
        both = up.groupBy(F.col("__p.lo").alias("plo"), F.col("__p.hi").alias("phi")).agg(pair.alias("c"))
        joined = F.sha2(F.concat(F.unhex(F.col("c")[0]["hash"]), F.unhex(F.get("c", F.lit(1))["hash"])), 256)
        nodes = both.select(F.col("plo").alias("lo"), F.col("phi").alias("hi"), F.when(F.size("c") == 1, F.col("c")[0]["hash"]).otherwise(joined).alias("hash"))
    return nodes.select("hash")


def root(rows: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row with the root hash; of no keys the hash of nothing."""
    leaf = checkpoint(leaves(rows, key, value), "leaves")
    n = leaf.agg(F.max("n")).first()[0] or 0
    return levels_up(leaf, n)


def diff_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose value hashes differ or that one side lacks (exact, by key rather than by position)."""
    digest = F.sha2(F.coalesce(F.col("value").cast("binary"), F.expr("X''")), 256)
    x, y = a.select("key", digest.alias("ha")), b.select("key", digest.alias("hb"))
    return x.join(y, "key", "full").filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("key")


def bucket_roots(keys: DataFrame, key: str = "key") -> DataFrame:
    """Bucketed tree over distinct keys: one hash per bucket, folded over the keys of the bucket in order.

    The bucket is the sum of the bytes of the key's SHA-256, each times its place, modulo 1024. The fold
    is a chain of hashes and so sequential by definition: it streams through partitions sorted by
    (bucket, key) with one hash in memory, whatever the size of a bucket.
    """
    digest = F.sha2(F.col(key).cast("binary"), 256)
    numbers = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(F.substr(digest, i * 2 - 1, F.lit(2)), 16, 10).cast("long") * i)
    bucket = F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x) % BUCKETS
    rows = keys.select(F.col(key).alias("key")).distinct().select("key", F.unhex(digest).alias("d"), bucket.alias("bucket"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain, done = None, b"", []
        for b in batches:
            for n, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n == at:
                    chain = hashlib.sha256(chain + d).digest()
                else:
                    done += [] if at is None else [(at, chain.hex())]
                    at, chain = n, d
        done += [] if at is None else [(at, chain.hex())]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done])], ["bucket", "hash"])

    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "key").select("bucket", "d")
    return ordered.mapInArrow(fold, "bucket long, hash string")


def bucket_root(spark: SparkSession, buckets: DataFrame) -> DataFrame:
    """Root over the bucket hashes (1024 at most) by bucket number; empty text without buckets."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "hash"))), lambda x: x["hash"])
    fold = F.aggregate("hs", F.lit(""), lambda a, x: F.sha2(F.unhex(F.concat(a, x)), 256))
    return buckets.agg(listed.alias("hs")).select(fold.alias("hash"))


def paths(leaf: DataFrame) -> DataFrame:
    """Leaves with ``path``: 1 and then a bit for each turn from the root, 0 for left."""
    start = F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("hi"), F.lit(1).cast("long").alias("path"))

    def turn(s, _):
        mid = s["lo"] + F.floor((s["hi"] - s["lo"]) / 2)
        left = F.col("lo") < mid
        down = F.struct(F.when(left, s["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi"), (s["path"] * 2 + F.when(left, 0).otherwise(1)).alias("path"))
        return F.when(s["hi"] - s["lo"] <= LEAF_KEYS, s).otherwise(down)

    return leaf.withColumn("path", F.aggregate(F.sequence(F.lit(0), leaf_size_steps(F.col("n"))), start, turn)["path"])


def diff_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of the leaves that have no equal leaf at the same place of the other tree: what comparing the trees finds.

    A superset of ``diff_keys``: leaves hold up to four keys, and a key on one side only shifts those behind it.
    """
    x, y = (paths(leaves(t)).select("path", "hash", "keys") for t in (a, b))
    own = lambda p, q: p.join(q.select("path", "hash"), ["path", "hash"], "left_anti").select(F.explode("keys").alias("key"))
    return own(x, y).unionByName(own(y, x)).distinct()


def weak_root(keys: DataFrame, key: str = "key") -> DataFrame:
    """Root of the byte-sum tree over keys in order: pairs of neighbours become the sum of their hashes, an odd last one moves up.

    A hash is eight bytes, low first, of the sum of bytes times their place. Levels are aggregations on the
    halved position; there are as many as the logarithm of the number of keys.
    """
    nodes = checkpoint(global_rank(keys.select(F.col(key).alias("key")), [F.col("key")], "pos").select("pos", byte_sum(F.col("key")).alias("h")), "weak")
    n = nodes.count()
    if n == 0:
        return nodes.sparkSession.createDataFrame([("",)], "hash string")

    def joined(l, r):
        byte = lambda h, i: F.shiftright(h, 8 * i).bitwiseAND(F.lit(255))
        return sum(byte(l, i) * (i + 1) for i in range(8)) + sum(byte(r, i) * (i + 9) for i in range(8))

    level = 0
    while n > 1:
        pair = nodes.groupBy(F.floor(F.col("pos") / 2).alias("pos")).agg(F.min(F.struct("pos", "h")).alias("l"), F.max(F.struct("pos", "h")).alias("r"))
        nodes = pair.select("pos", F.when(F.col("l.pos") == F.col("r.pos"), F.col("l.h")).otherwise(joined(F.col("l.h"), F.col("r.h"))).alias("h"))
        n, level = -(-n // 2), level + 1
        if level % 4 == 0:
            nodes = checkpoint(nodes, "weak")
    bytes_low_first = F.concat(*[F.lpad(F.lower(F.hex(F.shiftright("h", 8 * i).bitwiseAND(F.lit(255)))), 2, "0") for i in range(8)])
    return nodes.select(bytes_low_first.alias("hash"))
