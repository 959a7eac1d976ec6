"""Reproducible workloads: operation mixes and key distributions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import scramble

# Share of each operation in percent, by workload, and its distribution of keys.
MIXES = {
    "A": ({"read": 50, "update": 50}, "zipfian"),
    "B": ({"read": 95, "update": 5}, "zipfian"),
    "C": ({"read": 100}, "zipfian"),
    "D": ({"read": 95, "insert": 5}, "latest"),
    "E": ({"scan": 95, "insert": 5}, "zipfian"),
    "F": ({"read": 50, "rmw": 50}, "zipfian"),
}
#: The command line's own mixes where they differ.
CLI_MIXES = MIXES | {"E": ({"scan": 75, "insert": 25}, "zipfian"), "mixed": ({"read": 80, "update": 20}, "zipfian")}
THETA = 0.99


def zeta(n: int, theta: float = THETA, exact: int = 100_000) -> float:
    """Sum of 1/i^theta for i up to n: term by term up to ``exact``, beyond by the Euler-Maclaurin formula."""
    head = math.fsum(i**-theta for i in range(1, min(n, exact) + 1))
    if n <= exact:
        return head
    a, b = float(exact), float(n)
    area = math.log(b / a) if theta == 1 else (b ** (1 - theta) - a ** (1 - theta)) / (1 - theta)
    return head + area + (b**-theta - a**-theta) / 2 + theta * (a ** (-theta - 1) - b ** (-theta - 1)) / 12


def zipfian(u: Column, n: int, theta: float = THETA) -> Column:
    """Ranks from 0 of a zipfian distribution over n items out of uniform numbers in [0, 1)."""
    if n < 2:
        return F.lit(0).cast("long") + F.floor(u * 0)
    total = zeta(n, theta)
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - zeta(2, theta) / total)
    rest = F.floor(F.lit(float(n)) * F.pow(F.lit(eta) * u - eta + 1, F.lit(1 / (1 - theta))))
    return F.when(u * total < 1, 0).when(u * total < 1 + 0.5**theta, 1).otherwise(F.least(rest, F.lit(n - 1))).cast("long")


def scrambled(rank: Column, n: int) -> Column:
    """Ranks spread over the key space by hash."""
    return scramble(rank) % n


def latest(u: Column, inserted: Column) -> Column:
    """An index that falls off exponentially from the newest one, 0 at least."""
    back = F.floor(F.abs(-F.log(1 - u) * inserted * 0.01))
    return F.greatest(inserted - back, F.lit(0)).cast("long")


def power_zipf(u: Column, n: int) -> Column:
    """Floor of n^u."""
    return F.floor(F.pow(F.lit(float(n)), u)).cast("long")


def key_name(index: Column, form: str = "user%010d") -> Column:
    return F.format_string(form, index)


def load_phase(spark: SparkSession, n: int, value_bytes: int = 100, batch: int = 500) -> DataFrame:
    """The rows a load phase writes, in batches."""
    return spark.range(n).select(key_name(F.col("id")).alias("key"), F.rpad(F.lit(""), value_bytes, "x").alias("value"), F.floor(F.col("id") / batch).alias("batch"))


def bulk_keys(spark: SparkSession, clients: int, batches: int, size: int) -> DataFrame:
    """The keys a bulk loader writes: client, batch, key."""
    i = F.col("id")
    rows = spark.range(clients * batches * size).select(F.floor(i / (batches * size)).alias("client"), (F.floor(i / size) % batches).alias("batch"), (i % size).alias("k"))
    return rows.select("client", "batch", F.format_string("bulk:%02d:%02d:%03d", "client", "batch", "k").alias("key"))


def trickle(spark: SparkSession, per_second: int = 1, keys: int = 1000, form: str = "user%010d") -> DataFrame:
    """An endless stream of small writes: key, value, ts; keys come round in turn."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(key_name(F.col("value") % keys, form).alias("key"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts"))


def go_zipf(u: Column, n: int, s: float = 1.01, v: float = 1.0, exact: int = 4096) -> Column:
    """Ranks from 0 to n - 1 with probability as 1/(v + rank)^s, out of uniform numbers: the first ``exact`` ranks by their
    summed weights, those beyond by inverting the integral that continues the sum."""
    head = [(v + i) ** -s for i in range(min(n, exact))]
    tail = lambda x: (v + x) ** (1 - s) / (1 - s)
    rest = tail(n - 0.5) - tail(len(head) - 0.5) if n > len(head) else 0.0
    total, sums, upto = math.fsum(head) + rest, [], 0.0
    for w in head:
        upto += w
        sums.append(upto / total)
    known = F.array(*[F.lit(x) for x in sums])
    # the number of sums at or below u, by halving
    steps = max(1, len(sums).bit_length())
    at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(sums)).alias("hi")), lambda a, _: _halve(a, known, u))["lo"]
    beyond = F.floor(F.pow((u * total - upto + tail(len(head) - 0.5)) * (1 - s), F.lit(1 / (1 - s))) - v + 0.5)
    return F.when(at < len(sums), at).otherwise(F.least(F.greatest(beyond, F.lit(len(sums) - (n <= len(sums)))), F.lit(n - 1))).cast("long")


def _halve(a: Column, known: Column, u: Column) -> Column:
    mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    right = (a["lo"] < a["hi"]) & (F.get(known, mid) <= u)
    return F.struct(F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(right | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))


def operations(spark: SparkSession, workload: str, n: int, records: int, seed: int = 42, mixes: dict = MIXES) -> DataFrame:
    """``n`` operations of a workload over ``records`` keys: seq, op, key. The same seed gives the same rows.

    Draws are hashes of the sequence number rather than a generator's state, so they don't depend on how
    the rows are partitioned.
    """
    mix, kind = mixes[workload]
    draw = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    base = spark.range(n).select("id", draw(0).alias("u0"), draw(1).alias("u1"))
    op, upto = None, 0
    for name, share in mix.items():
        upto += share
        test = F.col("u0") * 100 < upto
        op = F.when(test, name) if op is None else op.when(test, name)
    op = op.otherwise(list(mix)[-1])
    index = latest(F.col("u1"), F.lit(records - 1)) if kind == "latest" else scrambled(zipfian(F.col("u1"), records), records)
    index = F.when(F.col("op") == "insert", F.lit(records) + F.col("id")).otherwise(index)
    return base.withColumn("op", op).select(F.col("id").alias("seq"), "op", key_name(index).alias("key"))


def throughput(ops: DataFrame, seconds: Column) -> DataFrame:
    """Operations per second by class."""
    return ops.groupBy("op").agg((F.count(F.lit(1)) / seconds).alias("per_s"))
