"""Has this key been seen before? A sharded quotient filter with first positions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import checkpoint
from . import quotient

SHARD_KEYS, REMAINDER_BITS = 1 << 14, 13
_SIEVE_BITS = 16  # of the rows of 64 bits each that the exact check is narrowed with


class SeenFilter:
    """Which keys occurred, and from which position on, in bounded memory.

    The 64-bit hash of a key is cut into shard, quotient and remainder. A shard is one row holding a
    quotient filter: remainders in the slots of their quotients, three bits of run metadata a slot, and
    the first position of each fingerprint. Keys themselves aren't kept. A shard serves about
    ``SHARD_KEYS`` keys, stored or asked for, whatever the number of all, so no task and not the driver
    holds more.

    The answer "not seen" is always right. "Seen" is wrong if a key's fingerprint of p bits equals that of
    another key that came early enough: at most n/2^p for n stored keys (``expected_error``).
    """

    SCHEMA = "shard long, entries long, bytes long, blob binary"

    def __init__(self, shards: DataFrame | None, shard_bits: int, quotient_bits: int, remainder_bits: int):
        if shard_bits + quotient_bits + remainder_bits > 63:
            raise ValueError("shard, quotient and remainder bits must not exceed 63 together")
        self.shards, self.shard_bits, self.quotient_bits, self.remainder_bits = shards, shard_bits, quotient_bits, remainder_bits

    @staticmethod
    def widths(stored: int, asked: int = 0, shard_keys: int = SHARD_KEYS, load: float = 0.75) -> tuple[int, int]:
        """Bits of shard and quotient for expected numbers of keys on either side; the larger one sets the shards."""
        shard_bits = max(0, math.ceil(math.log2(max(1, stored, asked) / shard_keys)))
        return shard_bits, max(3, math.ceil(math.log2(max(1, stored) / (1 << shard_bits) / load)))

    def split(self, h: Column) -> tuple[Column, Column]:
        """Shard and fingerprint of a hash: its highest bits and those below them."""
        bits = self.quotient_bits + self.remainder_bits
        shard = F.shiftrightunsigned(h, 64 - self.shard_bits) if self.shard_bits else F.lit(0).cast("long")
        return shard, F.shiftrightunsigned(h, 64 - self.shard_bits - bits).bitwiseAND(F.lit((1 << bits) - 1))

    @classmethod
    def build(cls, prints: DataFrame, shard_bits: int, quotient_bits: int, remainder_bits: int = REMAINDER_BITS) -> SeenFilter:
        """A filter of (segment, h, pos) as ``fingerprints`` makes them: one for each segment and shard, then merged by shard."""
        self = cls(None, shard_bits, quotient_bits, remainder_bits)
        shard, fp = self.split(F.col("h"))

        def one(t: pa.Table) -> pa.Table:
            found, first = quotient.least_per_fingerprint(t["fp"].to_numpy().astype(np.uint64), t["pos"].to_numpy())
            return _shard_row(t, quotient.encode(found, first, quotient_bits, remainder_bits), len(found))

        parts = prints.select("segment", shard.alias("shard"), fp.alias("fp"), "pos").groupBy("segment", "shard").applyInArrow(one, cls.SCHEMA)
        self.shards = _merged(parts)
        return self

    def merge(self, other: SeenFilter) -> SeenFilter:
        """Both filters, shard by shard, from their sorted fingerprints; no key is read again."""
        widths = (self.shard_bits, self.quotient_bits, self.remainder_bits)
        if widths != (other.shard_bits, other.quotient_bits, other.remainder_bits):
            raise ValueError("filters of different widths")
        return SeenFilter(_merged(self.shards.unionByName(other.shards)), *widths)

    def probe(self, hashes: DataFrame) -> DataFrame:
        """Of distinct hashes (column h) those that may have been seen: ``h`` and ``first_pos`` of the fingerprint."""
        shard, fp = self.split(F.col("h"))

        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return _HIT.empty_table()
            hit, first = quotient.lookup(right["blob"][0].as_py(), left["fp"].to_numpy().astype(np.uint64))
            return pa.table({"h": left["h"].filter(pa.array(hit)), "first_pos": first[hit]}, schema=_HIT)

        asked = hashes.select("h", shard.alias("shard"), fp.alias("fp")).groupBy("shard")
        return asked.cogroup(self.shards.groupBy("shard")).applyInArrow(one, "h long, first_pos long")

    def expected_error(self) -> Column:
        """Probability that a key never seen is answered with "seen", for the summed entries of all shards."""
        return 1 - F.exp(-F.sum("entries") / F.lit(float(2 ** (self.shard_bits + self.quotient_bits + self.remainder_bits))))


_SHARD = pa.schema([("shard", pa.int64()), ("entries", pa.int64()), ("bytes", pa.int64()), ("blob", pa.binary())])
_HIT = pa.schema([("h", pa.int64()), ("first_pos", pa.int64())])


def _shard_row(t: pa.Table, blob: bytes, entries: int) -> pa.Table:
    return pa.table({"shard": [t["shard"][0].as_py()], "entries": [entries], "bytes": [len(blob)], "blob": [blob]}, schema=_SHARD)


def _merged(parts: DataFrame) -> DataFrame:
    """One filter of each shard out of its filters, taken in one after the other."""
    def one(t: pa.Table) -> pa.Table:
        blob, *others = t["blob"].to_pylist()
        for b in others:
            blob = quotient.merge(blob, b)
        return _shard_row(t, blob, quotient.Slots.open(blob).entries if others else t["entries"][0].as_py())

    return parts.groupBy("shard").applyInArrow(one, SeenFilter.SCHEMA)


def fingerprints(log: DataFrame, key: str, position: str, segment: str | None = None) -> DataFrame:
    """(segment, h, pos): hash and lowest position of each key of each segment; keys that are null or empty are left out.

    A key shrinks to a row per task before the shuffle, in which only numbers and the segment travel.
    """
    by = F.col(segment) if segment else F.lit(None).cast("string")
    rows = log.filter((F.col(key) != "") & F.col(position).isNotNull())
    return rows.groupBy(by.alias("segment"), F.xxhash64(key).alias("h")).agg(F.min(position).cast("long").alias("pos"))


def decide(requests: DataFrame, log: DataFrame, request_id: str, key: str, limit: str, position: str, segment: str | None = None, remainder_bits: int = REMAINDER_BITS) -> tuple[DataFrame, SeenFilter, DataFrame]:
    """Answers (id, ``maybe``, ``seen``), the filter they come from, and the requests that count.

    A row comes out for each request the filter answers with "seen"; all others were surely not seen.
    ``seen`` is the answer after an exact check, which is made for these alone: the log is read again, a
    bounded bit table of the hit hashes (broadcast, 2^16 words of 64 bits) drops the rows of other keys
    before they are grouped, and a hit holds if its very key has a position up to the limit.

    Requests with a null or empty key or null limit are never seen. Repeated requests come out once.
    ``segment`` names a column of the log (its writer, say): each segment has filters of its own, which
    are merged. Filter and hits are written to the shared folder.
    """
    wanted = requests.filter((F.col(key) != "") & F.col(limit).isNotNull()).select(F.col(request_id).alias("__id"), F.col(key).alias("__key"), F.col(limit).alias("__limit"), F.xxhash64(key).alias("h"))
    asked = checkpoint(wanted.select("h").distinct(), "asked")
    prints = checkpoint(fingerprints(log, key, position, segment), "fingerprints")
    built = SeenFilter.build(prints, *SeenFilter.widths(prints.count(), asked.count()), remainder_bits)
    built.shards = checkpoint(built.shards, "filter")
    hits = checkpoint(built.probe(asked), "hits")

    bucket, bit = F.col("h").bitwiseAND(F.lit((1 << _SIEVE_BITS) - 1)), F.shiftright("h", _SIEVE_BITS).bitwiseAND(F.lit(63))
    marks = F.bit_or(F.expr("shiftleft(1L, cast(__bit as int))"))
    sieve = hits.select(bucket.alias("__b"), bit.alias("__bit")).groupBy("__b").agg(marks.alias("__m"))
    rows = log.filter((F.col(key) != "") & F.col(position).isNotNull())
    return rows.groupBy(by.alias("segment"), F.xxhash64(key).alias("h")).agg(F.min(position).cast("long").alias("pos"))


def decide(requests: DataFrame, log: DataFrame, request_id: str, key: str, limit: str, position: str, segment: str | None = None, remainder_bits: int = REMAINDER_BITS) -> tuple[DataFrame, SeenFilter, DataFrame]:
    """Answers (id, ``maybe``, ``seen``), the filter they come from, and the requests that count.

    A row comes out for each request the filter answers with "seen"; all others were surely not seen.
    ``seen`` is the answer after an exact check, which is made for these alone: the log is read again, a
    bounded bit table of the hit hashes (broadcast, 2^16 words of 64 bits) drops the rows of other keys
    before they are grouped, and a hit holds if its very key has a position up to the limit.

    Requests with a null or empty key or null limit are never seen. Repeated requests come out once.
    ``segment`` names a column of the log (its writer, say): each segment has filters of its own, which
    are merged. Filter and hits are written to the shared folder.
    """
    wanted = requests.filter((F.col(key) != "") & F.col(limit).isNotNull()).select(F.col(request_id).alias("__id"), F.col(key).alias("__key"), F.col(limit).alias("__limit"), F.xxhash64(key).alias("h"))
    asked = checkpoint(wanted.select("h").distinct(), "asked")
    prints = checkpoint(fingerprints(log, key, position, segment), "fingerprints")
    built = SeenFilter.build(prints, *SeenFilter.widths(prints.count(), asked.count()), remainder_bits)
    built.shards = checkpoint(built.shards, "filter")
    hits = checkpoint(built.probe(asked), "hits")

    bucket, bit = F.col("h").bitwiseAND(F.lit((1 << _SIEVE_BITS) - 1)), F.shiftright("h", _SIEVE_BITS).bitwiseAND(F.lit(63))
    sieve = hits.groupBy(bucket.alias("__b")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__bit as int))")).alias("__m")) if False else (
        hits.select(bucket.alias("__b"), bit.alias("__bit")).groupBy("__b").agg(F.bit_or(F.expr("shiftleft(1L, cast(__bit as int))")).alias("__m")))
    rows = log.filter((F.col(key) != "") & F.col(position).isNotNull()).select(F.col(key).alias("__k"), F.col(position).alias("__pos"), F.xxhash64(key).alias("h"))
    rows = rows.withColumn("__b", bucket).withColumn("__bit", bit).join(F.broadcast(sieve), "__b").filter(F.expr("shiftright(__m, cast(__bit as int)) & 1L = 1L"))
    true = rows.groupBy("h", "__k").agg(F.min("__pos").alias("__first"))
    true = true.groupBy("h").agg(F.collect_list(F.struct("__k", "__first")).alias("__true"))  # keys of equal 64-bit hash: one, but for chance
    passed = checkpoint(hits.join(true, "h", "left"), "passed")

    joined = salted_join(wanted, passed, "h").filter(F.col("first_pos") <= F.col("__limit"))
    held = F.coalesce(F.exists("__true", lambda x: (x["__k"] == F.col("__key")) & (x["__first"] <= F.col("__limit"))), F.lit(False))
    answers = joined.groupBy(F.col("__id").alias(request_id)).agg(F.max(F.lit(True)).alias("maybe"), F.max(held).alias("seen"))
    return answers, built, wanted.select(F.col("__id").alias(request_id))


def answered(requests: DataFrame, log: DataFrame, request_id: str, key: str, limit: str, position: str, segment: str | None = None, remainder_bits: int = REMAINDER_BITS) -> DataFrame:
    """For each request that the filter answers with "seen": id, ``maybe`` (true) and the checked answer ``seen``; see ``decide``."""
    return decide(requests, log, request_id, key, limit, position, segment, remainder_bits)[0]


def error_report(requests: DataFrame, log: DataFrame, request_id: str, key: str, limit: str, position: str, segment: str | None = None, remainder_bits: int = REMAINDER_BITS) -> DataFrame:
    """One row on the filter that ``answered`` builds: distinct requests with a key, positive answers, wrong ones, entries
    stored, expected rate, bits a key, and the measured rate: wrong answers over truly unseen requests (0 without such)."""
    answers, built, counted = decide(requests, log, request_id, key, limit, position, segment, remainder_bits)
    asked = counted.agg(F.countDistinct(request_id).alias("requests"))
    size = built.shards.agg(built.expected_error().alias("expected_rate"), F.coalesce(F.sum("entries"), F.lit(0)).alias("stored"), (8 * F.sum("bytes") / F.sum("entries")).alias("bits_per_key"))
    got = answers.agg(F.count(F.lit(1)).alias("positives"), F.count_if(~F.col("seen")).alias("wrong"))
    row = lambda df: df.select(F.struct("*")).scalar()
    whole = asked.select("requests", row(size).alias("s"), row(got).alias("g")).select("requests", "s.*", "g.*")
    unseen = F.col("requests") - F.col("positives") + F.col("wrong")
    return whole.withColumn("measured_rate", F.when(unseen > 0, F.col("wrong") / unseen).otherwise(F.lit(0.0)))
