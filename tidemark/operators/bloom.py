"""Bloom filters: sizing, building and probing."""

from __future__ import annotations

import math
import struct
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fnv64, mixed
from ..session import checkpoint

def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and number of hashes for n keys at false-positive rate p; odd arguments fall back to 1000 and 0.01."""
    n = n if n > 0 else 1000
    p = p if 0 < p < 1 else 0.01
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, round(m / n * math.log(2)))


def bloom_size_columns(n: Column, p: Column) -> tuple[Column, Column]:
    """The same as column expressions."""
    n = F.when(n > 0, n).otherwise(1000)
    p = F.when((p > 0) & (p < 1), p).otherwise(0.01)
    m = F.ceil(-n * F.log(p) / F.pow(F.log(F.lit(2.0)), F.lit(2)))
    return m, F.greatest(F.lit(1), F.round(m / n * F.log(F.lit(2.0)))).cast("long")


def _positions(h1: np.ndarray, h2: np.ndarray, m: int, k: int) -> np.ndarray:
    """Bit positions of each key, one column a hash."""
    steps = np.arange(k, dtype=np.uint64)
    return ((h1[:, None] + steps * h2[:, None]) % np.uint64(m)).astype(np.int64)


def sized(stored: int, asked: int = 0, shard_keys: int = 1 << 14, p: float = 0.01) -> tuple[int, int, int]:
    """Bits of the shard number, bits of a shard's array, and hashes: the larger side sets the number of shards."""
    shard_bits = max(0, math.ceil(math.log2(max(1, stored, asked) / shard_keys)))
    return shard_bits, *bloom_size(math.ceil(stored / (1 << shard_bits) * 1.02) + 1, p)


def build_shards(keys: DataFrame, key: str, asked: int = 0, shard_keys: int = 1 << 14, p: float = 0.01) -> tuple[DataFrame, int, int, int]:
    """A filter cut into shards by hash: (shard, bits). Each has its own bit array, sized for its keys.

    Two independent 64-bit hashes are taken on the JVM side; the leading bits of the first are the shard.
    Distinct hashes are formed first, so repeated keys don't weigh on a shard. Null keys are left out.
    """
    distinct = checkpoint(_hashed(keys.filter(F.col(key).isNotNull()), key).select("h1", "h2").distinct(), "keys")
    shard_bits, m, hashes = sized(distinct.count(), asked, shard_keys, p)

    def one(t: pa.Table) -> pa.Table:
        bits = np.zeros(m, bool)
        bits[_positions(t["h1"].to_numpy().view(np.uint64), t["h2"].to_numpy().view(np.uint64), m, hashes).ravel()] = True
        return pa.table({"shard": [t["shard"][0].as_py()], "bits": [np.packbits(bits).tobytes()]}, schema=_SHARD)

    return distinct.withColumn("shard", _shard(shard_bits)).groupBy("shard").applyInArrow(one, "shard long, bits binary"), shard_bits, m, hashes


_SHARD = pa.schema([("shard", pa.int64()), ("bits", pa.binary())])


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.xxhash64(key).alias("h1"), F.xxhash64(F.col(key), F.lit(1)).bitwiseOR(F.lit(1)).alias("h2"))


def _shard(bits: int) -> Column:
    return F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("long")


def might_contain(keys: DataFrame, key: str, shards: DataFrame, shard_bits: int, m: int, hashes: int) -> DataFrame:
    """Of the distinct keys those the filter can't rule out; never one less than it holds."""
    wanted = _hashed(keys.filter(F.col(key).isNotNull()).select(key).distinct(), key).withColumn("shard", _shard(shard_bits))

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.schema([("k", pa.string())]).empty_table()
        bits = np.unpackbits(np.frombuffer(right["bits"][0].as_py(), np.uint8), count=m).astype(bool)
        at = _positions(left["h1"].to_numpy().view(np.uint64), left["h2"].to_numpy().view(np.uint64), m, hashes)
        return left.select(["k"]).filter(pa.array(bits[at].all(axis=1)))

    return wanted.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(one, "k string").withColumnRenamed("k", key)


class StoredFilter:
    """The filter in the store's own files: bits (8 bytes), hashes (4), then the bit array, all low byte first."""

    def __init__(self, bits: np.ndarray, m: int, hashes: int):
        self.bits, self.m, self.hashes = bits, m, hashes

    @classmethod
    def of(cls, keys: list[bytes], m: int, hashes: int) -> StoredFilter:
        self = cls(np.zeros(-(-m // 64) * 64, bool), m, hashes)
        self.bits[self._places(keys).ravel()] = True
        return self

    @classmethod
    def read(cls, blob: bytes) -> StoredFilter:
        m, hashes = struct.unpack_from("<QI", blob)
        body = np.frombuffer(blob, np.uint8, (len(blob) - 12) // 8 * 8, 12)
        if not 0 < hashes <= 100 or not len(body):
            raise ValueError("not a filter")
        return cls(np.unpackbits(body, bitorder="little").astype(bool), min(m, 8 * len(body)), hashes)

    def dump(self) -> bytes:
        return struct.pack("<QI", self.m, self.hashes) + np.packbits(self.bits, bitorder="little").tobytes()

    def _places(self, keys: list[bytes]) -> np.ndarray:
        first = fnv64(keys)
        return _positions(first, mixed(first), self.m, self.hashes)

    def may_hold(self, keys: list[bytes]) -> np.ndarray:
        return self.bits[self._places(keys)].all(axis=1)
