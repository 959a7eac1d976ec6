"""Scalar functions of the store as Column expressions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_KEY_BYTES, MAX_VALUE_BYTES = 1024, 1 << 20
MB = 1 << 20
#: Upper bounds of the size tiers of runs, in bytes; larger runs are of the last tier.
TIER_BOUNDS = (MB, 10 * MB, 100 * MB, 1024 * MB)
# Offset basis and prime of FNV-1a, and the multiplier of the second hash.
FNV32 = (2166136261, 16777619)
FNV64 = (14695981039346656037, 1099511628211)
MIX = 0xBF58476D1CE4E5B9


def ring_hash(key: Column) -> Column:
    """Position on the hash ring: CRC-32 of the key's bytes."""
    return F.crc32(key.cast("binary"))


def _bytes(key: Column) -> Column:
    """The bytes of a string as an array of numbers."""
    text = F.hex(key.cast("binary"))
    at = F.sequence(F.lit(1), F.greatest(F.octet_length(key), F.lit(1)))
    numbers = F.transform(at, lambda i: F.conv(F.substr(text, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.octet_length(key) > 0, numbers).otherwise(F.array().cast("array<bigint>"))


def fnv1a_32(key: Column) -> Column:
    """FNV-1a, 32 bits, as BIGINT."""
    basis, prime = FNV32
    mask = F.lit(0xFFFFFFFF)
    return F.aggregate(_bytes(key), F.lit(basis).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(prime).cast("long")).bitwiseAND(mask))


def byte_sum(key: Column) -> Column:
    """Sum of bytes, each times its place counted from 1."""
    numbers = F.transform(_bytes(key), lambda b, i: b * (i + 1))
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)


def fnv64(data: list[bytes]) -> np.ndarray:
    """FNV-1a, 64 bits, of many byte strings at once: one step over all that are long enough for each place."""
    basis, prime = FNV64
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    h = np.full(len(data), basis, np.uint64)
    longer = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(data) else 0) + 1), "right")
    for place, n in enumerate(longer.tolist()):
        h[:n] = (h[:n] ^ flat[starts[:n] + place]) * np.uint64(prime)
    out = np.empty_like(h)
    out[order] = h
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """The second hash of a pair: folded, multiplied, folded again."""
    h = (h ^ (h >> np.uint64(17))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(31))


def _known(keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    there = keys.notna().to_numpy()
    return there, fnv64([k.encode() for k in keys[there]])


def _decimal(there: np.ndarray, h: np.ndarray) -> list[str | None]:
    found = iter(map(str, h.tolist()))
    return [next(found) if x else None for x in there]


@F.pandas_udf(T.StringType())
def fnv1a_64(keys: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, as unsigned decimal text (it exceeds BIGINT)."""
    return pd.Series(_decimal(*_known(keys)), dtype=object)


@F.pandas_udf(T.StringType())
def fnv1a_64_second(keys: pd.Series) -> pd.Series:
    """The hash that goes with ``fnv1a_64`` in a Bloom filter."""
    there, h = _known(keys)
    return pd.Series(_decimal(there, mixed(h)), dtype=object)


@F.pandas_udf(T.LongType())
def scramble(ids: pd.Series) -> pd.Series:
    """FNV-1a over the eight bytes of an integer, low byte first, top bit cleared."""
    basis, prime = FNV64
    n = ids.to_numpy(np.int64).view(np.uint64)
    h = np.full(len(n), basis, np.uint64)
    for place in range(8):
        h = (h ^ ((n >> np.uint64(8 * place)) & np.uint64(255))) * np.uint64(prime)
    return pd.Series((h & np.uint64((1 << 63) - 1)).astype(np.int64))


def admission(key: Column, value: Column, need_value: bool = False) -> Column:
    """``ok`` or why a write is refused: empty_key, key_too_long, value_too_large, empty_value."""
    status = (
        F.when(key.isNull() | (key == ""), "empty_key")
        .when(F.octet_length(key) > MAX_KEY_BYTES, "key_too_long")
        .when(F.octet_length(value) > MAX_VALUE_BYTES, "value_too_large")
    )
    if need_value:
        status = status.when(value.isNull() | (F.octet_length(value) == 0), "empty_value")
    return status.otherwise("ok")


def size_tier(size: Column) -> Column:
    tier = F.when(size < TIER_BOUNDS[0], 0)
    for n, bound in enumerate(TIER_BOUNDS[1:], 1):
        tier = tier.when(size < bound, n)
    return tier.otherwise(len(TIER_BOUNDS))


def level_capacity(level: Column, threshold: int, ratio: float) -> Column:
    """Runs a level may hold: threshold times ratio to the power of the level, rounded down."""
    return F.floor(F.lit(float(threshold)) * F.pow(F.lit(float(ratio)), level))


def format_bytes(n: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    show = lambda by, unit: F.format_string(f"%.2f {unit}", n / F.lit(by))
    return F.when(n >= gb, show(gb, "GB")).when(n >= mb, show(mb, "MB")).when(n >= kb, show(kb, "KB")).otherwise(F.format_string("%d B", n))


def truncate_text(text: Column, n: int) -> Column:
    """At most ``n`` characters, the last three being dots if something was cut; empty for n up to 3."""
    if n <= 3:
        return F.when(F.length(text) > n, F.lit("")).otherwise(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def quorum_status(n: Column, w: Column, r: Column) -> Column:
    """``ok``, or why replicas, write and read quorum don't fit together."""
    return (
        F.when((n <= 0) | (w <= 0) | (r <= 0) | (w > n) | (r > n), "invalid_quorum")
        .when(w + r <= n, "no_overlap")
        .otherwise("ok")
    )


def glob_to_like(pattern: str) -> str:
    """A pattern with ``*`` and ``?`` as LIKE pattern with backslash as escape; the literal prefix can be pushed down."""
    out = ""
    for c in pattern:
        out += {"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c)
    return out


def host_of(address: Column) -> Column:
    """Host part of ``http://host:port/path`` or ``host:port``."""
    return F.regexp_extract(address, r"^(?:[a-z]+://)?(\[[^\]]*\]|[^:/]*)", 1)


def key_of_path(path: Column, prefix: str) -> Column:
    """What follows ``prefix`` in a URL path, percent signs decoded; empty if the path doesn't start with it."""
    return F.when(path.startswith(prefix), F.url_decode(F.substring(path, len(prefix) + 1, 1 << 20))).otherwise(F.lit(""))


def grpc_address(address: Column, port: int) -> Column:
    """``host:port`` of an address with or without scheme, port and path."""
    return F.concat(host_of(address), F.lit(f":{port}"))


def quorum_feasible(healthy: Column, need: Column) -> Column:
    """Whether enough nodes are healthy for a quorum."""
    return healthy >= need


def unix_nanos(at: Column) -> Column:
    return F.unix_micros(at) * 1000


def display_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def rfc3339(at: Column) -> Column:
    """UTC, with as many digits of the second's fraction as it has."""
    return F.concat(F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0*$", ""), F.lit("Z"))


_WORD = re.compile(r'(?:\\.|"[^"]*(?:"|$)|[^\\ "])+', re.S)
_PART = re.compile(r'\\(.)|"([^"]*)(?:"|$)|([^\\"])', re.S)


def shell_words(line: str) -> list[str]:
    """Words of a command line: double quotes group, a backslash outside them takes the next character as it is; empty words vanish."""
    words = ("".join(a or b or c for a, b, c in _PART.findall(w)) for w in _WORD.findall(line))
    return [w for w in words if w]
