import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar, vclock
from tidemark.functions.scalar import fnv64, mixed
from tidemark.operators import bloom, merkle, replicas, ring

THREE = ("node-1", "node-2", "node-3")


def keys(spark, names, **columns):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_ring_layout():
    r = ring.Ring(THREE)
    at = [p for p, _, _ in r.positions]
    assert len(at) == 450 and (at[0], at[-1]) == (2382292, 4294406710) and r.positions[0][1] == "node-1"
    assert r.add("node-1") is r and r.remove("node-3").add("node-3") == r and ring.Ring(()).positions == ()


@pytest.mark.parametrize("key,crc,nodes", [("user:1", 2074460802, "321"), ("user:1001", 3899860853, "231"), ("hello", 907060870, "312"), ("key-0", 2045480940, "231"), ("usertable:user0000000000", 349981208, "231")])
def test_preference_lists(spark, key, crc, nodes):
    row = ring.place(keys(spark, [key]).withColumn("crc", scalar.ring_hash(F.col("key"))), "key", ring.Ring(THREE)).first()
    assert row["crc"] == crc == zlib.crc32(key.encode()) and row["replicas"] == [f"node-{n}" for n in nodes]


def test_shares_and_movement(spark):
    k = spark.range(10_000).select(F.format_string("key-%d", "id").alias("key"))
    four = ring.Ring((*THREE, "node-4"))
    assert {r["node"]: r["n"] for r in ring.shares(k, "key", four).collect()} == {"node-1": 2313, "node-2": 2625, "node-3": 2573, "node-4": 2489}
    moved = ring.movement(k, "key", four, four.add("node-5"))
    assert moved.agg(F.sum("n")).first()[0] == 2043 and moved.filter("new_node <> 'node-5'").count() == 0


def test_null_keys_and_empty_ring(spark):
    rows = ring.place(spark.createDataFrame([(None,), ("",)], "key string"), "key", ring.Ring(THREE), 9).orderBy("key").collect()
    assert rows[0]["replicas"] is None and sorted(rows[1]["replicas"]) == list(THREE)
    assert ring.place(keys(spark, ["a"]), "key", ring.Ring(())).first()["replicas"] is None


def test_sloppy_quorum_and_hints(spark):
    r = ring.Ring(("n1", "n2", "n3", "n4"))
    df = spark.createDataFrame([(["n3", "n2", "n1"],)], "p array<string>")
    chosen = ring.sloppy(F.col("p"), ["n1", "n4"], 3, r)
    row = df.select(chosen.alias("c"), ring.hint_targets(F.col("p"), chosen).alias("h")).first()
    assert row["c"] == ["n1", "n4"] and [tuple(x) for x in row["h"]] == [("n4", "n3")]


ROOTS = {0: merkle.EMPTY_ROOT, 3: "4783238018f07febdd6c1dd0f7c990c4924c6aee2bb16c44f77a30b82f0327ee", 5: "2973cea2ef2b50fc634fbb24565bd8f18f0bbd92729d5d863397bcdcbb760181", 8: "05fe8068ce8b1ec18b9b7a4cd4c0392fe281ca11a95bab5e179afe7739d71b43"}


@pytest.mark.parametrize("n", list(ROOTS))
def test_merkle_roots(spark, n):
    df = spark.createDataFrame([(c, "val-" + c) for c in "abcdefgh"[:n]], "key string, value string")
    assert merkle.root(df).first()[0] == ROOTS[n]


def test_merkle_of_a_thousand_keys_and_a_change(spark):
    df = spark.range(1000).select(F.format_string("key:%04d", "id").alias("key")).withColumn("value", F.concat(F.lit("value-for-"), "key"))
    assert merkle.root(df).first()[0] == "391b39d6a2e94cdebf586ea92f9286e97b0c25e7fa9d396a8d615601cb320c83"
    other = df.withColumn("value", F.when(F.col("key") == "key:0500", "x").otherwise(F.col("value")))
    assert merkle.root(other).first()[0] != merkle.root(df).first()[0]
    assert [r[0] for r in merkle.diff_keys(df, other).collect()] == ["key:0500"]


def test_bucket_root_against_plain_fold(spark):
    names = [f"key{i}" for i in range(3000)]
    buckets = {}
    for k in sorted(names):
        d = hashlib.sha256(k.encode()).digest()
        b = sum(x * (i + 1) for i, x in enumerate(d)) % 1024
        buckets[b] = hashlib.sha256(buckets[b] + d).digest() if b in buckets else d
    root = b""
    for b in sorted(buckets):
        root = hashlib.sha256(root + buckets[b]).digest()
    assert merkle.bucket_root(spark, merkle.bucket_roots(keys(spark, names))).first()[0] == root.hex()


@pytest.mark.parametrize("n,p,want", [(1000, .01, (9586, 7)), (100, .01, (959, 7)), (10, .01, (96, 7)), (10000, .005, (110278, 8)), (1000, .1, (4793, 3)), (0, 5.0, (9586, 7))])
def test_bloom_sizes(spark, n, p, want):
    assert bloom.bloom_size(n, p) == want
    m, k = bloom.bloom_size_columns(F.lit(n), F.lit(p))
    assert tuple(spark.range(1).select(m, k).first()) == want


def test_store_bloom_format():
    keys = [b"", b"a", b"user:1"]
    assert [(int(a), int(b)) for a, b in zip(fnv64(keys), mixed(fnv64(keys)))] == [(14695981039346656037, 9305973794379344174), (12638187200555641996, 6265779713777537738), (17869608953374579947, 11610605916227649556)]
    m, k = bloom.bloom_size(1000, .01)
    made = bloom.StoredFilter.of([b"key-%d" % i for i in range(1000)], m, k)
    assert made.bits.sum() == 4961 and len(fnv64([])) == 0
    read = bloom.StoredFilter.read(made.dump())
    assert read.may_hold([b"no-%d" % i for i in range(10_000)]).sum() == 105 and read.may_hold([b"key-%d" % i for i in range(1000)]).all()
    for blob in (struct.pack("<QI", 9, 0) + bytes(8), struct.pack("<QI", 9, 101) + bytes(8), struct.pack("<QI", 9, 3)):
        with pytest.raises(ValueError):
            bloom.StoredFilter.read(blob)


def test_bloom_shards(spark):
    have = spark.range(3000).select(F.format_string("k%d", "id").alias("key"))
    shards, n, m, k = bloom.build_shards(have.union(have).union(spark.createDataFrame([(None,)], "key string")), "key", shard_keys=500)
    assert n == 3 and bloom.might_contain(have, "key", shards, n, m, k).count() == 3000
    other = spark.range(5000).select(F.format_string("x%d", "id").alias("key"))
    assert bloom.might_contain(other, "key", shards, n, m, k).count() < 150


def test_hash_functions(spark):
    rows = spark.createDataFrame([("",), ("a",), ("é",)], "k string").select(scalar.fnv1a_32(F.col("k")), scalar.fnv1a_64(F.col("k")), scalar.byte_sum(F.col("k"))).collect()
    assert [r[0] for r in rows[:2]] == [2166136261, 3826002220] and rows[1][1] == "12638187200555641996" and rows[2][2] == 0xC3 + 2 * 0xA9
    got = spark.createDataFrame([(i,) for i in (0, 1, 2, 42)], "i long").select(scalar.scramble("i")).collect()
    assert [r[0] for r in got] == [2938590176187398597, 706274769219809188, 7403220990122577415, 9167883444029086447]


@pytest.mark.parametrize("a,b,want", [({"a": 1}, {"a": 2}, "BEFORE"), ({"a": 2}, {"a": 1}, "AFTER"), ({"a": 1}, {"b": 1}, "CONCURRENT"), ({"a": 1}, {"a": 1, "b": 0}, "EQUAL"), ({}, {}, "EQUAL"), ({}, {"a": 1}, "BEFORE"), (None, {}, "EQUAL")])
def test_clock_order(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a map<string,bigint>, b map<string,bigint>")
    row = df.select(vclock.compare(F.col("a"), F.col("b")), vclock.compare_nullable(F.col("a"), F.col("b")), vclock.text(vclock.merge(F.col("a"), F.col("b"))), vclock.text(vclock.increment(F.col("a"), F.lit("z")))).first()
    assert row[0] == want and row[1] == ("BEFORE" if a is None else want)
    both = {k: max((a or {}).get(k, 0), b.get(k, 0)) for k in {**(a or {}), **b}}
    assert row[2] == ",".join(f"{k}={v}" for k, v in sorted(both.items())) and "z=1" in row[3]


def test_siblings_are_the_maximal_clocks(spark):
    import random

    random.seed(1)
    rows = [(random.choice("kl"), {n: random.randrange(1, 6) for n in "abc" if random.random() < .7} or None) for _ in range(120)]
    got = {tuple(r) for r in replicas.siblings(spark.createDataFrame(rows, "key string, vc map<string,bigint>")).collect()}
    text = lambda c: ",".join(f"{k}={v}" for k, v in sorted((c or {}).items()))
    below = lambda x, y: all(v <= (y or {}).get(k, 0) for k, v in (x or {}).items()) and text(x) != text(y)
    assert got == {(k, text(c)) for k, c in rows if not any(below(c, o) for q, o in rows if q == k)}


def test_majority_repair(spark):
    e = spark.createDataFrame([("k", "v2"), ("k", "v1"), ("k", "v2"), ("tie", "b"), ("tie", "a"), ("empty", ""), ("empty", ""), ("empty", "x"), ("null", None)], "key string, v string")
    got = {r["key"]: (r["winner"], r["repairs"]) for r in replicas.majority_repair(e, F.col("v")).collect()}
    assert got == {"k": ("v2", 1), "tie": ("a", 1), "empty": ("", 0), "null": (None, 0)}
