import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.operators.skew import (
    blocked_lag, compress, distributed_rank, floor_rank, heavy_keys, key_counts, key_profile, nearest_rank, salted_join, scaled_rank, weighted_percentiles)


def skewed(n=2000, seed=5):
    random.seed(seed)
    key = lambda: "hot" if random.random() < 0.4 else random.choice(["a", "b", "c", None, "", "d"])
    return [(key(), random.choice([None, *range(40)]) if random.random() < 0.9 else random.randrange(5000), "clash") for _ in range(n)]


def test_profile_and_counts(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "key string, v int, weight string")
    got = {r["key"]: r for r in key_profile(compress(df, ["key"], "v"), ["key"], "v").collect()}
    by = defaultdict(list)
    for k, v, _ in rows:
        by[k].append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        c = Counter(v for v in vs if v is not None)
        top = max(c.values())
        assert (got[k]["n"], got[k]["n_distinct"], got[k]["mode"], got[k]["mode_n"]) == (len(vs), len(c), min(v for v in c if c[v] == top), top)
    assert {r["key"]: r["n"] for r in key_counts(compress(df, ["key"], "v"), ["key"]).collect()} == {k: len(v) for k, v in by.items()}


def test_percentiles_by_three_ranks(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "key string, v int, x string")
    by = defaultdict(list)
    for k, v, _ in rows:
        if v is not None:
            by[k].append(v)
    import math

    index = {nearest_rank: lambda n, p: max(math.ceil(n * p), 1) - 1, scaled_rank: lambda n, p: min(int(n * p), n - 1), floor_rank: lambda n, p: int((n - 1) * p)}
    for rank, at in index.items():
        got = {r["key"]: (r["a"], r["b"]) for r in weighted_percentiles(compress(df, ["key"], "v"), ["key"], "v", {"a": 0.5, "b": 0.99}, F.floor(F.col("v") / 8), rank=rank).collect()}
        assert got == {k: tuple(sorted(v)[at(len(v), p)] for p in (0.5, 0.99)) for k, v in by.items()}


def test_percentile_conventions_of_small_series(spark):
    df = spark.range(1, 11).select(F.lit("k").alias("key"), F.col("id").alias("v"))
    one = lambda rank: weighted_percentiles(compress(df, ["key"], "v"), ["key"], "v", {"p50": 0.5, "p99": 0.99}, rank=rank).first()[1:]
    assert (one(nearest_rank), one(scaled_rank), one(floor_rank)) == ((5, 10), (6, 10), (5, 9))
    assert weighted_percentiles(compress(df.limit(0), ["key"], "v"), ["key"], "v", {"p50": 0.5}).count() == 0


def test_heavy_keys_are_exact(spark):
    rows = [("t", "a")] * 2 + [("t", "b")] * 3 + [("t", None)] * 90 + [("t", "")] * 5 + [("u", "a")]
    df = spark.createDataFrame([(*r, "v") for r in rows], "tbl string, key string, v string")
    c = compress(df, ["tbl", "key"], "v")
    assert {tuple(r) for r in heavy_keys(c, "tbl", "key", 3).collect()} == {("t", "b", 3), ("u", "a", 1)}
    assert heavy_keys(compress(df.limit(0), ["tbl", "key"], "v"), "tbl", "key", 3).count() == 0


def test_distributed_rank_is_a_permutation(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("g"), "id")
    rows = distributed_rank(df, ["g"], [F.col("id")], "r", blocks=7).collect()
    for g in "012":
        assert sorted(r["r"] for r in rows if r["g"] == g) == list(range(1, len([r for r in rows if r["g"] == g]) + 1))


def test_salted_join_with_hot_key(spark):
    many = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    one = many.select("k").filter("k is not null").distinct().filter("k = 'hot' or cast(k as bigint) % 2 = 0").withColumn("v", F.lit(1))
    plain = many.join(one, "k", "left").groupBy("v").count().collect()
    assert sorted(map(str, salted_join(many, one, "k", how="left").groupBy("v").count().collect())) == sorted(map(str, plain))
    assert salted_join(many, one, "k").count() == many.join(one, "k").count()


def test_blocked_lag_equals_lag(spark):
    random.seed(2)
    rows = [(random.choice("ab"), t, random.randrange(100)) for t in random.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "s string, t int, v int")
    got = {(r["s"], r["t"]): r["p"] for r in blocked_lag(df, ["s"], "t", "v", F.floor(F.col("t") / 37), "p").collect()}
    want = {}
    for s in "ab":
        before = None
        for _, t, v in sorted(r for r in rows if r[0] == s):
            want[s, t] = before
            before = v
    assert got == want


def test_spread_join_with_a_hot_key_on_both_sides(spark):
    from tidemark.operators.skew import hot_keys, spread_join

    many = spark.range(3000).selectExpr("case when id % 3 = 0 then binary('hot') when id % 7 = 0 then null else binary(cast(id as string)) end as k", "id as x")
    few = spark.createDataFrame([(bytearray(b"hot"), i) for i in range(5)] + [(bytearray(b"1"), 9), (bytearray(b"2"), 9), (None, 9)], "k binary, y int")
    assert len(hot_keys(many, "k")) == 1
    got = spread_join(many, few, "k", ["x"])
    assert got.count() == many.join(few, "k").count() == 5002 and got.exceptAll(many.join(few, "k")).count() == 0 and got.columns == ["k", "x", "y"]
    assert spread_join(many.limit(0), few, "k", ["x"]).count() == 0
