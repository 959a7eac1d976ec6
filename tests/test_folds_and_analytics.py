from pyspark.sql import functions as F

from tidemark.operators import analytics, folds, maintain, workload


def test_breaker_walk(spark):
    calls = [(1, 0.0, False), (2, 1.0, False), (3, 2.0, False), (4, 3.0, True), (5, 40.0, True), (6, 41.0, True), (7, 42.0, True), (8, 43.0, False)]
    df = spark.createDataFrame([("p", *c) for c in calls] + [("q", 1, 0.0, True), (None, 9, 0.0, True)], "peer string, seq long, t double, ok boolean")
    rows = folds.breaker_states(df, "peer", "t", "ok", "seq").filter("peer = 'p'").orderBy("seq").collect()
    assert [(r["allowed"], r["state"]) for r in rows] == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "half_open"), (True, "closed"), (True, "closed")]


def test_half_open_failure_opens_again():
    b = folds.Breaker(threshold=1, timeout=10, limit=2)
    assert [b.step(t, ok) for t, ok in [(0, False), (5, True), (11, True), (12, False), (13, True)]] == [(True, "open"), (False, "open"), (True, "half_open"), (True, "open"), (False, "open")]


def test_token_bucket(spark):
    df = spark.createDataFrame([("c", float(t), i) for i, t in enumerate([0, 0, 0, 0.5, 1.0, 1.0, 9.0, 9.0, 9.0])], "c string, t double, i int")
    assert [r["allowed"] for r in folds.rate_limits(df, "c", "t", "i", rate=1, burst=2).orderBy("i").collect()] == [True, True, False, False, True, False, True, True, False]


def test_ttl(spark):
    ops = spark.createDataFrame([("a", "add", 10, 0), ("a", "add", 100, 5), ("b", "add", 10, 0), ("b", "remove", None, 3), ("c", "add", 10, 0), (None, "add", 1, 0)], "key string, op string, ttl_ms long, ts_ms long")
    assert {tuple(r) for r in folds.expired(ops, F.lit(11)).collect()} == {("c", 10)}
    assert folds.expired(ops, F.lit(10)).count() == 0
    asked = folds.is_expired(ops, spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "key string"), F.lit(11))
    assert {tuple(r) for r in asked.collect()} == {("a", False), ("b", True), ("c", True), ("x", True)}


def test_hints_to_send_again(spark):
    hints = spark.createDataFrame([("a", "n", 0, 5), ("b", "n", 10, 5), ("c", "n", 0, 5), ("d", "n", 0, 1), ("a", "m", 9, 5)], "key string, target string, attempts int, created_at int")
    done = spark.createDataFrame([("c", "n"), ("c", "n"), (None, "n")], "key string, target string")
    assert {(r["key"], r["target"]) for r in folds.undelivered_hints(hints, done).collect()} == {("a", "n"), ("d", "n"), ("a", "m")}
    assert {r["key"] for r in folds.undelivered_hints(hints, done, oldest=F.lit(2)).collect()} == {"a"}


def test_adaptive_timeout(spark):
    rows = [("n", i, 100.0) for i in range(10)] + [("few", 1, 9.0), ("slow", 1, 9e4), ("slow", 2, 9e4), ("slow", 3, 9e4)] + [("quick", i, 1.0) for i in range(5)]
    got = dict(map(tuple, analytics.adaptive_timeout(spark.createDataFrame(rows, "n string, i long, ms double"), "n", "i", "ms").collect()))
    assert got == {"n": 200, "few": 500, "slow": 5000, "quick": 50}


def test_quantile_of_buckets(spark):
    rows = [("a", .1, 2), ("a", .5, 6), ("a", float("inf"), 8), ("none", .1, 0), ("none", float("inf"), 0)]
    h = spark.createDataFrame(rows, "g string, le double, n long")
    got = dict(map(tuple, analytics.histogram_quantile(h, ["g"], .5).collect()))
    assert abs(got["a"] - .3) < 1e-12 and got["none"] is None
    assert dict(map(tuple, analytics.histogram_quantile(h, ["g"], .99).collect()))["a"] == .5


def test_alert_needs_an_unbroken_hold(spark):
    bad = [0, 1, 1, 1, 0, 1, 1, 1, 1]
    df = spark.createDataFrame([("s", i * 10, b) for i, b in enumerate(bad)], "s string, t long, b int")
    rows = analytics.alert_hold(df, ["s"], "t", F.col("b") == 1, 20).orderBy("t").collect()
    assert [r["firing"] for r in rows] == [False, False, False, True, False, False, False, True, True]


def test_plans_and_overflow(spark):
    runs = spark.createDataFrame([(0,)] * 4 + [(1,)] * 8 + [(3,)] * 99, "level int")
    assert [r["level"] for r in maintain.level_plan(runs).orderBy("level").collect()] == [0, 1]
    sized = spark.createDataFrame([(1 << 10,)] * 3 + [(1 << 21,)] * 4 + [(1 << 31,)] * 9, "bytes long")
    assert tuple(maintain.tier_plan(sized).first()) == (1, 4, 4 << 21) and maintain.tier_plan(sized.limit(0)).count() == 0
    left = maintain.drop_oldest(spark.range(100), [F.col("id")], 100)
    assert left.count() == 90 and left.agg(F.min("id")).first()[0] == 10 and maintain.drop_oldest(spark.range(99), [F.col("id")], 100).count() == 99


def test_tombstones_expire(spark):
    day = 24 * 3600 * 10**9
    rows = [("key1", 1, 0, "DEL"), ("key2", 1, 2 * day, "DEL"), ("key3", 1, 0, "PUT"), ("key4", 1, day, "DEL")]
    df = spark.createDataFrame([(*r, None) for r in rows], "key string, ver long, ts long, op string, value string")
    assert {r["key"] for r in maintain.dedup_ttl(df, 2 * day).collect()} == {"key2", "key3", "key4"}


def test_workload_shares(spark):
    for name, (mix, _) in workload.CLI_MIXES.items():
        got = dict(map(tuple, workload.operations(spark, name, 20_000, 500, mixes=workload.CLI_MIXES).groupBy("op").count().collect()))
        assert set(got) == set(mix) and all(abs(got[o] / 200 - share) < 2 for o, share in mix.items())
    a = workload.operations(spark, "A", 1000, 50).repartition(7).orderBy("seq").collect()
    assert a == workload.operations(spark, "A", 1000, 50).orderBy("seq").collect()


def test_zipf_falls_off(spark):
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    got = dict(map(tuple, spark.range(50_000).select(workload.zipfian(u, 1000).alias("r")).groupBy("r").count().collect()))
    assert min(got) == 0 and max(got) <= 999
    z = workload.zeta(1000)
    assert abs(got[0] / 50_000 - 1 / z) < .01 and abs(got[1] / 50_000 - 2**-.99 / z) < .01
    assert abs(workload.zeta(300_000) - sum(i**-.99 for i in range(1, 300_001))) < 1e-9
