import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import problems, quotient, seen
from tidemark.llm.seen import SeenFilter, answered, error_report, fingerprints

LOG = "lsn long, key string, extra string"
ASK = "pos long, key string, log_end long, shard string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**14 - 1), st.integers(-5, 10**12)), max_size=300), st.lists(st.tuples(st.integers(0, 2**14 - 1), st.integers(0, 50)), max_size=60), st.integers(1, 13))
def test_filter_round_trip_merge_and_lookup(a, b, r):
    def made(rows):
        p, f = quotient.least_per_fingerprint(np.array([x for x, _ in rows], np.uint64), np.array([y for _, y in rows], np.int64))
        return quotient.encode(p, f, 14 - r, r), dict(zip(p.tolist(), f.tolist()))

    (blob, want), (other, more) = made(a), made(b)
    slots = quotient.Slots.open(blob)
    p, f = slots.sorted()
    assert dict(zip(p.tolist(), f.tolist())) == want and (slots.quotient_bits, slots.remainder_bits) == (14 - r, r) and (np.diff(p.astype(np.int64)) > 0).all()
    merged = {k: min(want.get(k, 1 << 60), more.get(k, 1 << 60)) for k in want | more}
    p, f = quotient.Slots.open(quotient.merge(blob, other)).sorted()
    assert dict(zip(p.tolist(), f.tolist())) == merged
    hit, first = quotient.lookup(blob, np.arange(2**14, dtype=np.uint64))
    assert set(np.flatnonzero(hit).tolist()) == set(want) and all(first[k] == v for k, v in want.items())


def rows(n=3000):
    log = [(i, "hot" if i % 3 == 0 else f"k{i % 700}", "x") for i in range(n)] + [(5, None, "x"), (6, "", "x"), (7, "k1", "x"), (None, "nowhere", "x")]
    ask = [(i, "hot" if i % 3 else f"k{i}", (i * 7) % n - 1, "s") for i in range(1200)] + [(2000, None, 9, "s"), (2001, "", 9, "s"), (2002, "k1", None, "s"), (3, "k3", 20, "s"), (2003, "K1", n, "s"), (2004, "nowhere", n, "s")]
    return log, ask + ask[:40]


def truth(log, ask):
    first = {}
    for lsn, key, _ in log:
        if key and lsn is not None:
            first[key] = min(first.get(key, lsn), lsn)
    return {pos for pos, key, end, _ in ask if key in first and end is not None and first[key] <= end}


def test_answers_are_right_after_the_check(spark):
    log, ask = rows()
    for bits, segment in ((2, None), (2, "extra"), (13, "extra")):
        got = answered(spark.createDataFrame(ask, ASK), spark.createDataFrame(log, LOG), "pos", "key", "log_end", "lsn", segment, bits).collect()
        assert len(got) == len({r["pos"] for r in got})
        assert {r["pos"] for r in got if r["seen"]} == truth(log, ask)


def test_measured_errors_fit_the_derived_rate(spark):
    log = spark.range(20_000).select("id", F.concat(F.lit("w"), "id").alias("key"))
    ask = spark.range(40_000).select(F.col("id").alias("pos"), F.concat(F.lit("n"), "id").alias("key"), F.lit(1 << 40).alias("end"))
    r = error_report(ask, log, "pos", "key", "end", "id", remainder_bits=6).first()
    assert r["requests"] == 40_000 and r["wrong"] == r["positives"] and r["stored"] <= 20_000
    assert abs(r["measured_rate"] - r["expected_rate"]) < 0.3 * r["expected_rate"]
    assert r["bits_per_key"] < 6 + 3 + 40


def test_shards_and_merge_hold_every_key(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("pos"), F.concat(F.lit("s"), F.col("id") % 3).alias("seg"))
    build = lambda df: SeenFilter.build(fingerprints(df, "key", "pos", "seg"), 3, 10, 12)
    whole = build(keys.filter("pos % 2 = 0")).merge(build(keys.filter("pos % 2 = 1")))
    assert whole.shards.count() == 8
    assert whole.shards.agg(F.sum("entries")).first()[0] <= 5000
    asked = keys.select(F.xxhash64("key").alias("h"), "pos")
    got = whole.probe(asked.select("h")).join(asked, "h").collect()
    assert len(got) == 5000 and all(r["first_pos"] <= r["pos"] for r in got)


def test_shards_follow_the_larger_side():
    assert SeenFilter.widths(10, 1 << 20)[0] == SeenFilter.widths(1 << 20, 10)[0] == 6
    assert SeenFilter.widths(0)[0] == 0


def test_clashing_names(spark):
    log = spark.createDataFrame([(1, "a", 0, 0), (2, "b", 0, 0)], "lsn long, key string, h long, shard long")
    ask = spark.createDataFrame([(1, "a", 1, 0, 0), (2, "b", 1, 0, 0)], "pos long, key string, log_end long, h long, fp long")
    got = answered(ask, log, "pos", "key", "log_end", "lsn").filter("seen").collect()
    assert [r["pos"] for r in got] == [1]


def test_empty_tables(spark):
    log, ask = rows(10)
    none_log, none_ask = spark.createDataFrame([], LOG), spark.createDataFrame([], ASK)
    assert answered(spark.createDataFrame(ask, ASK), none_log, "pos", "key", "log_end", "lsn").count() == 0
    assert answered(none_ask, spark.createDataFrame(log, LOG), "pos", "key", "log_end", "lsn").count() == 0
    assert error_report(none_ask, none_log, "pos", "key", "log_end", "lsn").first()["measured_rate"] == 0


def test_errors_are_those_of_the_filter_that_answers(spark, tmp_path, monkeypatch):
    log, ask = rows(300)
    spark.createDataFrame(log, LOG).withColumnRenamed("extra", "node").write.parquet(str(tmp_path / "wal_record.parquet"))
    spark.createDataFrame(ask, ASK).write.parquet(str(tmp_path / "kv_request.parquet"))
    widths, build = [], SeenFilter.build.__func__
    monkeypatch.setattr(seen.SeenFilter, "build", classmethod(lambda cls, *a, **kw: widths.append((built := build(cls, *a, **kw)).remainder_bits) or built))
    problems.p4_found(spark, str(tmp_path))
    answering = set(widths)
    widths.clear()
    problems.p4_errors(spark, str(tmp_path))
    assert set(widths) == answering and len(answering) == 1
