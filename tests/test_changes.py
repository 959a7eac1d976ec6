import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import runs_merge
from tidemark.operators.changes import MergeTable, changes, newest, replay
from tidemark.session import names_in

SCHEMA = "lsn long, op string, key string, value string, ver long, ts long"


def log_rows(n=400, seed=1):
    random.seed(seed)
    rows = []
    for i in range(n):
        key = "hot" if random.random() < 0.4 else random.choice(["a", "b", "c d", "é", "A"])
        ver = random.randrange(60)
        ts = random.randrange(5)
        op = ["PUT", " put", "Del\t", "PUT "][hash((key, ver, ts)) % 4]
        rows.append((i, op, key, f"{key}{ver}{ts}", ver, ts))
    dirt = [(None, "PUT", None, "x", 99, 9), (1, "PUT", "", "x", 99, 9), (2, "PUTX", "a", "x", 99, 9), (3, None, "a", "x", 99, 9), (4, "DEL", "a", None, None, 9), (5, "PUT", "a", None, 99, None), (6, "PUT\n", "a", "x", 99, 9)]
    return rows + dirt + rows[:50]


def state(rows):
    best = {}
    for _, op, key, _, ver, ts in rows:
        op = (op or "").strip(" \t").upper()
        if key and ver is not None and ts is not None and op in ("PUT", "DEL"):
            best[key] = max(best.get(key, (-1,)), (ver, ts, op))
    return {k: v[:2] for k, v in best.items() if v[2] == "PUT"}


def read(table):
    return {r["key"]: (r["ver"], r["ts"]) for r in table.read().collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_state_of_any_order_of_appends(spark, seed):
    rows = log_rows(seed=seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert read(replay(df, "lsn", runs=3)) == state(rows)
    table = MergeTable(spark, carry=["value"], threshold=2)
    parts = [rows[i::4] for i in range(4)]
    random.shuffle(parts)
    for part in [*parts, parts[0]]:
        table.append(changes(spark.createDataFrame(part, SCHEMA), ["value"]))
    assert len(table.runs) < 5 and table.rewritten and read(table) == state(rows)
    assert all(r["value"] == f"{r['key']}{r['ver']}{r['ts']}" for r in table.read().collect())
    table.compact()
    assert len(table.runs) == 1 and read(table) == state(rows)
    # another session's view of the same folder
    assert read(MergeTable(spark, table.path)) == state(rows)


@pytest.mark.parametrize("policy,threshold", [("leveled", 2), ("leveled", 4), ("tiered", 4), (None, 4)])
def test_policies_keep_the_state_and_bound_what_is_written_again(spark, policy, threshold):
    table = MergeTable(spark, buckets=2, policy=policy, threshold=threshold)
    want = {}
    for i in range(24):
        table.append(spark.createDataFrame([(f"k{i % 7}", i, 0, "PUT"), (f"k{(i + 1) % 5}", i, 1, "DEL" if i % 3 else "PUT")], "key string, ver long, ts long, op string"))
        for key, ver, ts, op in ((f"k{i % 7}", i, 0, "PUT"), (f"k{(i + 1) % 5}", i, 1, "DEL" if i % 3 else "PUT")):
            want[key] = max(want.get(key, (-1,)), (ver, ts, op))
    assert read(table) == {k: v[:2] for k, v in want.items() if v[2] == "PUT"}
    levels = [r["level"] for r in table.runs]
    if policy == "leveled":
        assert all(levels.count(n) < int(threshold * 2**n) for n in range(max(levels) + 1)) and table.rewritten <= 2 * 24
    assert table.rewritten == 0 if policy is None else table.rewritten < 2 * 24


def test_frames_built_before_a_compaction_still_read(spark):
    table = MergeTable(spark, policy=None, keep=2)
    add = lambda *r: table.append(spark.createDataFrame([r], "key string, ver long, ts long, op string"))
    add("a", 1, 1, "PUT")
    add("b", 1, 1, "PUT")
    before = table.read()
    table.compact()
    add("a", 2, 2, "DEL")
    assert {r["key"] for r in before.collect()} == {"a", "b"} and set(read(table)) == {"b"}
    add("c", 2, 2, "PUT")
    assert len(names_in(spark, table.path)) == 1 + len(table.runs)  # the old runs are gone by now


def test_large_buckets_are_read_by_ranges_of_keys(spark):
    rows = spark.range(30_000).select(F.format_string("k%06d", "id").alias("key"), F.col("id").alias("ver"), F.lit(0).cast("long").alias("ts"), F.when(F.col("id") % 10 == 0, "DEL").otherwise("PUT").alias("op"), F.sha2(F.col("id").cast("string"), 256).alias("value"))
    table = MergeTable(spark, buckets=1, carry=["value"], policy=None, bucket_bytes=100_000)
    table.append(rows)
    table.append(rows.filter("ver % 3 = 0").withColumn("ver", F.col("ver") + 100_000))
    assert table.merged().rdd.getNumPartitions() > 3
    got = table.read([])
    assert got.count() == 27_000 and got.filter("ver >= 100000").count() == 9000
    assert [r["key"] for r in table.read([], low="k000100", high="k000105").collect()] == ["k000101", "k000102", "k000103", "k000104"]


def test_streams_merge_block_by_block():
    rng = random.Random(7)
    streams, want = [], {}
    for s in range(5):
        keys = sorted(rng.sample(range(3000), rng.randrange(0, 900)))
        rows = [(f"{k:05d}", rng.randrange(4), None if rng.random() < 0.2 else s) for k in keys]
        for k, v, x in rows:
            want[k] = max(want.get(k, (-1, -1)), (v, -1 if x is None else x))
        t = pa.table({"key": [r[0] for r in rows], "v": pa.array([r[1] for r in rows], pa.int64()), "x": pa.array([r[2] for r in rows], pa.int64())}) if rows else None
        cuts = [0, *sorted(rng.sample(range(1, len(rows)), min(9, len(rows) - 1))), len(rows)] if len(rows) > 1 else [0, len(rows)]
        streams.append(iter([] if t is None else [t.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]))
    got = pa.concat_tables(list(runs_merge.merge_streams(streams, ["v", "x"]))).to_pylist()
    assert [r["key"] for r in got] == sorted(want) and all((r["v"], -1 if r["x"] is None else r["x"]) == want[r["key"]] for r in got)


def test_late_change_stays_behind_a_compacted_tombstone(spark):
    table = MergeTable(spark)
    add = lambda *r: table.append(spark.createDataFrame([r], "key string, ver long, ts long, op string"))
    add("k", 5, 1, "DEL")
    table.compact()
    add("k", 4, 9, "PUT")
    assert read(table) == {}
    table.compact(drop_before=100)
    assert table.merged().count() == 0


def test_merge_reads_without_shuffle_or_sort(spark):
    table = replay(spark.createDataFrame(log_rows(), SCHEMA), "lsn", runs=3)
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and len(table.runs) == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark")]


def test_empty_log(spark):
    assert replay(spark.createDataFrame([], SCHEMA), "lsn").read().count() == 0
    with pytest.raises(ValueError):
        MergeTable(spark).read()


def test_unnamed_runs_are_invisible(spark):
    table = MergeTable(spark)
    table.append(spark.createDataFrame([("k", 1, 1, "PUT")], "key string, ver long, ts long, op string"))
    table._write(newest(spark.createDataFrame([("z", 1, 1, "PUT")], "key string, ver long, ts long, op string"), "key", ["ver", "ts"], ["op"]), 0)
    assert read(MergeTable(spark, table.path)) == {"k": (1, 1)}


def test_second_writer_is_refused(spark):
    table = MergeTable(spark)
    row = spark.createDataFrame([("k", 1, 1, "PUT")], "key string, ver long, ts long, op string")
    other = MergeTable(spark, table.path)
    table.append(row)
    with pytest.raises(RuntimeError):
        other.append(row)


def test_newest_takes_null_as_lowest(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 0, 2), ("b", None, 3)], "k string, v int, x int")
    assert {tuple(r) for r in newest(df, "k", ["v"], ["x"]).collect()} == {("a", 0, 2), ("b", None, 3)}
    assert changes(spark.createDataFrame(log_rows(), SCHEMA)).select(F.count_distinct("op")).first()[0] == 2


def test_empty_run_between_others(spark):
    table = MergeTable(spark)
    schema = "key string, ver long, ts long, op string"
    for rows in ([("k", 1, 1, "PUT"), ("j", 1, 1, "PUT")], [], [("k", 2, 1, "DEL")], []):
        table.append(spark.createDataFrame(rows, schema))
    assert read(table) == {"j": (1, 1)}
