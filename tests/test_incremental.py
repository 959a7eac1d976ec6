import pytest
from pyspark.sql import DataFrameWriter

from tidemark.operators.incremental import Feed, delivered_by, undelivered

LOG = "lsn long, op string, key string, ver long, ts long, run_id string"


def log(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], LOG)


ROWS = [(1, "PUT", "a", 1, 1), (2, " del", "a", 2, 2), (3, "PUT", "b", 1, 1), (3, "PUT", "b", 1, 1), (4, "NOP", "c", 1, 1), (5, "PUT", None, 1, 1), (None, "PUT", "n", 1, 1)]
MORE = [*ROWS, (6, "PUT", "a", 1, 1), (7, "PUT", "b", 1, 5), (8, "PUT", "d", None, 1)]


def out(feed, n=None):
    df = feed.output(n)
    return sorted(tuple(r) for r in df.collect()) if df is not None else []


def test_runs_take_what_is_new_once(spark):
    feed = Feed(spark)
    first = feed.run(log(spark, ROWS))
    assert (first["lower"], first["upper"], first["rows"]) == (None, 5, 4)
    second = feed.run(log(spark, MORE))
    assert (second["lower"], second["upper"]) == (5, 8) and out(feed, 2) == [("b", 1, 5)]
    assert feed.run(log(spark, MORE))["rows"] == 0
    assert out(feed) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 1, 5), ("n", 1, 1)]
    assert Feed(spark, feed.path).watermark() == 8


@pytest.mark.parametrize("broken", ["write", "commit"])
def test_failure_neither_skips_nor_repeats(spark, monkeypatch, broken):
    feed = Feed(spark)
    feed.run(log(spark, ROWS))
    with monkeypatch.context() as m:
        def fail(*a, **k):
            raise OSError("lost")

        m.setattr(*((DataFrameWriter, "parquet", fail) if broken == "write" else (feed, "_publish", fail)))
        with pytest.raises(OSError):
            feed.run(log(spark, MORE))
    assert feed.watermark() == 5 and len(out(feed)) == 4 and feed.clean() == []
    feed.run(log(spark, MORE))
    assert out(feed, 2) == [("b", 1, 5)] and len(out(feed)) == 5


def test_faster_run_wins(spark):
    a = Feed(spark)
    a.run(log(spark, ROWS))
    b = Feed(spark, a.path)
    seen = b.state()
    b.state = lambda: seen
    a.run(log(spark, MORE))
    with pytest.raises(RuntimeError):
        b.run(log(spark, MORE))
    assert len(out(a)) == 5


def test_upper_limit_is_fixed_at_the_start(spark):
    feed = Feed(spark)
    path = feed.path + "-log"
    log(spark, ROWS).write.parquet(path)
    source = spark.read.parquet(path)
    feed.run(source)
    log(spark, [(9, "PUT", "z", 1, 1)]).write.mode("append").parquet(path)
    assert feed.watermark() == 5
    assert feed.run(spark.read.parquet(path))["rows"] == 1


def test_delivered_by_successful_runs_only(spark):
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, None)], "run_id long, status string")
    items = spark.createDataFrame([(1, "a", 1, 1), (2, "a", 2, 2), (3, "b", 1, 1), (1, "b", None, 1), (1, "a", 1, 1), (None, "b", 1, 1)], "run_id long, key string, ver long, ts long")
    assert sorted(tuple(r) for r in undelivered(log(spark, ROWS), delivered_by(runs, items)).collect()) == [("a", 2, 2), ("b", 1, 1), ("n", 1, 1)]


def test_empty_log(spark):
    feed = Feed(spark)
    assert feed.run(log(spark, []))["rows"] == 0 and feed.output() is None and feed.watermark() is None


def test_run_that_dies_between_write_and_commit(spark, monkeypatch):
    """The process is gone before it can clean up; another session goes on from the same folder."""
    feed = Feed(spark)
    feed.run(log(spark, ROWS))
    with monkeypatch.context() as m:
        m.setattr(feed, "_publish", lambda commit: (_ for _ in ()).throw(KeyboardInterrupt()))
        m.setattr("tidemark.operators.incremental.remove", lambda *a: None)
        with pytest.raises(KeyboardInterrupt):
            feed.run(log(spark, MORE))
    session = spark.newSession()
    other = Feed(session, feed.path)
    assert other.watermark() == 5 and len(out(other)) == 4
    other.run(log(session, MORE))
    assert out(other, 2) == [("b", 1, 5)] and len(other.clean()) == 1 and len(out(other)) == 5


def test_adopted_deliveries_bound_what_is_compared(spark):
    runs = spark.createDataFrame([(1, "ok", 0, 9), (2, "failed", 9, 50)], "run_id long, status string, since_version long, upto_version long")
    items = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 9, 2), (2, "b", 50, 1), (1, None, 1, 1), (1, "b", None, 1)], "run_id long, key string, ver long, ts long")
    feed = Feed(spark)
    assert feed.adopt(runs, items)["rows"] == 2 and feed.watermark() is None
    with pytest.raises(RuntimeError):
        feed.adopt(runs, items)
    path = feed.path + "-log"
    log(spark, [(1, "PUT", "a", 1, 1), (2, "PUT", "a", 1, 7), (3, "PUT", "a", 9, 2), (4, "PUT", "b", 50, 1), (5, "PUT", "c", 10, 1)]).write.parquet(path)
    source = spark.read.parquet(path)
    plan = feed.fresh(source, feed.state()["outputs"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ver,9)" in plan and "LessThanOrEqual(ver,9)" in plan and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") == 1
    feed.run(source)
    assert out(feed, 2) == [("a", 1, 7), ("b", 50, 1), ("c", 10, 1)]


def test_compacted_output_tells_the_same(spark):
    feed, many = Feed(spark), [(i, "PUT", f"k{i % 5}", i * 40_000, 1) for i in range(40)]
    for n in (10, 20, 30):
        feed.run(log(spark, many[:n]))
    feed.BLOCKS = 3  # more blocks of late versions than are named one by one
    feed.compact()
    assert len(feed.state()["outputs"]) == 1 and len(feed.clean()) == 3
    last = feed.run(log(spark, many + [(50 + i, "PUT", f"k{i % 5}", i * 40_000, 1 + i % 2) for i in range(30)]))
    assert last["rows"] == 10 + 15 and len(out(feed)) == 55
