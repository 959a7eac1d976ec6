import json
import struct

import zstandard
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.scalar import format_bytes, glob_to_like, host_of, key_of_path, quorum_status, shell_words, truncate_text
from tidemark.operators import maintain, snapshot
from tidemark.operators.changes import MergeTable
from tidemark.operators.ring import Ring, fan_out, place
from tidemark.plans import store
from tidemark.sources import store_files
from tidemark.streaming import state

RECORDS = [("PUT", "a", b"x", 1, 10, {"n": 1}), ("DEL", "é", b"", 2, 20, None), ("PUT", "", b"\x00\xff", 1 << 62, 30, {})]


def test_log_with_corrupt_stretches(spark, tmp_path):
    good = [store_files.encode_record(*r) for r in RECORDS]
    (tmp_path / "a.log").write_bytes(good[0] + b"\xff\xfe garbage \x07" + good[1] + good[2] + b"tail" + good[0][:-3])
    (tmp_path / "b.log").write_bytes(b'{"op":"PUT","key":"k","value":"eA==","ver":7,"ts":8}\nnot json\n{"op":"DEL","key":"k","ver":9,"ts":9}\n{"op":"PUT"}\n')
    (tmp_path / "c.log").write_bytes(b"")
    rows = store_files.read_log(spark, str(tmp_path)).collect()
    got = [(r["op"], r["key"], bytes(r["value"]), r["ver"], r["ts"], r["vc"]) for r in rows]
    assert sorted(g[:5] for g in got if not g[1] == "k") == sorted(r[:5] for r in RECORDS)
    assert sorted(g[:5] for g in got if g[1] == "k") == [("DEL", "k", b"", 9, 9), ("PUT", "k", b"x", 7, 8)]
    assert [g[5] for g in got if g[1] == "a"] == [{"n": 1}]
    lines = spark.createDataFrame([('{"op":"DEL","key":"k","ver":9}',), ("broken",), (None,)], "value string")
    assert [tuple(r) for r in store_files.read_legacy_log(lines).collect()] == [("DEL", "k", None, 9, 0)]


def test_run_files(spark, tmp_path):
    def row(key, value, ver, ts, dead, vc):
        clock = struct.pack("<I", len(vc)) + b"".join(struct.pack("<H", len(k)) + k.encode() + struct.pack("<Q", v) for k, v in vc.items()) if vc else b""
        return bytes([0xBF]) + struct.pack("<I", len(key)) + key.encode() + struct.pack("<I", len(value)) + value + struct.pack("<QqBI", ver, ts, dead, len(clock)) + clock

    data, index = b"", []
    for key, value, packed in (("a", b"v" * 500, True), ("b", b"w", False), ("c", b"lost", False)):
        body = row(key, value, 3, 4, key == "b", {"n1": 5} if key == "a" else None)
        body = b"\x00" + body[1:] if key == "c" else body
        body = zstandard.ZstdCompressor().compress(body) if packed else body
        index.append({"k": key, "o": len(data), "s": len(body) + 4, "c": packed, "b": True})
        data += struct.pack("<I", len(body)) + body
    text = json.dumps(index).encode()
    (tmp_path / "L2_170.sst").write_bytes(data + text + struct.pack("<4Q", len(data), len(text), len(data) + len(text), 0))
    (tmp_path / "L0_9.sst").write_bytes(b"short")
    rows = sorted(store_files.read_runs(spark, str(tmp_path)).collect(), key=lambda r: r["key"])
    assert [(r["level"], r["run_id"], r["key"], len(r["value"]), r["version"], r["ts_ns"], r["tombstone"], r["vc"]) for r in rows] == [(2, 170, "a", 500, 3, 4, False, {"n1": 5}), (2, 170, "b", 1, 3, 4, True, None)]
    assert [(r["level"], r["run_id"]) for r in store_files.list_runs(spark, str(tmp_path)).collect()] == [(2, 170), (0, 9)]


def test_json_and_metrics(spark):
    live = spark.createDataFrame([(f"k{i:03}", f"v\"{i}") for i in range(100)], "key string, value string")
    texts = store_files.export_json(live, 13)
    back = store_files.import_json(texts, "json")
    assert texts.count() == 8 and back.select("key", "value").exceptAll(live).count() == 0 and back.count() == 100
    bad = store_files.import_json(spark.createDataFrame([('{"":"x","k":null}',), ("[]",), (None,)], "value string"))
    assert bad.filter("not ok").count() == bad.count() == 2
    lines = spark.createDataFrame([("# c",), ('a{x="1 2"} 3.5',), ("b NaN",), ("c x",), ("d 4",), (None,), ("e",)], "value string")
    assert [tuple(r) for r in store_files.parse_metrics(lines).collect()] == [("a", 'x="1 2"', 3.5), ("d", "", 4.0)]


def test_engine(spark):
    e = Engine(spark)
    assert e.get("a").count() == 0 and e.ping() == "PONG"
    assert e.batch_put([("user:1", "x"), ("user:2", "y"), ("user:1", "z"), ("s:1", "q")]) == "ok"
    assert e.put("", "x") == "empty_key" and e.batch_put([("ok", "v"), ("k" * 1025, "v")]) == "key_too_long"
    assert [(r["key"], r["value"]) for r in e.scan("user:").collect()] == [("user:1", "z"), ("user:2", "y")]
    assert e.delete("user:2", "nope") == 1 and e.exists("user:1", "user:1", "user:2") == 2
    assert [r["key"] for r in e.keys("*:?").collect()] == ["s:1", "user:1"] and [r["key"] for r in e.page("s:1", 5).collect()] == ["user:1"]
    assert not e.dump("user:2").first()["found"] and e.stats().first()["live_keys"] == 2
    assert Engine(spark, e.table.path).scan().count() == 2
    e.compact()
    assert e.put("user:3", "c", ts=9, vc={"n2": 4, "n1": 1}) == "ok" and e.batch_put([("user:4", "d", 1, 2, {"n1": 7}), ("user:5", "e")]) == "ok"
    assert {r["key"]: r["clock"] for r in e.clocks().collect() if r["key"] > "user:2"} == {"user:3": "n1=1,n2=4", "user:4": "n1=7", "user:5": ""}
    assert [tuple(r) for r in e.get("user:4").select("ver", "ts").collect()] == [(1, 2)] and e.batch_put([("k", "v")] * 10_001) == "too_many_keys"
    e.put_async("user:6", "f")
    assert e.exists("user:6") == 0 and e.flush() == "ok" and e.exists("user:6") == 1 and e.flush() == "ok"
    assert [(r["pos"], r["found"]) for r in e.batch_get(["user:6", "no", "user:6"]).collect()] == [(0, True), (1, False), (2, True)]
    cursor = e.iterate("user:")
    assert not cursor.valid and cursor.next() and cursor.key == "user:1" and cursor.value == "z" and cursor.seek("user:35") and cursor.key == "user:4"
    assert cursor.last() and not cursor.next() and cursor.prev() and cursor.key == "user:6" and cursor.total == 5 and not cursor.seek("z")
    cursor.close()
    assert not cursor.first() and e.seek("user:2").first()["key"] == "user:3"
    assert {r["key"] for r in e.sync(0, tombstones=True).collect()} > {"user:2"} and e.info().first()["disk_bytes"] > 0
    assert e.ttl("user:3", 5) is None
    e.expire("user:3", 100, 1000)
    e.expire("user:4", 100, 1000)
    e.expire("user:4", None, 1001)
    assert (e.ttl("user:3", 1050), e.ttl("user:3", 1200), e.ttl("user:4", 1050)) == (50, -100, None)
    assert e.drop_expired(1100) == 0 and e.drop_expired(1101) == 1 and e.exists("user:3", "user:4") == 1
    e.flush_all()
    assert e.scan().count() == 0


def test_reads_of_small_logs(spark):
    log = spark.createDataFrame([("PUT", k, "v", i, 0) for i, k in enumerate(["a", "b", "c"])], "op string, key string, value string, ver long, ts long")
    assert snapshot.scan(log).count() == 3 and snapshot.scan(log, "nope").count() == 0
    assert snapshot.seek(log, "aa").first()["key"] == "b" and snapshot.previous(log, "a").count() == 0
    asked = spark.createDataFrame([(0, "c"), (1, "zz"), (2, "c"), (3, None)], "pos long, key string")
    assert [(r["pos"], r["found"]) for r in snapshot.batch_get(log, asked).orderBy("pos").collect()] == [(0, True), (1, False), (2, True), (3, False)]
    assert snapshot.multi_get(log, asked).count() == 1 and snapshot.stats(log.limit(0)).first()["live_keys"] == 0


def test_small_functions(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    assert [show(format_bytes(F.lit(n))) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.00 KB", "3.00 MB", "5.00 GB"]
    assert [show(truncate_text(F.lit("abcdef"), n)) for n in (2, 5, 6)] == ["", "ab...", "abcdef"]
    assert [show(host_of(F.lit(a))) for a in ("http://h.x:80/p", "h:1", "[::1]:5")] == ["h.x", "h", "[::1]"]
    assert [show(quorum_status(*map(F.lit, q))) for q in ((3, 2, 2), (3, 1, 1), (3, 4, 1))] == ["ok", "no_overlap", "invalid_quorum"]
    assert [show(key_of_path(F.lit(x), "/api/v1/get/")) for x in ("/api/v1/get/a%2Fb", "/other", "/api/v1/get/")] == ["a/b", "", ""]
    assert glob_to_like("a*?_%\\") == "a%_\\_\\%\\\\"
    assert shell_words('put "a b" c"d e"f g\\ h "" "x\\y') == ["put", "a b", "cd ef", "g h", "x\\y"]


def stream_of(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1 if i + 1 < len(batches) else 0)  # files are taken by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_fills_a_merge_table(spark, tmp_path):
    schema = "op string, key string, ver long, ts long"
    rows = stream_of(spark, tmp_path, [[("PUT", "a", 1, 1), ("PUT", "b", 5, 1)], [("DEL", "b", 4, 1), ("DEL", "a", 2, 1)]], schema)
    table = MergeTable(spark)
    state.materialize(rows, table, str(tmp_path / "cp")).awaitTermination()
    assert len(table.runs) == 2 and [r["key"] for r in table.read().collect()] == ["b"]


def sink(df, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table("out").collect()


def test_stream_breaker_equals_batch(spark, tmp_path):
    from tidemark.operators import folds

    calls = [("p", i, float(t), ok) for i, (t, ok) in enumerate([(0, False), (1, False), (2, False), (3, True), (40, True), (41, False), (42, True)])]
    schema = "peer string, seq long, t double, ok boolean"
    got = sink(state.breaker_stream(stream_of(spark, tmp_path, [calls[:3], calls[3:]], schema)), tmp_path)
    want = folds.breaker_states(spark.createDataFrame(calls, schema), "peer", "t", "ok", "seq").collect()
    assert {(r["seq"], r["allowed"], r["state"]) for r in got} == {(r["seq"], r["allowed"], r["state"]) for r in want}


def test_stream_liveness(spark, tmp_path):
    schema = "node string, ts timestamp"
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    got = sink(state.liveness_changes(stream_of(spark, tmp_path, [[("a", at(0)), ("b", at(0))], [("b", at(40))], [("b", at(80))]], schema)), tmp_path)
    seen = {(r["node"], r["state"]) for r in got}
    assert {("a", "alive"), ("a", "suspect"), ("a", "dead"), ("b", "alive")} <= seen and ("b", "dead") not in seen


def test_stream_expiry(spark, tmp_path):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)
    ms = lambda s: int((base + timedelta(seconds=s) - datetime(1970, 1, 1)).total_seconds() * 1000)
    row = lambda k, op, ttl, s: (k, op, ttl, ms(s), base + timedelta(seconds=s))
    schema = "key string, op string, ttl_ms long, ts_ms long, ts timestamp"
    batches = [[row("a", "add", 10_000, 0), row("b", "add", 10_000, 0), row("c", "add", 10_000, 0)], [row("a", "add", 100_000, 5), row("b", "remove", 0, 5)], [row("z", "add", 10**9, 30)], [row("z", "add", 10**9, 31)]]
    got = sink(state.expiry_stream(stream_of(spark, tmp_path, batches, schema)), tmp_path)
    assert {(r["key"], r["expire_at"]) for r in got} == {("c", ms(10))}


def test_stream_queues(spark, tmp_path):
    schema = "lsn long, op string, key string, value string, ver long, ts long"
    rows = [(i, "PUT", f"k{i % 3}", str(i), i, 0) for i in range(12)]
    src = stream_of(spark, tmp_path, [rows[:6], rows[6:]], schema)
    state.coalesced(src, str(tmp_path / "out"), "lsn", str(tmp_path / "cp1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    ring = Ring(("n1", "n2", "n3"))
    state.fan_out_queue(src, lambda b: fan_out(place(b, "key", ring, 2)), str(tmp_path / "peers"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "peers")).count() == 24


def test_hint_outbox(spark, tmp_path):
    schema = "key string, target string, version long"
    src = stream_of(spark, tmp_path, [[("a", "down", 1), ("b", "up", 1)], [("c", "up", 1)]], schema)
    box = str(tmp_path / "box")
    state.deliver(src, box, lambda h: h.withColumn("ok", F.col("target") == "up"), checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{box}/1").collect()] == [("a", "down", 1, 2)]


def test_puts_go_on_behind_the_whole_log(spark, tmp_path, monkeypatch):
    schema = "lsn long, op string, key string, value string, ver long, ts long"
    log = spark.createDataFrame([(0, "PUT", "a", "x", 100, 5), (1, "DEL", "b", None, 107, 6), (2, "PUT", "c", "y", None, 7), (3, "PUT", "a", "z", 101, 4)], schema)
    puts = spark.createDataFrame([("n", "2", 9), ("m", "1", 8)], "key string, value string, ts long")
    old = [("PUT", "a", "x", 100, 5), ("DEL", "b", None, 107, 6), ("PUT", "c", "y", None, 7), ("PUT", "a", "z", 101, 4)]
    rows = lambda df: sorted((tuple(r) for r in df.select("op", "key", "value", "ver", "ts").collect()), key=str)
    assert rows(maintain.append_puts(log, puts, "ts")) == sorted([*old, ("PUT", "m", "1", 108, 8), ("PUT", "n", "2", 109, 9)], key=str)
    assert rows(maintain.append_puts(log, puts.withColumn("key", F.lit("")), "ts")) == sorted(old, key=str)
    log.write.parquet(str(tmp_path / "wal_record.parquet"))
    seen, whole = [], maintain.append_puts
    monkeypatch.setattr(maintain, "append_puts", lambda log, *rest: seen.append(log.count()) or whole(log, *rest))
    assert tuple(store.kv_append_puts(spark, str(tmp_path)).select("n", "first", "last").first()) == (2, 1, 2) and seen == [4]
