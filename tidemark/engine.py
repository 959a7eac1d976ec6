"""A facade over the operators with the store's own calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vclock
from .operators import folds, maintain, snapshot
from .operators.changes import DEL, PUT, MergeTable, changes

_LOG = "op string, key string, value string, ver long, ts long, clock string"
_ENTRY = "key string, value string, ver long, ts long, vc map<string,bigint>, n long"


class Engine:
    """A versioned key-value table on a merge table: reads are DataFrames, writes append runs.

    Versions go on from the highest stored. A write may bring its own version, time and vector clock, which
    are kept; clocks are stored as canonical text. Values are strings; use base64 for bytes. ``put_async``
    gathers writes on the driver until ``flush``. Closing is a no-op.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, **options):
        self.spark = spark
        self.table = MergeTable(spark, path, carry=["value", "clock"], **options)
        self._times: MergeTable | None = None
        self._waiting: list[tuple] = []

    def _log(self) -> DataFrame:
        if not self.table.runs:
            return self.spark.createDataFrame([], _LOG)
        return self.table.merged().select("op", "key", "value", "ver", "ts", "clock")

    def _next(self) -> int:
        return (self._log().agg(F.max("ver")).first()[0] or 0) + 1

    # writes
    def write(self, rows: DataFrame) -> None:
        """Append rows (op, key, value, ver, ts, and vc if they have it) as they are."""
        clock = vclock.text(F.col("vc")) if "vc" in rows.columns else F.lit("")
        self.table.append(changes(rows.withColumn("clock", clock), ["value", "clock"]))

    def put(self, key: str, value: str, ts: int = 0, vc: dict | None = None) -> str:
        return self.batch_put([(key, value, 0, ts, vc)])

    def batch_put(self, entries: list[tuple], ts: int = 0) -> str:
        """Entries (key, value, and optionally version, time, clock). All or nothing, 10,000 at most; of a key that comes twice
        the later entry holds. Versions and times are filled where they are zero. Gives ok or why it was refused."""
        if len(entries) > maintain.MAX_BATCH_KEYS:
            return "too_many_keys"
        rows = [(*e, *(0, ts, None)[len(e) - 2:], i) for i, e in enumerate(entries)]
        frame = self.spark.createDataFrame(rows, _ENTRY)
        bad = maintain.admitted(frame).filter("status <> 'ok'").orderBy("n").select("status").first()
        if bad:
            return bad[0]
        self.write(maintain.completed(self._log(), frame, [F.col("n")], ts))
        return "ok"

    def put_async(self, key: str, value: str, ts: int = 0, vc: dict | None = None) -> None:
        self._waiting.append((key, value, 0, ts, vc))

    def flush(self) -> str:
        """Write what ``put_async`` has gathered."""
        waiting, self._waiting = self._waiting, []
        return self.batch_put(waiting) if waiting else "ok"

    def delete(self, *keys: str, ts: int = 0) -> int:
        """Tombstones; gives how many of the keys were visible."""
        wanted = self.spark.createDataFrame([(k,) for k in keys], "key string")
        dead = maintain.deletes(self._log(), wanted, ts)
        n = dead.filter("existed").count()
        self.write(dead.withColumn("value", F.lit(None).cast("string")))
        return n

    def flush_all(self, ts: int = 0) -> None:
        """A tombstone for every visible key."""
        base = self._next()
        live = self.scan()
        self.write(live.select(F.lit(DEL).alias("op"), "key", F.lit(None).cast("string").alias("value"), F.lit(base).cast("long").alias("ver"), F.lit(ts).cast("long").alias("ts")))

    # reads
    def get(self, key: str) -> DataFrame:
        return snapshot.get(self._log(), key)

    def dump(self, key: str) -> DataFrame:
        """The newest row of a key, tombstones too, with ``found``."""
        return snapshot.dump(self._log(), key)

    def multi_get(self, keys: list[str]) -> DataFrame:
        return snapshot.multi_get(self._log(), self.spark.createDataFrame([(k,) for k in keys], "key string"))

    def batch_get(self, keys: list[str]) -> DataFrame:
        """A row for each wanted key in its place, repeated and missing ones too; 10,000 keys at most."""
        if len(keys) > maintain.MAX_BATCH_KEYS:
            raise ValueError("too_many_keys")
        return snapshot.batch_get(self._log(), self.spark.createDataFrame(list(enumerate(keys)), "pos int, key string")).orderBy("pos")

    def clocks(self) -> DataFrame:
        """Clock of the newest change of each key, as text."""
        return self._log().select("key", "clock")

    def exists(self, *keys: str) -> int:
        return snapshot.exists_count(self._log(), self.spark.createDataFrame([(k,) for k in keys], "key string")).first()[0]

    def scan(self, prefix: str = "") -> DataFrame:
        return snapshot.scan(self._log(), prefix)

    def keys(self, pattern: str = "*") -> DataFrame:
        return snapshot.glob(self._log(), pattern).select("key").orderBy("key")

    def page(self, cursor: str, n: int, pattern: str = "*") -> DataFrame:
        return snapshot.page(self._log(), cursor, n, pattern)

    def seek(self, key: str) -> DataFrame:
        return snapshot.seek(self._log(), key)

    def iterate(self, prefix: str = "") -> snapshot.Cursor:
        """A cursor over the rows under a prefix as they are now."""
        return snapshot.Cursor(snapshot.scan(self._log(), prefix, order=False))

    def sync(self, version: int, tombstones: bool = False) -> DataFrame:
        return snapshot.sync(self._log(), version, tombstones)

    def stats(self) -> DataFrame:
        return snapshot.stats(self._log())

    def info(self) -> DataFrame:
        """Stats with the files behind them: runs, levels, bytes on disk, and the rate the filters are built for."""
        runs = self.table.runs
        return self.stats().select("*", F.lit(len(runs)).alias("runs"), F.lit(len({r["level"] for r in runs})).alias("levels"),
                                   F.lit(sum(r["bytes"] for r in runs)).cast("long").alias("disk_bytes"), F.lit(0.01).alias("filter_rate"))

    # time to live
    def _ttl(self) -> MergeTable:
        if self._times is None:
            self._times = MergeTable(self.spark, f"{self.table.path}/ttl", buckets=self.table.buckets, carry=["ttl_ms"])
        return self._times

    def expire(self, key: str, ttl_ms: int | None, now_ms: int) -> None:
        """A time to live from now on; None takes it away. The last call for a key holds."""
        row = [(key, now_ms, 0, PUT if ttl_ms is not None else DEL, ttl_ms)]
        self._ttl().append(self.spark.createDataFrame(row, "key string, ver long, ts long, op string, ttl_ms long"))

    def _ttl_ops(self) -> DataFrame:
        if not self._ttl().runs:
            return self.spark.createDataFrame([], "key string, op string, ttl_ms long, ts_ms long")
        return self._ttl().merged().select("key", F.when(F.col("op") == PUT, "add").otherwise("remove").alias("op"), "ttl_ms", F.col("ver").alias("ts_ms"))

    def ttl(self, key: str, now_ms: int) -> int | None:
        """Milliseconds a key has left, negative once it has expired; None without a time to live."""
        wanted = self.spark.createDataFrame([(key,)], "key string")
        return folds.remaining(self._ttl_ops(), wanted, F.lit(now_ms)).first()["left_ms"]

    def drop_expired(self, now_ms: int) -> int:
        """Tombstones for keys whose time has passed; gives how many were visible."""
        gone = folds.expired(self._ttl_ops(), F.lit(now_ms)).select("key")
        dead = maintain.deletes(self._log(), gone, now_ms * 1_000_000).filter("existed")
        n = dead.count()
        self.write(dead.withColumn("value", F.lit(None).cast("string")))
        return n

    # maintenance
    def compact(self) -> None:
        self.table.compact()

    def ping(self) -> str:
        return "PONG"
