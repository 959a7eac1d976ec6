"""Reading the store: the state of the log, and point, multi-key, prefix and range reads of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import glob_to_like
from ..session import checkpoint
from .changes import DEL, changes, newest
from .skew import salted_join


def latest(log: DataFrame) -> DataFrame:
    """Newest change of each key, tombstones included: key, value, ver, ts, tombstone.

    One aggregation with map-side combine, so a hot key reaches the shuffle as a row per task.
    """
    rows = newest(changes(log, ["value"]), "key", ["ver", "ts"], ["op", "value"])
    return rows.select("key", "value", "ver", "ts", (F.col("op") == DEL).alias("tombstone"))


def live(log: DataFrame) -> DataFrame:
    """Visible rows. Tombstones take part in choosing the newest change and are hidden after it."""
    return latest(log).filter(~F.col("tombstone")).drop("tombstone")


def get(log: DataFrame, key: str) -> DataFrame:
    """One key's visible row, or nothing. The key is filtered before the aggregation and reaches the scan."""
    return live(log.filter(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Visible rows of the wanted keys; repeated keys come out once, missing ones not at all."""
    wanted = keys.filter(F.col(key) != "").select(F.col(key).alias("key")).distinct()
    return live(log).join(wanted, "key", "left_semi")


def batch_get(log: DataFrame, requests: DataFrame, pos: str = "pos", key: str = "key") -> DataFrame:
    """One row per request (repeated rows and keys kept): pos, key, value, ver, found. Order by pos to list them."""
    rows = requests.select(F.col(pos).alias("pos"), F.col(key).alias("key"))
    return salted_join(rows, live(log), "key", how="left").select("pos", "key", "value", "ver", F.col("ver").isNotNull().alias("found"))


def scan(log: DataFrame, prefix: str = "", order: bool = True) -> DataFrame:
    """Visible rows whose key starts with a prefix, by key. The prefix test reaches the scan."""
    rows = live(log.filter(F.col("key").startswith(prefix)) if prefix else log)
    return rows.orderBy("key") if order else rows


def glob(log: DataFrame, pattern: str) -> DataFrame:
    """Visible rows whose key matches a pattern with ``*`` and ``?``."""
    return live(log.filter(F.col("key").like(glob_to_like(pattern))))


def page(log: DataFrame, cursor: str, n: int, pattern: str = "*") -> DataFrame:
    """The ``n`` keys after ``cursor`` that match a pattern: keyset pagination."""
    return glob(log.filter(F.col("key") > cursor), pattern).orderBy("key").limit(n)


def since(log: DataFrame, version: int) -> DataFrame:
    """Visible rows with a version strictly greater."""
    return live(log).filter(F.col("ver") > version)


def seek(log: DataFrame, key: str) -> DataFrame:
    """The first visible row at or after a key."""
    return live(log.filter(F.col("key") >= key)).orderBy("key").limit(1)


def previous(log: DataFrame, key: str) -> DataFrame:
    """The last visible row before a key."""
    return live(log.filter(F.col("key") < key)).orderBy(F.desc("key")).limit(1)


def global_rank(df: DataFrame, order: list[Column], out: str = "pos", total: str | None = None) -> DataFrame:
    """Position of each row in a total order, from 0, without sorting everything in one task.

    Rows are range partitioned and written once; the sizes of the partitions (as many numbers as there
    are partitions) give the offset of each, and rows are numbered within their partition.
    """
    cut = checkpoint(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    lower = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__off"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ranked = cut.withColumn("__rn", within).join(F.broadcast(offsets), "__part").withColumn(out, F.col("__off") + F.col("__rn") - 1)
    if total:
        ranked = ranked.withColumn(total, F.col("__all"))
    return ranked.drop("__part", "__rn", "__off", "__all")


def stats(log: DataFrame) -> DataFrame:
    """One row: live keys, bytes of live keys and values, highest version of the log."""
    state = latest(log)
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return state.agg(
        F.count_if(~F.col("tombstone")).alias("live_keys"),
        F.coalesce(F.sum(F.when(~F.col("tombstone"), size)), F.lit(0)).cast("long").alias("live_bytes"),
        F.count_if(F.col("tombstone")).alias("tombstones"),
        F.max("ver").alias("max_version"),
    )


def exists_count(log: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """One row: how many of the listed keys (repeats counted) are present."""
    wanted = keys.filter(F.col(key) != "").groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("times"))
    return wanted.join(live(log).select("key"), "key").agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"))


def sync(log: DataFrame, version: int, tombstones: bool = False) -> DataFrame:
    """Rows with a version strictly greater, on request deleted ones too, and ``upto``: the highest version there is, from which to go on."""
    state = latest(log)
    rows = state.filter(F.col("ver") > version)
    return (rows if tombstones else rows.filter(~F.col("tombstone"))).withColumn("upto", state.agg(F.max("ver")).scalar())


def dump(log: DataFrame, key: str) -> DataFrame:
    """The newest row of a key as it is stored, a tombstone too, with ``found``: whether a read would see it."""
    return latest(log.filter(F.col("key") == key)).withColumn("found", ~F.col("tombstone"))


def scan_then_get(log: DataFrame, prefix: str) -> DataFrame:
    """Late materialisation: the keys under a prefix first, then their rows."""
    return multi_get(log, scan(log, prefix, order=False).select("key"))


class Cursor:
    """A cursor over one snapshot in key order: it stands before the first row at first.

    The snapshot is written once, ranked and cut by ranges of keys; a move is a read of one row by position
    or key, which file statistics narrow to a row group. Moves give whether the cursor stands on a row.
    """

    def __init__(self, rows: DataFrame):
        self.rows = checkpoint(global_rank(rows, [F.col("key")], "__at").sortWithinPartitions("__at"), "cursor")
        self.total, self.pos, self.entry = self.rows.count(), -1, None

    def _go(self, pos: int) -> bool:
        self.pos = max(-1, min(pos, self.total))
        got = self.rows.filter(F.col("__at") == self.pos).drop("__at").first() if 0 <= self.pos < self.total else None
        self.entry = got.asDict() if got else None
        return self.valid

    @property
    def valid(self) -> bool:
        return self.entry is not None

    @property
    def key(self) -> str | None:
        return self.entry["key"] if self.entry else None

    @property
    def value(self):
        return self.entry["value"] if self.entry else None

    def first(self) -> bool:
        return self._go(0)

    def last(self) -> bool:
        return self._go(self.total - 1)

    def next(self) -> bool:
        return self._go(self.pos + 1)

    def prev(self) -> bool:
        return self._go(self.pos - 1)

    def seek(self, key: str) -> bool:
        """To the first row at or after a key."""
        at = self.rows.filter(F.col("key") >= key).agg(F.min("__at")).first()[0]
        return self._go(self.total if at is None else at)

    def close(self) -> None:
        self.total, self.pos, self.entry = 0, -1, None
