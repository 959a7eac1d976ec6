"""The change log: which rows are changes, the newest change of a key, a log-structured merge table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import runs_merge
from ..functions.scalar import TIER_BOUNDS
from ..session import create_file, file_system, names_in, read_file, remove, scratch, shuffle_partitions

PUT, DEL = "PUT", "DEL"


def op_name(op: Column) -> Column:
    """The operation without surrounding blanks and tabs, in upper case."""
    return F.upper(F.regexp_replace(op, r"^[ \t]+|[ \t]+$", ""))


def changes(log: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The rows of a log that are changes, with ``op`` spelled PUT or DEL.

    A row is a change if its key is neither null nor empty, ver and ts are not null and op is PUT or DEL
    in any letter case, blanks and tabs around it ignored. Rows with equal (key, ver, ts) are one change;
    they are not merged here. ``keep`` names further columns to carry.
    """
    name = op_name(F.col("op"))
    return log.filter(
        (F.col("key") != "") & F.col("ver").isNotNull() & F.col("ts").isNotNull() & name.isin(PUT, DEL)
    ).select("key", "ver", "ts", name.alias("op"), *(keep or []))


def newest(rows: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """The row of each key that is highest by ``order``, by partial and final aggregation.

    Nulls are lowest. Rows equal in ``order`` are told apart by ``carry``, so the result is the same
    whatever the partitioning. A key's rows shrink to one per task before the shuffle.
    """
    top = F.max(F.struct(*order, *carry)).alias("__top")
    return rows.groupBy(key).agg(top).select(key, *[F.col(f"__top.{c}").alias(c) for c in [*order, *carry]])


class MergeTable:
    """A log-structured merge table of changes, kept as sorted runs in a shared folder.

    ``append`` turns a batch of changes into one run of level 0: the newest change per key of the batch, cut
    into buckets by the key's hash and sorted by key within each. Deletes stay in the run as tombstones.
    ``merged`` merges all runs on read: a task opens the sorted files of one bucket (of one range of its keys,
    if the bucket is larger than ``bucket_bytes``) and merges them as streams, a block of each in memory; the
    highest (ver, ts) wins. Nothing is shuffled or sorted as a whole. ``read`` hides keys held by a tombstone.

    Compaction by ``policy``, after each append: ``leveled`` merges a level of threshold * ratio^level runs or
    more into one run of the next level, from level 0 on up to the first level below its limit; ``tiered``
    merges the smallest size tier with ``threshold`` runs; ``None`` leaves it to ``compact``. So a row is
    written again once a level or tier, not at every append. Tombstones stay in merged runs, since a change
    they outrank may lie in another run or still come late; ``compact(drop_before=...)`` drops old ones.

    Runs become visible when the manifest that names them appears, whole and under a new number; a run whose
    write failed is never named, and repeating the append is safe since merging is idempotent. Order of
    appends doesn't matter. One writer at a time: a second one's manifest is refused. Runs that were merged
    away are kept for ``keep`` more manifests, so that frames built before still read.

    Null or empty keys and other rows that are no changes must be filtered before (``changes``). An empty
    batch gives an empty run. Columns: key, ver, ts, op and ``carry``, which must be sortable. The folder must
    be one that pyarrow opens by its address too (a file system mounted everywhere, HDFS, S3, GCS).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, carry: list[str] | None = None,
                 policy: str | None = "leveled", threshold: int = 4, ratio: float = 2.0, keep: int = 2, bucket_bytes: int = 256 << 20):
        if policy not in ("leveled", "tiered", None):
            raise ValueError("policy must be leveled, tiered or None")
        self.spark, self.path = spark, path or scratch(spark, "merge-table")
        self.buckets, self.carry = buckets or shuffle_partitions(spark), carry or []
        self.policy, self.threshold, self.ratio, self.keep, self.bucket_bytes = policy, threshold, ratio, keep, bucket_bytes
        self.rewritten = 0  # runs that compactions of this object have taken in
        self.refresh()

    # -- manifest -------------------------------------------------------------------------------------
    def refresh(self) -> None:
        """The manifest with the highest number holds."""
        self._generation, self.runs, self._gone, self._schema = 0, [], [], None
        names = names_in(self.spark, f"{self.path}/manifest")
        if names:
            m = json.loads(read_file(self.spark, f"{self.path}/manifest/{names[-1]}"))
            self._generation, self.runs, self._gone, self.buckets, self.carry = int(names[-1]), m["runs"], m["gone"], m["buckets"], m["carry"]
            self._schema = T.StructType.fromJson(m["schema"])

    def _commit(self, runs: list[dict]) -> None:
        generation = self._generation + 1
        names = {r["name"] for r in runs}
        gone = [*self._gone, *([r["name"], generation] for r in self.runs if r["name"] not in names)]
        old = [g for g in gone if g[1] <= generation - self.keep]
        gone = [g for g in gone if g not in old]
        body = {"runs": runs, "gone": gone, "buckets": self.buckets, "carry": self.carry, "schema": self._schema.jsonValue()}
        if not create_file(self.spark, f"{self.path}/manifest/{generation:010d}", json.dumps(body).encode()):
            raise RuntimeError(f"another writer has committed generation {generation}")
        self._generation, self.runs, self._gone = generation, runs, gone
        for name, _ in old:
            remove(self.spark, f"{self.path}/{name}")
        if generation > self.keep:
            remove(self.spark, f"{self.path}/manifest/{generation - self.keep:010d}")

    # -- runs -----------------------------------------------------------------------------------------
    def _write(self, rows: DataFrame, level: int) -> dict:
        """A run of distinct keys. Where the rows come out of a grouping by key a bucket lies whole in one task."""
        name = scratch(self.spark, "run").rsplit("/", 1)[-1]
        if self._schema is None:
            self._schema = rows.schema
        cut = rows.withColumn("__bucket", F.pmod(F.hash("key"), F.lit(self.buckets))).sortWithinPartitions("__bucket", "key")
        cut.write.partitionBy("__bucket").option("parquet.block.size", 32 << 20).parquet(f"{self.path}/{name}")
        return {"name": name, "level": level, "bytes": sum(size for _, _, size in self._files(name))}

    def _files(self, name: str) -> list[tuple[int, str, int]]:
        """Bucket, address and size of the files of a run."""
        fs, at = file_system(self.spark, f"{self.path}/{name}")
        found, listed = [], fs.listFiles(at, True)
        while listed.hasNext():
            f = listed.next()
            if f.getPath().getName().endswith(".parquet") and "__bucket=" in f.getPath().getParent().getName():
                found.append((int(f.getPath().getParent().getName().split("=")[1]), f.getPath().toString(), f.getLen()))
        return found

    def append(self, batch: DataFrame) -> str:
        run = self._write(newest(batch, "key", ["ver", "ts"], ["op", *self.carry]), 0)
        self._commit([*self.runs, run])
        self.maintain()
        return run["name"]

    def merged(self, columns: list[str] | None = None, low: str | None = None, high: str | None = None, runs: list[dict] | None = None, live: bool = False) -> DataFrame:
        """The newest change of each key, tombstones included unless ``live``; no shuffle.

        ``columns`` are the carried ones to read; ``low`` and ``high`` bound the keys (high not included)
        and are held against the statistics of the files' row groups.
        """
        runs = self.runs if runs is None else runs
        if self._schema is None or not runs:
            raise ValueError("the table has no runs yet")
        names = ["key", "ver", "ts", "op", *(self.carry if columns is None else columns)]
        schema = T.StructType([self._schema[n] for n in names])
        buckets: dict[int, list[tuple[str, int]]] = {}
        for r in runs:
            for bucket, file, size in self._files(r["name"]):
                buckets.setdefault(bucket, []).append((file, size))
        tasks = []
        for files in buckets.values():
            parts = max(1, -(-sum(size for _, size in files) // self.bucket_bytes))
            tasks += [(sorted(files, key=lambda f: -f[1]), i, parts) for i in range(parts)]
        if not tasks:
            return self.spark.createDataFrame([], schema)
        known = self.spark.sparkContext.broadcast(tasks)  # a few names for each task

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    files, part, parts = known.value[i]
                    for t in runs_merge.merge_files([f for f, _ in files], names, part, parts, low, high):
                        t = t.filter(pc.equal(t["op"], PUT)) if live else t
                        yield from t.to_batches()

        return self.spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, schema)

    def read(self, columns: list[str] | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
        """Live keys with the change each holds: key, ver, ts and the carried columns."""
        return self.merged(columns, low, high, live=True).drop("op")

    # -- compaction -----------------------------------------------------------------------------------
    def maintain(self) -> None:
        """What the policy asks for now; each merge is committed for itself."""
        if self.policy == "leveled":
            level = 0
            while len(full := [r for r in self.runs if r["level"] == level]) >= int(self.threshold * self.ratio**level):
                self.compact(full)
                level += 1
        while self.policy == "tiered":
            tiers: dict[int, list[dict]] = {}
            for r in self.runs:
                tiers.setdefault(sum(r["bytes"] >= bound for bound in TIER_BOUNDS), []).append(r)
            due = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.threshold), None)
            if due is None:
                break
            self.compact(due)

    def compact(self, runs: list[dict] | None = None, drop_before: int | None = None) -> None:
        """One run instead of some (of all, if none are named), a level above the highest of them.

        Tombstones with a ts below ``drop_before`` are dropped, which takes all runs: safe if no change that
        old can still come.
        """
        chosen = self.runs if runs is None else runs
        if drop_before is not None and len(chosen) < len(self.runs):
            raise ValueError("tombstones can only be dropped when all runs are merged")
        if not chosen:
            return
        rows = self.merged(runs=chosen)
        if drop_before is not None:
            rows = rows.filter((F.col("op") == PUT) | (F.col("ts") >= drop_before))
        names = {r["name"] for r in chosen}
        new = self._write(rows, max(r["level"] for r in chosen) + 1)
        self.rewritten += len(chosen)
        self._commit([*(r for r in self.runs if r["name"] not in names), new])

    def run_table(self) -> DataFrame:
        """A row per run: name, level, bytes."""
        return self.spark.createDataFrame([(r["name"], r["level"], r["bytes"]) for r in self.runs], "name string, level int, bytes long")


def replay(log: DataFrame, position: str, runs: int = 4, carry: list[str] | None = None, path: str | None = None, policy: str | None = None) -> MergeTable:
    """Feed a log to a merge table in ``runs`` equal ranges of its ``position`` column, each read for itself.

    The position is only used to cut the log; which change holds depends on (ver, ts) alone, so changes
    that come late, early or again give the same table. Rows with a null position join the first range.
    """
    spark = log.sparkSession
    lo, hi = log.agg(F.min(position), F.max(position)).first()
    table = MergeTable(spark, path, carry=carry, policy=policy)
    if lo is None:
        table.append(changes(log, carry))
        return table
    step = max(1, -(-(hi - lo + 1) // runs))
    for i in range(runs):
        a, b = lo + i * step, lo + (i + 1) * step
        part = (F.col(position) >= a) & (F.col(position) < b)
        if i == 0:
            part = part | F.col(position).isNull()
        table.append(changes(log.filter(part), carry))
    return table
