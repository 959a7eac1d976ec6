"""Runs that process only what is new since the last successful run."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import create_file, names_in, read_file, remove, scratch
from .changes import changes


def undelivered(log: DataFrame, delivered: DataFrame | None) -> DataFrame:
    """Distinct changes (key, ver, ts) of a log that are not among the delivered ones.

    Repeated rows count once. A second content under a delivered ver has another ts and comes out. Rows
    that are no changes, and delivered rows with a null in key, ver or ts, match nothing. Both sides are
    partitioned by all three columns, over which a frequent key spreads.
    """
    fresh = changes(log).select("key", "ver", "ts").distinct()
    if delivered is None:
        return fresh
    return fresh.join(delivered.select("key", "ver", "ts"), ["key", "ver", "ts"], "left_anti")


def delivered_by(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Items of successful runs (status ``ok``); whatever other runs delivered is void.

    run_id is unique in ``runs``. A run may hold any share of the items; where the runs table is too large
    to broadcast by Spark's own size check, adaptive execution splits such a run's partition.
    """
    ok = runs.filter(F.col("status") == "ok").select("run_id")
    return items.join(ok, "run_id", "left_semi").select("key", "ver", "ts")


class Feed:
    """Incremental processing of a log with a monotonic commit position.

    A run covers the positions (watermark, upper]; ``upper`` is the highest position when the run starts
    and stays fixed, however much is appended meanwhile. The run writes its output into a folder of its
    own; one small commit file then names all folders that count and the new watermark together, created
    whole under the next number or not at all. Until then the output is invisible and the watermark
    unmoved, so a run that fails anywhere can simply be repeated: nothing is skipped and nothing comes twice.

    Changes are sent again or late, so the range alone doesn't tell what is new. Versions above the highest
    delivered one can't have been delivered and come out as they are. Only what lies at or below it is
    compared with earlier output, of which the blocks of versions concerned are read: output is sorted by
    version. Rows without a position belong to every range and are told apart in the same way.

    ``adopt`` takes over what an earlier system has delivered, as first commit. One run at a time: the
    commit of a second one is refused.
    """

    BLOCK, BLOCKS = 1 << 16, 1000  # versions of a block; blocks that are named one by one in the filter of a read

    def __init__(self, spark: SparkSession, path: str | None = None, position: str = "lsn"):
        self.spark, self.position = spark, position
        self.path = path or scratch(spark, "feed")

    # -- state ----------------------------------------------------------------------------------------
    def state(self) -> dict:
        """The newest commit: id, lower, upper, folder, rows, and the outputs of all runs so far with their versions."""
        names = names_in(self.spark, f"{self.path}/commits")
        if not names:
            return {"id": 0, "lower": None, "upper": None, "folder": None, "rows": 0, "outputs": []}
        return json.loads(read_file(self.spark, f"{self.path}/commits/{names[-1]}"))

    def watermark(self) -> int | None:
        return self.state()["upper"]

    def output(self, commit_id: int | None = None) -> DataFrame | None:
        """What committed runs have delivered, of one run or of all; None without output."""
        outputs = [o for o in self.state()["outputs"] if commit_id in (None, o["id"])]
        return self.spark.read.parquet(*[f"{self.path}/{o['folder']}" for o in outputs]) if outputs else None

    def _commit(self, before: dict, rows: DataFrame, lower, upper) -> dict:
        """Write rows and commit them with the watermark; what a failed attempt has written is removed."""
        folder = "out-" + scratch(self.spark, "attempt").rsplit("/", 1)[-1]
        try:
            rows.select("key", "ver", "ts").sortWithinPartitions("ver").write.option("parquet.block.size", 16 << 20).parquet(f"{self.path}/{folder}")
            n, low, high = self.spark.read.parquet(f"{self.path}/{folder}").agg(F.count(F.lit(1)), F.min("ver"), F.max("ver")).first()
            mine = [{"id": before["id"] + 1, "folder": folder, "low": low, "high": high}] if n else []
            commit = {"id": before["id"] + 1, "lower": lower, "upper": upper, "folder": folder if n else None, "rows": n, "outputs": before["outputs"] + mine}
            if not self._publish(commit):
                raise RuntimeError(f"commit {commit['id']} exists already: another run was faster")
        except BaseException:
            remove(self.spark, f"{self.path}/{folder}")
            raise
        return commit

    def _publish(self, commit: dict) -> bool:
        return create_file(self.spark, f"{self.path}/commits/{commit['id']:010d}", json.dumps(commit).encode())

    # -- runs -----------------------------------------------------------------------------------------
    def adopt(self, runs: DataFrame, items: DataFrame) -> dict:
        """Take over an earlier system's deliveries: the items of its successful runs, and no others.

        Its runs tell versions (``since_version``, ``upto_version``), no positions, so the first run still
        reads the whole log; the highest version delivered bounds what has to be compared.
        """
        before = self.state()
        if before["id"]:
            raise RuntimeError("a feed adopts before its first run")
        return self._commit(before, delivered_by(runs, items).filter("key is not null and ver is not null and ts is not null"), None, None)

    def run(self, log: DataFrame) -> dict:
        """Process what is new in ``log`` and commit; gives the commit (id, lower, upper, folder, rows, outputs).

        An empty log, or one without new positions, commits nothing and gives a commit of no rows; rows
        without a position wait for the next row that has one.
        """
        before = self.state()
        lower, at = before["upper"], F.col(self.position)
        ranged = log if lower is None else log.filter((at > lower) | at.isNull())
        upper = ranged.agg(F.max(self.position)).first()[0]
        if upper is None:
            return before | {"lower": lower, "folder": None, "rows": 0}
        return self._commit(before, self.fresh(ranged.filter((at <= upper) | at.isNull()), before["outputs"]), lower, upper)

    def fresh(self, log: DataFrame, outputs: list[dict]) -> DataFrame:
        """Distinct changes of a log that none of the outputs holds."""
        if not outputs:
            return undelivered(log, None)
        high = max(o["high"] for o in outputs)
        late = log.filter(F.col("ver") <= high)
        return undelivered(log.filter(F.col("ver") > high), None).unionByName(undelivered(late, self._near(late, outputs)))

    def _near(self, late: DataFrame, outputs: list[dict]) -> DataFrame | None:
        """Output in the blocks of versions that late changes lie in; beyond ``BLOCKS`` blocks, in their whole range."""
        blocks = sorted(r[0] for r in changes(late).select(F.floor(F.col("ver") / self.BLOCK)).distinct().limit(self.BLOCKS + 1).collect())
        if not blocks:
            return None
        if len(blocks) > self.BLOCKS:
            low, high = changes(late).agg(F.min("ver"), F.max("ver")).first()
            ranges = [(low, high)]
        else:
            ranges = []
            for b in blocks:
                if ranges and ranges[-1][1] == b * self.BLOCK - 1:
                    ranges[-1] = (ranges[-1][0], (b + 1) * self.BLOCK - 1)
                else:
                    ranges.append((b * self.BLOCK, (b + 1) * self.BLOCK - 1))
        touched = [o for o in outputs if any(o["low"] <= hi and o["high"] >= lo for lo, hi in ranges)]
        if not touched:
            return None
        rows = self.spark.read.parquet(*[f"{self.path}/{o['folder']}" for o in touched])
        return rows.filter(reduce(lambda a, b: a | b, [F.col("ver").between(lo, hi) for lo, hi in ranges]))

    def compact(self) -> dict:
        """All outputs in one folder, sorted by version; old folders stay until ``clean``."""
        before = self.state()
        whole = self.output()
        if whole is None:
            return before
        folder = "out-" + scratch(self.spark, "whole").rsplit("/", 1)[-1]
        whole.repartitionByRange("ver").sortWithinPartitions("ver").write.option("parquet.block.size", 16 << 20).parquet(f"{self.path}/{folder}")
        low, high = min(o["low"] for o in before["outputs"]), max(o["high"] for o in before["outputs"])
        commit = before | {"id": before["id"] + 1, "folder": None, "rows": 0, "outputs": [{"id": before["id"] + 1, "folder": folder, "low": low, "high": high}]}
        if not self._publish(commit):
            remove(self.spark, f"{self.path}/{folder}")
            raise RuntimeError(f"commit {commit['id']} exists already: another run was faster")
        return commit

    def clean(self) -> list[str]:
        """Remove folders that no commit names: those of runs that died, and those merged away. For when no run is under way."""
        named = {o["folder"] for o in self.state()["outputs"]}
        gone = [n for n in names_in(self.spark, self.path) if n.startswith("out-") and n not in named]
        for name in gone:
            remove(self.spark, f"{self.path}/{name}")
        return gone
