"""State machines over ordered events: breakers, token buckets, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


class Breaker:
    """Closed, open after ``threshold`` failures in a row, half open after ``timeout`` without one, closed after ``limit`` successes."""

    def __init__(self, threshold: int = 3, timeout: float = 30.0, limit: int = 3, state: tuple | None = None):
        self.threshold, self.timeout, self.limit = threshold, timeout, limit
        self.state, self.failures, self.successes, self.last = state or (CLOSED, 0, 0, 0.0)

    def step(self, t: float, ok: bool) -> tuple[bool, str]:
        """Whether a call at time ``t`` is let through, and the state after its outcome (which counts only then)."""
        if self.state == OPEN and t - self.last > self.timeout:
            self.state, self.successes = HALF_OPEN, 0
        if self.state == OPEN:
            return False, OPEN
        if ok:
            if self.state == CLOSED:
                self.failures = 0
            else:
                self.successes += 1
                if self.successes >= self.limit:
                    self.state, self.failures = CLOSED, 0
        else:
            self.last = t
            if self.state == HALF_OPEN:
                self.state, self.successes = OPEN, 0
            else:
                self.failures += 1
                if self.failures >= self.threshold:
                    self.state = OPEN
        return True, self.state

    def dump(self) -> tuple:
        return self.state, self.failures, self.successes, self.last


class Bucket:
    """A token bucket: ``burst`` tokens at first, one more every 1/rate seconds, never above burst."""

    def __init__(self, rate: float, burst: int):
        self.every, self.burst, self.tokens, self.ticks = 1.0 / rate, burst, burst, None

    def step(self, t: float) -> bool:
        tick = int(t // self.every)
        if self.ticks is not None:
            self.tokens = min(self.burst, self.tokens + tick - self.ticks)
        self.ticks = tick
        if self.tokens > 0:
            self.tokens -= 1
            return True
        return False


def _fold(df: DataFrame, group: str, order: list[str], start, step, out: list[str], types: str) -> DataFrame:
    """Run a state machine over the rows of each group in order, streaming through sorted partitions.

    Rows aren't gathered into frames of a whole group: partitions are sorted by (group, order) and read
    batch by batch with one state at a time, so memory doesn't depend on the size of a group. The fold of
    one group is sequential by nature.
    """
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for f in frames:
            results = []
            for g, *row in f[[group, *order]].itertuples(index=False, name=None):
                if g != current:
                    current, state = g, start()
                results.append(step(state, *row))
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(results, columns=out)], axis=1)[[*names, *out]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.filter(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, f"{schema}, {types}")


def breaker_states(calls: DataFrame, peer: str, t: str, ok: str, tie: str, threshold: int = 3, timeout: float = 30.0, limit: int = 3) -> DataFrame:
    """The calls with ``allowed`` and ``state`` (after the call) of the breaker of their peer. ``t`` is in seconds, ``tie`` orders equal times."""
    return _fold(calls, peer, [t, tie, ok], lambda: Breaker(threshold, timeout, limit), lambda b, at, _, good: b.step(at, bool(good)), ["allowed", "state"], "allowed boolean, state string")


def rate_limits(requests: DataFrame, client: str, t: str, tie: str, rate: float, burst: int) -> DataFrame:
    """The requests with ``allowed`` by the token bucket of their client."""
    return _fold(requests, client, [t, tie], lambda: Bucket(rate, burst), lambda b, at, _: (b.step(at),), ["allowed"], "allowed boolean")


def ttl_state(ops: DataFrame) -> DataFrame:
    """Per key its last operation: expire_at after an add (a later add replaces), nothing after a remove.

    ops: key, op (add, remove), ttl_ms, ts_ms. Of equal times a remove wins, then the longer ttl.
    """
    top = F.max(F.struct("ts_ms", "op", "ttl_ms")).alias("o")
    return ops.filter(F.col("key").isNotNull()).groupBy("key").agg(top).filter(F.col("o.op") == "add").select("key", (F.col("o.ts_ms") + F.col("o.ttl_ms")).alias("expire_at"))


def expired(ops: DataFrame, now: Column) -> DataFrame:
    """Keys whose time has passed (strictly)."""
    return ttl_state(ops).filter(F.col("expire_at") < now)


def is_expired(ops: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Wanted keys with ``expired``; an unknown key counts as expired."""
    return keys.select("key").distinct().join(ttl_state(ops), "key", "left").select("key", F.coalesce(F.col("expire_at") < now, F.lit(True)).alias("expired"))


def remaining(ops: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Wanted keys with the milliseconds they have left (negative once expired), null for those without a time to live."""
    return keys.select("key").distinct().join(ttl_state(ops), "key", "left").select("key", (F.col("expire_at") - now).alias("left_ms"))


def undelivered_hints(hints: DataFrame, delivered: DataFrame, max_attempts: int = 10, oldest: Column | None = None) -> DataFrame:
    """Hints to send again: not delivered (by key and target) and tried fewer than ``max_attempts`` times.

    With ``oldest`` hints created before it (``created_at``) have expired.
    """
    left = hints.join(delivered.select("key", "target").distinct(), ["key", "target"], "left_anti").filter(F.col("attempts") < max_attempts)
    return left if oldest is None else left.filter(F.col("created_at") >= oldest)
