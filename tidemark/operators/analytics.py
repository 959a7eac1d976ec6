"""Latencies, failure detection, request metrics and alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .skew import blocked_lag, compress, floor_rank, nearest_rank, weighted_percentiles

PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def latency_summary(samples: DataFrame, by: str, ms: str, ok: str, rank=nearest_rank) -> DataFrame:
    """Per class: operations, errors, mean, least, most and percentiles of the latency, exact.

    Running sums are formed in blocks of values that are equal in their leading 14 bits (sign, exponent, two
    of the fraction) and as many more as are needed for 2^16 distinct values a block at most: the distinct
    values of a class and block are counted, so no block grows with the data. Null latencies count as
    operations and are left out of the figures.
    """
    base = samples.groupBy(by).agg(
        F.count(F.lit(1)).alias("ops"), F.count_if(~F.col(ok)).alias("errors"),
        F.avg(ms).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
    )
    weights = checkpoint(compress(samples, [by], ms), "weights")
    found = weighted_percentiles(weights, [by], ms, PERCENTILES, _value_block(weights, [by], ms), rank=rank)
    joined = base.alias("l").join(found.alias("r"), F.col(f"l.{by}").eqNullSafe(F.col(f"r.{by}")), "left")
    return joined.select("l.*", *[f"r.{p}" for p in PERCENTILES])


def _value_block(weights: DataFrame, by: list[str], value: str, most: int = 1 << 16) -> Column:
    """A monotone function of a numeric value whose blocks hold at most ``most`` distinct values of a class.

    Doubles are mapped to integers in their order and cut after a number of leading bits. Classes hold each
    value once, so the largest block tells how many bits more are needed; with all bits a block is one value.
    """
    number = F.col(value).cast("double") + F.lit(0.0)  # -0.0 becomes 0.0
    bits = _ordered_bits(number)
    kept = 14
    while kept < 64:
        top = weights.filter(F.col(value).isNotNull()).groupBy(*by, F.shiftright(bits, 64 - kept)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if top <= most:
            break
        kept = min(64, kept + max(1, math.ceil(math.log2(top / most))))
    return F.shiftright(bits, 64 - kept) if kept < 64 else bits


def _ordered_bits(number: Column) -> Column:
    """The place of a double among all doubles as BIGINT, by its parts: exponent and fraction, negated below zero."""
    size = F.abs(number)
    power = F.when(size > 0, F.floor(F.least(F.greatest(F.log2(size), F.lit(-1022.0)), F.lit(1024.0)))).otherwise(F.lit(-1023)).cast("long")
    # log2 may be off by one at powers of two; the scaled fraction is clipped, which keeps the order
    part = F.when(size > 0, F.least(F.greatest(size / F.pow(F.lit(2.0), power.cast("double")) - 1, F.lit(0.0)), F.lit(1 - 2.0**-52))).otherwise(F.lit(0.0))
    place = (power + 1023) * F.lit(1 << 52) + F.floor(part * F.lit(float(1 << 52))).cast("long")
    return F.when(number < 0, -place).otherwise(place)


def adaptive_timeout(samples: DataFrame, node: str, order: str, ms: str, window: int = 100, percentile: float = 0.95, factor: float = 2.0, low: int = 50, high: int = 5000, default: int = 500, least: int = 3) -> DataFrame:
    """Per node the timeout from its last ``window`` latencies: percentile times factor, clamped; a default for fewer than ``least``.

    The limit on the row number is applied before the shuffle too, so a node brings at most ``window``
    rows per task. Latencies count in whole milliseconds.
    """
    recent = samples.select(node, order, F.floor(ms).alias("__ms")).withColumn("__rn", F.row_number().over(Window.partitionBy(node).orderBy(F.desc(order)))).filter(F.col("__rn") <= window)
    agg = recent.groupBy(node).agg(F.count("__ms").alias("__n"), F.array_sort(F.collect_list("__ms")).alias("__s"))  # window rows at most
    p = F.get("__s", (nearest_rank(F.col("__n"), percentile) - 1).cast("int"))
    return agg.select(node, F.when(F.col("__n") < least, F.lit(default)).otherwise(F.least(F.greatest(F.floor(p * factor), F.lit(low)), F.lit(high))).cast("long").alias("timeout_ms"))


def phi_count(heartbeats: DataFrame, node: str, ts: str, now: Column, window: int = 1000, least: int = 10, threshold: float = 8.0) -> DataFrame:
    """Suspicion from the last ``window`` intervals: elapsed / mean / ln 10, or 0 with fewer than ``least``.

    Only the last window + 1 heartbeats of a node are kept, also before the shuffle. Intervals and the
    elapsed time are in whole milliseconds.
    """
    recent = heartbeats.filter(F.col(ts).isNotNull()).select(node, ts).withColumn("__rn", F.row_number().over(Window.partitionBy(node).orderBy(F.desc(ts)))).filter(F.col("__rn") <= window + 1)
    ms = lambda a, b: F.floor((F.unix_micros(a) - F.unix_micros(b)) / 1000)
    steps = recent.withColumn("__iv", ms(F.col(ts), F.lag(ts).over(Window.partitionBy(node).orderBy(ts))))
    agg = steps.groupBy(node).agg(F.count("__iv").alias("__n"), F.avg("__iv").alias("__mean"), F.max(ts).alias("__last"))
    phi = F.when((F.col("__n") < least) | (F.coalesce("__mean", F.lit(0.0)) <= 0), F.lit(0.0)).otherwise(ms(now, F.col("__last")) / F.col("__mean") / F.log(F.lit(10.0)))
    return agg.select(node, phi.alias("phi")).withColumn("alive", F.col("phi") < threshold)


def phi_window(heartbeats: DataFrame, nodes: DataFrame, node: str, ts: str, now: Column, seconds: int, least: int = 3, threshold: float = 8.0) -> DataFrame:
    """Suspicion from the heartbeats within ``seconds`` before a node's last one.

    Without history it is threshold + 1, with fewer than ``least`` heartbeats threshold + 0.5, and 0 if the
    mean isn't positive. The mean interval is the span over one less than the count, so no ordering is
    needed: two aggregations per node.
    """
    micros = F.unix_micros(ts)
    beats = heartbeats.filter(F.col(ts).isNotNull()).select(node, micros.alias("__t"))
    last = beats.groupBy(node).agg(F.max("__t").alias("__last"))
    kept = beats.join(last, node).filter(F.col("__t") >= F.col("__last") - seconds * 1_000_000)
    agg = kept.groupBy(node).agg(F.count(F.lit(1)).alias("__n"), F.min("__t").alias("__first"), F.max("__t").alias("__last"))
    mean = F.floor((F.col("__last") - F.col("__first")) / (F.col("__n") - 1))
    phi = (
        F.when(F.col("__n").isNull(), F.lit(threshold + 1))
        .when(F.col("__n") < least, F.lit(threshold + 0.5))
        .when((F.col("__n") < 2) | (F.col("__last") <= F.col("__first")), F.lit(0.0))
        .otherwise((F.unix_micros(now) - F.col("__last")) / mean / F.log(F.lit(10.0)))
    )
    return nodes.select(node).distinct().join(agg, node, "left").select(node, phi.alias("phi")).withColumn("alive", F.col("phi") < threshold)


def request_counters(requests: DataFrame, op: str, ok: Column) -> DataFrame:
    """Requests by operation and status."""
    return requests.groupBy(F.col(op).alias("operation"), F.when(ok, "success").otherwise("error").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def histogram(samples: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative histogram: per group and upper bound (infinity last) the values at or below it.

    One pass of conditional counts, then the few counts of each group are unfolded.
    """
    counts = samples.groupBy(*by).agg(F.count(value).alias("all"), F.sum(value).alias("total"), *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return counts.select(*by, "total", F.explode(pairs).alias("p")).select(*by, "p.le", "p.n", "total")


def histogram_quantile(hist: DataFrame, by: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets, linear within the bucket that holds it.

    The bucket of infinity gives the highest finite bound; a group without values gives null.
    """
    w = Window.partitionBy(*by).orderBy("le")
    rows = hist.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("rank", F.max("n").over(Window.partitionBy(*by)) * F.lit(q))
    hit = rows.filter((F.col("n") >= F.col("rank")) & (F.col("n") > 0)).groupBy(*by).agg(F.min(F.struct("le", "lo", "below", "n", "rank")).alias("h"))
    inside = F.col("h.lo") + (F.col("h.le") - F.col("h.lo")) * (F.col("h.rank") - F.col("h.below")) / (F.col("h.n") - F.col("h.below"))
    value = F.when(F.isnan(F.col("h.le")) | (F.col("h.le") == float("inf")), F.col("h.lo")).when(F.col("h.n") == F.col("h.below"), F.col("h.le")).otherwise(inside)
    groups = hist.select(*by).distinct() if by else None
    found = hit.select(*by, value.alias("quantile"))
    return groups.join(found, by, "left") if groups is not None else found


def scrapes(requests: DataFrame, ts: str, series: list[str], seconds: int = 5, ok: Column | None = None) -> DataFrame:
    """Counters as a scraper would see them: per series and step the requests within the step, and errors."""
    step = F.floor(F.unix_micros(F.col(ts)) / (seconds * 1_000_000)) * seconds
    bad = F.count_if(~ok) if ok is not None else F.lit(0).cast("long")
    return requests.filter(F.col(ts).isNotNull()).groupBy(*series, step.alias("t")).agg(F.count(F.lit(1)).alias("n"), bad.alias("errors"))


def counter_rate(counters: DataFrame, series: list[str], t: str, value: str, seconds: float = 5.0, block_s: int = 86_400, raw_after_reset: bool = False) -> DataFrame:
    """Increase per second against the scrape before; the first scrape gives 0.

    A falling counter was reset: it gives 0, or with ``raw_after_reset`` what it has counted since.
    """
    lagged = blocked_lag(counters, series, t, value, F.floor(F.col(t) / block_s), "__prev")
    change = F.col(value) - F.coalesce("__prev", F.col(value))
    grown = F.when(change < 0, F.col(value)).otherwise(change) if raw_after_reset else F.greatest(change, F.lit(0))
    return lagged.select(*series, t, (grown / seconds).alias("rate"))


def rolling_sum(points: DataFrame, series: list[str], t: str, values: list[str], seconds: int) -> DataFrame:
    """For each point the sums over the ``seconds`` up to and with it (t within (t0 - seconds, t0]).

    Every point is sent to the block of its time and to the one after, as many rows as that, so windows
    are partitioned by (series, block of time) and a long series is spread over many tasks.
    """
    blk = F.floor(F.col(t) / max(seconds, 3600))
    own = F.struct(blk.alias("b"), F.lit(True).alias("own"))
    twice = points.withColumn("__x", F.explode(F.array(own, F.struct((blk + 1).alias("b"), F.lit(False).alias("own")))))
    w = Window.partitionBy(*series, "__x.b").orderBy(t).rangeBetween(-(seconds - 1), 0)
    return twice.select("*", *[F.sum(v).over(w).alias(f"{v}_sum") for v in values]).filter("__x.own").drop("__x")


def alert_hold(points: DataFrame, series: list[str], t: str, condition: Column, hold: int) -> DataFrame:
    """Points at which a condition has held for ``hold`` seconds without a break, points being integer times.

    A point fires if no point within (t - hold, t] fails and the series has one at or before t - hold. The
    marked points are written once, as they are read for the windows and for the starts of the series.
    """
    marked = checkpoint(points.select(*series, t, F.when(condition, F.lit(0)).otherwise(F.lit(1)).alias("__bad")), "marked")
    rolled = rolling_sum(marked, series, t, ["__bad"], hold + 1)
    firsts = F.min(t).alias("__first")
    joined = rolled.join(marked.groupBy(*series).agg(firsts), series) if series else rolled.withColumn("__first", marked.agg(firsts).scalar())
    return joined.select(*series, t, ((F.col("__bad_sum") == 0) & (F.col(t) - F.col("__first") >= hold)).alias("firing"))


def rolling_history(points: DataFrame, series: list[str], t: str, n: int) -> DataFrame:
    """The last ``n`` points of each series; limited before the shuffle too."""
    return points.withColumn("__rn", F.row_number().over(Window.partitionBy(*series).orderBy(F.desc(t)))).filter(F.col("__rn") <= n).drop("__rn")


def error_ratio(counters: DataFrame) -> DataFrame:
    """One row: errors over all requests (0 without requests), from counters by operation and status."""
    bad, every = F.sum(F.when(F.col("status") == "error", F.col("n"))), F.sum("n")
    return counters.agg(F.coalesce(bad, F.lit(0)).alias("errors"), F.coalesce(every, F.lit(0)).alias("requests"), F.coalesce(bad / every, F.lit(0.0)).alias("ratio"))


def phase_timings(samples: DataFrame, phase: str, ns: str) -> DataFrame:
    """Timings by phase: count, mean, largest, and percentiles by the floored index, in nanoseconds. Null times are left out."""
    known = samples.filter(F.col(ns).isNotNull())
    base = known.groupBy(phase).agg(F.count(F.lit(1)).alias("n"), F.avg(ns).alias("mean_ns"), F.max(ns).alias("max_ns"))
    weights = checkpoint(compress(known, [phase], ns), "weights")
    found = weighted_percentiles(weights, [phase], ns, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, _value_block(weights, [phase], ns), rank=floor_rank)
    joined = base.alias("l").join(found.alias("r"), F.col(f"l.{phase}").eqNullSafe(F.col(f"r.{phase}")))
    return joined.select("l.*", "r.p50", "r.p95", "r.p99")
