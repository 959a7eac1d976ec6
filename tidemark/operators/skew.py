"""Work on keys of very uneven frequency.

``compress`` is the base of everything here: records are grouped by (key, value) first, with map-side
combine, so that a key holding a third of all rows reaches the second grouping as one row per distinct
value and partial sum, not as its records.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def compress(df: DataFrame, keys: list[str], value: str, weight: str = "weight") -> DataFrame:
    """Value-frequency compression: one row per distinct (keys, value) with its number of records.

    Null keys and null values form groups of their own. An empty input gives an empty result. Columns of
    the input beyond ``keys`` and ``value`` are pruned, whatever their names.
    """
    return df.select(*keys, value).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(weight))


def key_counts(compressed: DataFrame, keys: list[str], weight: str = "weight", out: str = "n") -> DataFrame:
    """Records per key out of compressed values."""
    return compressed.groupBy(*keys).agg(F.sum(weight).alias(out))


def heavy_keys(compressed: DataFrame, scope: str, key: str, percent: int, weight: str = "weight") -> DataFrame:
    """Keys with at least ``percent`` % of all records of their scope (exact, integer arithmetic).

    ``scope`` is a column, the name of a table, say; few scopes with most of the keys each are spread when the
    totals are joined. Records with a null or empty key count in the total and are never keys themselves. At most
    100/percent keys come out for a scope.
    """
    counts = checkpoint(key_counts(compressed, [scope, key], weight, "n"), "counts")  # a row per key, read three times
    totals = counts.groupBy(scope).agg(F.sum("n").alias("__total"))
    known = spread_join(counts.filter(F.col(key) != ""), totals, scope, [key])
    return known.filter(F.col("n") * 100 >= F.col("__total") * percent).select(scope, key, "n")


def key_profile(compressed: DataFrame, keys: list[str], value: str, weight: str = "weight") -> DataFrame:
    """Records, distinct values (nulls not counted), mode and its frequency for each key, all exact.

    The mode is the most frequent non-null value; of equally frequent ones the smallest. A key with null
    values only has 0 distinct values and a null mode.
    """
    w, v = F.col(weight), F.col(value)
    known = v.isNotNull()
    return compressed.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.count(v).alias("n_distinct"),
        F.min(F.when(known, F.struct((-w).alias("w"), v.alias("v")))).alias("__m"),
    ).select(*keys, "n", "n_distinct", F.col("__m.v").alias("mode"), F.coalesce(-F.col("__m.w"), F.lit(0)).alias("mode_n"))


def nearest_rank(n: Column, p: float) -> Column:
    """Rank (from 1) of a percentile: the least value that p of all values don't exceed."""
    return F.greatest(F.ceil(n * F.lit(float(p))), F.lit(1))


def scaled_rank(n: Column, p: float) -> Column:
    """Rank of index floor(n p), the last one at most."""
    return F.least(F.floor(n * F.lit(float(p))), n - 1) + 1


def floor_rank(n: Column, p: float) -> Column:
    """Rank of index floor((n - 1) p)."""
    return F.floor((n - 1) * F.lit(float(p))) + 1


def weighted_percentiles(compressed: DataFrame, keys: list[str], value: str, fractions: dict[str, float], bucket: Column | None = None, weight: str = "weight", rank=nearest_rank) -> DataFrame:
    """Percentiles of a numeric value for each key out of its compressed frequencies, exact by ``rank``.

    ``bucket`` is a monotone function of the value (by default blocks of 1024). Running sums are formed
    within (key, bucket) and offset by the sums of the lower buckets, so no task gets all values of a key.
    Null values are left out; a key without values has no row.
    """
    b = bucket if bucket is not None else F.floor(F.col(value) / 1024)
    base = compressed.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), b.alias("__b"), F.col(weight).alias("__w"))
    blocks = base.groupBy(*keys, "__b").agg(F.sum("__w").alias("__bw"))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "__b", F.coalesce(F.sum("__bw").over(before), F.lit(0)).alias("__before"), F.sum("__bw").over(per_key).alias("__n"))
    on = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__b"]])
    joined = base.alias("l").join(blocks.alias("r"), on).select(*[F.col(f"l.{k}").alias(k) for k in keys], "l.__b", "__v", "__w", "__before", "__n")
    run = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = joined.withColumn("__upto", F.col("__before") + F.sum("__w").over(run))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("__upto") >= rank(F.col("__n"), p), F.col("__v"))).alias(name) for name, p in fractions.items()])


def blocked_lag(df: DataFrame, series: list[str], order: str, value: str, block: Column, out: str) -> DataFrame:
    """The value of the row before in each series, without a task per series.

    ``block`` is a monotone function of ``order`` (an hour, say). Rows are numbered within (series, block);
    the first row of a block takes the last value of the nearest block before, found among one row per
    block. ``order`` should be unique within a series; of equal ones the lesser value comes first.
    """
    cut = df.withColumn("__blk", block)
    ends = cut.groupBy(*series, "__blk").agg(F.max(F.struct(order, value)).alias("__end"))
    ends = ends.withColumn("__prev", F.lag("__end").over(Window.partitionBy(*series).orderBy("__blk"))).select(*series, "__blk", F.col(f"__prev.{value}").alias("__carry"))
    on = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*series, "__blk"]])
    within = Window.partitionBy(*[F.col(f"l.{k}") for k in [*series, "__blk"]]).orderBy(f"l.{order}", f"l.{value}")
    joined = cut.alias("l").join(ends.alias("r"), on)
    first = F.row_number().over(within) == 1
    return joined.select("l.*", F.when(first, F.col("r.__carry")).otherwise(F.lag(f"l.{value}").over(within)).alias(out)).drop("__blk")


def distributed_rank(df: DataFrame, groups: list[str], order: list[Column], out: str, blocks: int = 64) -> DataFrame:
    """row_number within ``groups`` without putting a group into one task.

    Rows are spread over hash blocks; the rank within a block is offset by the sizes of the lower blocks.
    The order is total and repeatable but runs block by block. Two shuffles, on (groups, block).
    """
    spread = df.withColumn("__blk", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = spread.groupBy(*groups, "__blk").agg(F.count(F.lit(1)).alias("__c"))
    lower = Window.partitionBy(*groups).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__off", F.coalesce(F.sum("__c").over(lower), F.lit(0))).drop("__c")
    within = Window.partitionBy(*groups, "__blk").orderBy(*order)
    ranked = spread.withColumn("__rn", F.row_number().over(within)).alias("l")
    on = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*groups, "__blk"]])
    return ranked.join(sizes.alias("r"), on).select("l.*", (F.col("l.__rn") + F.col("r.__off")).alias(out)).drop("__blk", "__rn")


def _literal(value):
    return F.lit(bytes(value) if isinstance(value, bytearray) else value)


def hot_keys(df: DataFrame, key: str, hot_share: float = 0.01) -> list:
    """Literals of the keys with at least ``hot_share`` of all rows, counted exactly: at most 1/hot_share of them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    # the grouping is computed once: the total reads the same exchange
    least = F.greatest(F.lit(1), F.ceil(counts.agg(F.sum("__n")).scalar() * F.lit(float(hot_share))))
    return [_literal(r[0]) for r in counts.filter(F.col("__n") >= least).select(key).limit(math.ceil(1 / hot_share) + 1).collect() if r[0] is not None]


def spread_join(many: DataFrame, few: DataFrame, key: str, by: list[str], hot_share: float = 0.01, salts: int = 64) -> DataFrame:
    """Inner join on a key that may hold a large part of ``many`` and several rows of ``few``.

    Rows of ``many`` under a key with at least ``hot_share`` of them are cut into ``salts`` parts by a hash of the
    columns ``by``, and the rows of ``few`` under these keys, 1/hot_share at most, stand in every part. Nothing is
    broadcast and nothing dropped. ``many`` is read twice.
    """
    hot = hot_keys(many, key, hot_share)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    left = many.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(0).cast("int"))
    right = few.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__salt"]).drop("__salt")


def salted_join(many: DataFrame, one: DataFrame, key: str, hot_share: float = 0.01, how: str = "inner") -> DataFrame:
    """Join ``many`` with ``one`` (unique per key) although a key may hold a large part of ``many``.

    Keys with at least ``hot_share`` of ``many`` are counted exactly; there are at most 1/hot_share of
    them, so they and their rows of ``one`` are broadcast within that proven bound. All other keys hold
    less than ``hot_share`` each and go through an ordinary shuffled join. Nothing is dropped.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if not 0 < hot_share <= 1:
        raise ValueError("hot_share must lie in (0, 1]")
    hot = hot_keys(many, key, hot_share)
    if not hot:
        return many.join(one, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    warm = many.filter(~is_hot).join(one.filter(~is_hot), key, how)
    return warm.unionByName(many.filter(is_hot).join(F.broadcast(one.filter(is_hot)), key, how))
