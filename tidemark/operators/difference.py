"""Differences between two copies of a dataset, field by field."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.assignment import assign, assign_patterns, weighted
from ..session import checkpoint
from .skew import distributed_rank

_SLOTS = 10_000
ONLY_LEFT, ONLY_RIGHT, CHANGED = "only_left", "only_right", "changed"

_PAIRS = T.ArrayType(T.StructType([T.StructField("l", T.IntegerType()), T.StructField("r", T.IntegerType())]))


@F.pandas_udf(_PAIRS)
def _pair_up(sides: pd.Series, digests: pd.Series) -> pd.Series:
    """Positions of the left and right rows that belong together; -1 where a row has no partner."""
    import numpy as np

    out = []
    for side, digest in zip(sides, digests):
        left = [i for i, s in enumerate(side) if s > 0]
        right = [i for i, s in enumerate(side) if s < 0]
        pairs, free_l, free_r = [], set(left), set(right)
        if left and right:
            a = np.array([list(digest[i]) for i in left], dtype=object)
            b = np.array([list(digest[i]) for i in right], dtype=object)
            cost = sum((a[:, None, f] != b[None, :, f]).astype(int) for f in range(a.shape[1]))
            for i, j in assign(weighted(cost, min(len(left), len(right)), a.shape[1])):
                pairs.append({"l": left[i], "r": right[j]})
                free_l.discard(left[i])
                free_r.discard(right[j])
        pairs += [{"l": i, "r": -1} for i in sorted(free_l)] + [{"l": -1, "r": j} for j in sorted(free_r)]
        out.append(pairs)
    return pd.Series(out)


def diff_copies(left: DataFrame, right: DataFrame, key: str, fields: list[str], exact_limit: int = 128) -> DataFrame:
    """Rows missing on either side and rows whose fields differ.

    Result: ``key``, ``kind`` (only_left, only_right, changed), ``diff`` (names of the differing fields, in
    the order of ``fields``; all of them for a row without partner), ``l`` and ``r`` (structs of the
    fields, null on the missing side). Equal rows give nothing.

    1. Identical rows cancel by multiplicity: one grouping by (key, fields) with signed counts.
    2. Leftovers of a key are paired so that the total number of differing fields is least; rows beyond the
       smaller side stay unpaired. Of pairings with equal totals one of the least sum of squares is reported.
    3. Up to ``exact_limit`` leftover rows of a key are gathered and solved on their cost matrix. Of a key with
       more, only the counted patterns of agreement are, which gives the same total; its rows stay spread.

    Null equals null and differs from everything else, for keys and fields alike. Empty inputs are copies
    without rows. Other columns of the inputs are pruned. Map columns must be encoded by the caller.
    """
    if not fields:
        raise ValueError("no fields to compare")
    pos = {f: f"__f{i}" for i, f in enumerate(fields)}

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(F.col(key).alias("__k"), *[F.col(f).alias(c) for f, c in pos.items()], F.lit(sign).cast("long").alias("__s"))

    cols = list(pos.values())
    net = signed(left, 1).unionByName(signed(right, -1)).groupBy("__k", *cols).agg(F.sum("__s").alias("__net")).filter("__net <> 0")
    # what is left is read several times below and is small against the copies: it is written once
    net = checkpoint(net, "leftovers")
    sizes = net.groupBy("__k").agg(F.sum(F.abs("__net")).alias("__size"))
    huge = sizes.filter(F.col("__size") > exact_limit).select(F.col("__k").alias("__hk"))
    any_huge = not huge.isEmpty()
    row = F.struct(*[F.col(c).alias(f) for f, c in pos.items()])

    same_key = F.col("__k").eqNullSafe(F.col("__hk"))
    few = (
        (net.join(huge, same_key, "left_anti") if any_huge else net)
        .groupBy("__k")
        .agg(F.array_sort(F.collect_list(F.struct("__net", row.alias("__row")))).alias("__rows"))
        # a row that is there n times more often on one side stands n times; the sum is bounded by exact_limit
        .select("__k", F.expr("flatten(transform(__rows, x -> array_repeat(named_struct('s', cast(signum(x.__net) as int), 'row', x.__row), cast(abs(x.__net) as int))))").alias("__rows"))
    )
    one_each = (F.size("__rows") == 2) & (F.col("__rows")[0]["s"] != F.col("__rows")[1]["s"])
    one_side = F.forall("__rows", lambda x: x["s"] == F.col("__rows")[0]["s"])
    digests = F.transform("__rows", lambda x: F.array(*[F.when(x["row"][f].isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), _text(x["row"][f], left.schema[f].dataType))) for f in fields]))
    easy = few.filter(one_each | one_side).select(
        "__k",
        F.explode(
            F.when(one_each, F.array(F.struct(
                F.filter("__rows", lambda x: x["s"] > 0)[0]["row"].alias("l"),
                F.filter("__rows", lambda x: x["s"] < 0)[0]["row"].alias("r"))))
            .otherwise(F.transform("__rows", lambda x: F.struct(F.when(x["s"] > 0, x["row"]).alias("l"), F.when(x["s"] < 0, x["row"]).alias("r"))))
        ).alias("__p"),
    )
    hard = few.filter(~(one_each | one_side)).select("__k", "__rows", F.explode(_pair_up(F.transform("__rows", lambda x: x["s"]), digests)).alias("__i"))
    hard = hard.select("__k", F.struct(
        F.when(F.col("__i.l") >= 0, F.get("__rows", F.greatest(F.col("__i.l"), F.lit(0)))["row"]).alias("l"),
        F.when(F.col("__i.r") >= 0, F.get("__rows", F.greatest(F.col("__i.r"), F.lit(0)))["row"]).alias("r"),
    ).alias("__p"))

    paired = easy.unionByName(hard)
    if any_huge:
        numbered = checkpoint(huge.withColumn("__h", F.monotonically_increasing_id()), "huge")
        paired = paired.unionByName(_by_patterns(net.join(numbered, same_key).drop("__hk"), pos))
    differs = F.filter(F.array(*[F.when(F.col("__p.l").isNull() | F.col("__p.r").isNull() | ~F.col(f"__p.l.{f}").eqNullSafe(F.col(f"__p.r.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    kind = F.when(F.col("__p.r").isNull(), ONLY_LEFT).when(F.col("__p.l").isNull(), ONLY_RIGHT).otherwise(CHANGED)
    return paired.select(F.col("__k").alias(key), kind.alias("kind"), differs.alias("diff"), F.col("__p.l").alias("l"), F.col("__p.r").alias("r"))


def _text(column, kind: T.DataType):
    return F.base64(column) if isinstance(kind, T.BinaryType) else F.to_json(F.struct(column.alias("v"))) if isinstance(kind, (T.StructType, T.ArrayType)) else column.cast("string")


def _by_patterns(net: DataFrame, pos: dict[str, str]) -> DataFrame:
    """Pairs of least total cost of keys with very many leftovers (``__h`` numbers the key).

    A value that the key has on one side only agrees with nothing, so all such values of a field are alike:
    rows become patterns of tokens. One task solves the counted patterns of a key; the rows themselves are
    numbered within their pattern and meet by number, spread over all tasks.
    """
    cols = list(pos.values())
    tokens = [f"__t{i}" for i in range(len(cols))]
    row = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(f) for f, c in pos.items()])
    net = net.withColumn("__side", F.signum("__net").cast("int"))
    rows = net
    for c, t in zip(cols, tokens):
        both = net.groupBy("__h", c).agg(F.countDistinct("__side").alias("__n")).filter("__n = 2").select("__h", c)
        known = checkpoint(distributed_rank(both, ["__h"], [F.col(c)], t), "tokens")
        on = (F.col("a.__h") == F.col("b.__h")) & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        rows = rows.alias("a").join(known.alias("b"), on, "left").select("a.*", F.coalesce(F.col(f"b.{t}"), F.lit(-1)).cast("long").alias(t))
    rows = checkpoint(rows, "patterns")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(tokens)
        a, b = pdf[pdf["__side"] > 0], pdf[pdf["__side"] < 0]
        left, right = a[tokens].to_numpy(), b[tokens].to_numpy()
        used_l, used_r, pairs, out = [0] * len(a), [0] * len(b), 0, []
        for i, j, n in assign_patterns(left, a["__n"].to_numpy(), right, b["__n"].to_numpy()):
            while n:
                step = min(n, _SLOTS)  # what one row is exploded into below
                out.append((1, *left[i], used_l[i], pairs, step))
                out.append((-1, *right[j], used_r[j], pairs, step))
                used_l[i], used_r[j], pairs, n = used_l[i] + step, used_r[j] + step, pairs + step, n - step
        got = pd.DataFrame(out, columns=["__side", *tokens, "__from", "__pair", "__n"])
        got.insert(0, "__h", pdf["__h"].iloc[0])
        return got

    counts = rows.groupBy("__h", "__side", *tokens).agg(F.sum(F.abs("__net")).alias("__n"))
    slots = counts.groupBy("__h").applyInPandas(solve, ", ".join(f"{c} {'int' if c == '__side' else 'long'}" for c in ["__h", "__side", *tokens, "__from", "__pair", "__n"]))
    slots = slots.withColumn("__i", F.explode(F.expr("sequence(0L, __n - 1)")))
    slots = slots.select("__h", "__side", *tokens, (F.col("__from") + F.col("__i") + 1).alias("__rank"), (F.col("__pair") + F.col("__i")).alias("__pair"))
    # a row that is there very often is cut into ranges of copies, which spread over the tasks; its
    # copies get a number of their own (__u), so that ranks are the same however often they are computed
    ranges = rows.withColumn("__c", F.explode(F.expr(f"sequence(0L, (abs(__net) - 1) div {_SLOTS})"))).repartition("__h", *cols, "__c")
    copies = ranges.select("__h", "__k", "__side", *cols, *tokens, F.explode(F.expr(f"sequence(__c * {_SLOTS} + 1, least((__c + 1) * {_SLOTS}, abs(__net)))")).alias("__u"))
    alike = ["__h", "__side", *tokens]
    ranked = distributed_rank(copies, alike, [F.col(c) for c in [*cols, "__u"]], "__rank").join(slots, [*alike, "__rank"], "left")
    ranked = checkpoint(ranked.select("__h", "__k", "__side", *cols, "__pair"), "pairs")
    a, b = ranked.filter("__side > 0").alias("a"), ranked.filter("__side < 0").alias("b")
    # a row without partner has a null __pair and meets nothing
    paired = a.join(b, (F.col("a.__h") == F.col("b.__h")) & (F.col("a.__pair") == F.col("b.__pair")))
    none = F.lit(None).cast(T.StructType([T.StructField(f, net.schema[c].dataType) for f, c in pos.items()]))
    return reduce(DataFrame.unionByName, [
        paired.select(F.col("a.__k").alias("__k"), F.struct(row("a").alias("l"), row("b").alias("r")).alias("__p")),
        a.filter("__pair is null").select("__k", F.struct(row("a").alias("l"), none.alias("r")).alias("__p")),
        b.filter("__pair is null").select("__k", F.struct(none.alias("l"), row("b").alias("r")).alias("__p")),
    ])
