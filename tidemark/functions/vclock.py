"""Vector clocks as MAP<STRING, BIGINT> columns. A node missing in a clock counts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, EQUAL, AFTER, CONCURRENT = "BEFORE", "EQUAL", "AFTER", "CONCURRENT"



def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.expr("cast(map() as map<string,bigint>)"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def increment(clock: Column, node: Column) -> Column:
    """The clock with one more at ``node``; a null clock starts empty."""
    return merge_with(clock, F.create_map(node, F.lit(1).cast("long")), lambda a, b: a + b)


def merge_with(a: Column, b: Column, how) -> Column:
    return F.map_zip_with(_or_empty(a), _or_empty(b), lambda k, x, y: how(_zero(x), _zero(y)))


def merge(a: Column, b: Column) -> Column:
    """Element-wise maximum."""
    return merge_with(a, b, lambda x, y: F.greatest(x, y))


def compare(a: Column, b: Column) -> Column:
    """BEFORE, EQUAL, AFTER or CONCURRENT; null is an empty clock."""
    signs = F.map_values(merge_with(a, b, lambda x, y: F.signum(x - y)))
    less, more = F.exists(signs, lambda s: s < 0), F.exists(signs, lambda s: s > 0)
    return F.when(less & more, CONCURRENT).when(less, BEFORE).when(more, AFTER).otherwise(EQUAL)


def compare_nullable(a: Column, b: Column) -> Column:
    """As ``compare``, but a missing clock is before any other, even an empty one."""
    return F.when(a.isNull() & b.isNull(), EQUAL).when(a.isNull(), BEFORE).when(b.isNull(), AFTER).otherwise(compare(a, b))


def is_zero(clock: Column) -> Column:
    return F.coalesce(F.cardinality(clock), F.lit(0)) == 0


def text(clock: Column) -> Column:
    """Canonical text of a clock, entries by node: ``a=1,b=2``; empty for a null or empty clock."""
    entries = F.array_sort(F.map_entries(_or_empty(clock)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def merge_all(clock: str, keys: list[str], df, out: str = "vc"):
    """Merged clock of each group: explode, maximum per node, and back to a map. Groups without entries keep an empty map."""
    node = df.select(*keys, F.explode_outer(clock).alias("__n", "__c")).groupBy(*keys, "__n").agg(F.max("__c").alias("__c"))
    pairs = F.collect_list(F.when(F.col("__n").isNotNull(), F.struct("__n", "__c")))  # one entry per node of the cluster
    return node.groupBy(*keys).agg(F.map_from_entries(F.array_sort(pairs)).alias(out))
