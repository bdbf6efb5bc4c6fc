"""Exact medians without a whole group in one task.

Values fall into ordered buckets of nearly equal size on a log scale; counts
per bucket tell which one or two hold the middle, and only their values, each
with its count, are ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Buckets per doubling, and a shift that keeps the bucket numbers of either sign apart.
FINE, SHIFT = 64, 200_000


def _bucket(v: Column) -> Column:
    """Rises with v."""
    size = F.floor(F.log2(F.abs(v)) * FINE) + SHIFT
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def exact_medians(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """One row per group of `by` (NULL is a group) that has a value: the median of each value column, NULLs and NaN left out."""
    named = [f"_b{i}" for i in range(len(by))]
    long = rows.select(*[c(b).alias(n) for b, n in zip(by, named)], F.inline(F.array(*[
        F.struct(F.lit(i).alias("_k"), c(v).cast("double").alias("_v")) for i, v in enumerate(values)])))
    long = long.filter(c("_v").isNotNull() & ~F.isnan("_v")).withColumn("_u", _bucket(c("_v")))
    key = [*named, "_k"]
    counts = long.groupBy(*key, "_u").agg(F.count(F.lit(1)).alias("_n"))
    ends = F.sum("_n").over(Window.partitionBy(*key).orderBy("_u"))
    total = F.sum("_n").over(Window.partitionBy(*key))
    placed = counts.withColumns({"_end": ends, "_lo": F.floor((total - 1) / 2), "_hi": F.floor(total / 2)}).withColumn("_start", c("_end") - c("_n"))
    holds = lambda rank, start, end: (c(start) <= c(rank)) & (c(rank) < c(end))
    middle = placed.filter(holds("_lo", "_start", "_end") | holds("_hi", "_start", "_end")).select(
        *[c(k).alias(f"m{k}") for k in (*key, "_u")], "_lo", "_hi", "_start")
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"m{k}")) for k in (*key, "_u")])
    inside = long.join(middle, same).groupBy(*key, "_u", "_lo", "_hi", "_start", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = c("_start") + F.sum("_n").over(Window.partitionBy(*key, "_u").orderBy("_v"))
    ranked = inside.withColumn("_to", upto).withColumn("_from", c("_to") - c("_n"))
    at = lambda rank: F.max(F.when(holds(rank, "_from", "_to"), c("_v")))
    found = ranked.groupBy(*key).agg((at("_lo") * 0.5 + at("_hi") * 0.5).alias("_m"))
    return found.groupBy(*[c(n).alias(b) for b, n in zip(by, named)]).agg(*[F.max(F.when(c("_k") == i, c("_m"))).alias(v) for i, v in enumerate(values)])
