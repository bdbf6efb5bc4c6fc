"""Exact ranks without a whole group in one task.

Keys fall into ordered buckets of nearly equal size on a log scale. Counts per
bucket, summed in bucket order, give each bucket's first rank; rows are numbered
inside their bucket only. All quantile cuts of a group follow from one rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.medians import SHIFT, _bucket

c = F.col


def with_rank(rows: DataFrame, by: list[str], key: str, tie: str, rank: str = "_rn", size: str = "_n") -> DataFrame:
    """Add the row's rank in its group by (key, tie), from 1, and the group's size.

    NULL keys come first, NaN last; NULL is a group. A group with one key in
    very many rows stays one bucket, ordered by the tie.
    """
    v = c(key).cast("double")
    marked = rows.withColumn("_u", F.when(v.isNull(), -2 * SHIFT).when(F.isnan(v), 2 * SHIFT).otherwise(_bucket(v)))
    counts = marked.groupBy(*by, "_u").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    named = {b: f"_g{i}" for i, b in enumerate(by)}
    starts = counts.select(*[c(b).alias(n) for b, n in named.items()], c("_u").alias("_gu"),
                           (F.sum("_c").over(group.orderBy("_u")) - c("_c")).alias("_start"), F.sum("_c").over(group).alias(size))
    same = reduce(lambda a, b: a & b, [c(b).eqNullSafe(c(n)) for b, n in named.items()], c("_u") == c("_gu"))
    inside = F.row_number().over(Window.partitionBy(*by, "_u").orderBy(key, tie))
    return marked.join(starts, same).withColumn(rank, inside + c("_start")).drop("_u", "_gu", "_start", *named.values())
