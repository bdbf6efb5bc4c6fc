"""Data-quality gates, series differences and archive bookkeeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.operators.medians import exact_medians

c = F.col


def ohlc_quality_check(bars: DataFrame) -> DataFrame:
    """Per symbol: broken OHLC rows and the zero-volume verdict."""
    sound = (c("low") <= F.least("open", "close")) & (c("high") >= F.greatest("open", "close"))
    out = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.count_if(~sound).alias("broken"),
        F.count_if(c("volume") <= 0).alias("zero_volume"),
    )
    verdict = F.when(c("zero_volume") == c("bars"), "warn").when(c("zero_volume") > 0, "fail").otherwise("ok")
    return out.withColumn("volume_verdict", verdict)


def staleness_gate(age: Column, limit: float) -> Column:
    """An unknown age counts as stale."""
    return age.isNull() | (age > limit)


def series_diff(ours: DataFrame, theirs: DataFrame, keys: list[str], order: str, value: str, tol: float,
                label: str) -> DataFrame:
    """Row-wise tolerance compare; rows missing a value on a side are skipped."""
    joined = ours.select(*keys, c(value).alias("_a")).join(theirs.select(*keys, c(value).alias("_b")), keys)
    used = joined.filter(c("_a").isNotNull() & c("_b").isNotNull())
    off = F.abs(c("_a") - c("_b")) > tol
    out = used.agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(off).alias("mismatched"),
        F.min(F.when(off, c(order))).alias("first_mismatch"),
    )
    share = F.when(c("compared") > 0, 100.0 * c("mismatched") / c("compared"))
    return out.select(F.lit(label).alias("layer"), "compared", "mismatched", share.alias("differ_pct"), "first_mismatch")


def relative_layer(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """Median and worst relative error of one layer."""
    joined = ours.select(*keys, c(value).alias("_a")).join(theirs.select(*keys, c(value).alias("_b")), keys)
    errs = joined.select(sh.rel_err(c("_a"), c("_b")).alias("err")).filter("err IS NOT NULL")
    totals = errs.agg(F.lit(label).alias("layer"), F.count("err").alias("compared"), F.max("err").alias("worst_err"))
    middle = exact_medians(errs.withColumn("layer", F.lit(label)), ["layer"], ["err"])
    return totals.join(middle, "layer", "left").select("layer", "compared", c("err").alias("median_err"), "worst_err")


def layered_diff(layers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, layers)


def signal_diff(left: DataFrame, right: DataFrame, keys: list[str], score_tol: float) -> DataFrame:
    """Full outer compare of two signal lists: one class per key.

    Both sides carry direction and score.
    """
    a = left.select(*keys, c("direction").alias("_da"), c("score").alias("_sa"), F.lit(True).alias("_ina"))
    b = right.select(*keys, c("direction").alias("_db"), c("score").alias("_sb"), F.lit(True).alias("_inb"))
    joined = a.join(b, keys, "full_outer")
    kind = (F.when(c("_inb").isNull(), "left_only")
            .when(c("_ina").isNull(), "right_only")
            .when(c("_da") != c("_db"), "wrong_direction")
            .when(sh.truthy(F.abs(c("_sa") - c("_sb")) > score_tol), "wrong_score")
            .otherwise("matched"))
    return joined.select(*keys, kind.alias("kind"))


def only_in_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def state_distribution(df: DataFrame, state: str, by: list[str]) -> DataFrame:
    """Counts of +1, -1 and 0 and whether the column ever leaves 0."""
    out = df.filter(c(state).isNotNull()).groupBy(*by).agg(
        F.count_if(c(state) > 0).alias("ups"), F.count_if(c(state) < 0).alias("downs"),
        F.count_if(c(state) == 0).alias("zeros"))
    return out.withColumn("never_set", (c("ups") + c("downs")) == 0)


def archive_coverage(files: DataFrame) -> DataFrame:
    """(series, day) per held file to count, first and last day."""
    return files.groupBy("series").agg(
        F.count_distinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def missing_days(held: DataFrame) -> DataFrame:
    """Weekdays inside each series' own range that are not held."""
    span = held.groupBy("series").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select("series", F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.filter(F.weekday("day") < 5).join(held.select("series", "day"), ["series", "day"], "left_anti")


def panel_overlap_check(old: DataFrame, new: DataFrame, key: str, date: str, value: str,
                        max_median_bp: float = 1.0, max_p95_bp: float = 10.0) -> DataFrame:
    """Per symbol, how far two versions of a panel differ on shared dates."""
    a = old.select(key, date, c(value).alias("_a"))
    b = new.select(key, date, c(value).alias("_b"))
    diffs = a.join(b, [key, date]).filter(c("_b") > 0).select(
        key, (1e4 * F.abs(c("_a") - c("_b")) / c("_b")).alias("bp"))
    w = Window.partitionBy(key)
    ranked = diffs.select(key, "bp", F.row_number().over(w.orderBy("bp")).alias("rn"),
                          F.count(F.lit(1)).over(w).alias("n"))
    at = F.least(c("n") - 1, F.floor(0.95 * c("n"))) + 1
    out = ranked.groupBy(key).agg(
        F.max("n").alias("shared"), F.median("bp").alias("median_bp"),
        F.max(F.when(c("rn") == at, c("bp"))).alias("p95_bp"))
    return out.withColumn("accepted", ~((c("median_bp") > max_median_bp) | (c("p95_bp") > max_p95_bp)))


def panel_merge(old: DataFrame, new: DataFrame, key: str, date: str, value: str,
                verdict: DataFrame | None = None) -> DataFrame:
    """Upsert: new rows win; a refused symbol keeps only its old rows."""
    fresh = new
    if verdict is not None:
        refused = verdict.filter(~c("accepted")).select(key)
        fresh = new.join(refused, key, "left_anti")
    a = old.select(key, date, c(value).alias("_a"))
    b = fresh.select(key, date, c(value).alias("_b"))
    return a.join(b, [key, date], "full_outer").select(key, date, F.coalesce("_b", "_a").alias(value))


def dedup_latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(c(by).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
