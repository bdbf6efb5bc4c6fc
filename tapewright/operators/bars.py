"""Ticks to bars, bars to wider bars, and per-period ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import timecols as tc

c = F.col
BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume", "session", "minute"]


def tick_order(micros: Column, tick_id: Column) -> Column:
    """(time, id) as one number, so first/last stay in hash aggregation."""
    return micros.cast("decimal(17,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + tick_id.cast("decimal(19,0)")


def bars_from_ticks(ticks: DataFrame, width: int, anchor: int = tc.RTH_OPEN) -> DataFrame:
    """Session-anchored OHLCV bars; volume is the tick count.

    ticks: symbol, ts (UTC wall clock), price, id. One partially aggregated
    shuffle, so a symbol holding most ticks costs a few rows per task.
    """
    ny = tc.to_ny(F.col("ts"))
    keyed = ticks.select(
        "symbol",
        ny.cast("date").alias("session"),
        tc.bucket_index(tc.minute_of_day(ny), width, anchor).alias("bucket"),
        tick_order(tc.epoch_micros(F.col("ts")), F.col("id")).alias("at"),
        F.col("price"),
    )
    bars = keyed.groupBy("symbol", "session", "bucket").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return _stamp(bars.withColumn("session", c("session").cast("string")), width, anchor)


def resample_bars(bars: DataFrame, width: int, anchor: int = tc.RTH_OPEN) -> DataFrame:
    """Wider bars on the same session grid; ts is the bucket's left edge."""
    if width <= 0:
        raise ValueError(f"bar width must be positive: {width}")
    keyed = bars.withColumn("bucket", tc.bucket_index(F.col("minute"), width, anchor))
    wide = keyed.groupBy("symbol", "session", "bucket").agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    )
    return _stamp(wide, width, anchor)


def _stamp(bars: DataFrame, width: int, anchor: int) -> DataFrame:
    left = tc.bucket_start(F.col("session"), F.col("bucket"), width, anchor)
    minute = F.pmod(F.col("bucket") * width + anchor, F.lit(1440))
    return bars.withColumns({"ts": left, "minute": minute.cast("int")}).select(*BAR_COLUMNS)


def infer_timeframe(bars: DataFrame) -> DataFrame:
    """Modal positive gap in minutes per symbol; the gap seen first wins a tie.

    Gaps are counted inside sessions and between the edges of neighbouring
    sessions, so the step never windows a whole symbol.
    """
    in_day = Window.partitionBy("symbol", "session").orderBy("ts")
    inner = bars.select("symbol", "ts", (F.col("ts") - F.lag("ts").over(in_day)).alias("gap"))
    edges = bars.groupBy("symbol", "session").agg(F.min("ts").alias("ts"), F.max("ts").alias("last_ts"))
    by_day = Window.partitionBy("symbol").orderBy("session")
    outer = edges.select("symbol", "ts", (F.col("ts") - F.lag("last_ts").over(by_day)).alias("gap"))
    gaps = inner.unionByName(outer).withColumn("gap", F.floor(F.col("gap") / 60).cast("long")).filter("gap > 0")
    counts = gaps.groupBy("symbol", "gap").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))
    best = F.max_by("gap", F.struct(F.col("n"), -F.col("first_ts")))
    return counts.groupBy("symbol").agg(best.alias("timeframe"))


def period_ranges(bars: DataFrame, lag: int = 1) -> DataFrame:
    """Previous day and previous ISO week high/low per (symbol, session).

    The lag counts held periods, not calendar ones.
    """
    if lag < 1:
        raise ValueError(f"lag must be at least 1: {lag}")
    day = F.col("session").cast("date")
    # The Thursday of a date's week decides its ISO year.
    thursday = F.date_add(F.trunc(day, "week"), 3)
    days = bars.groupBy("symbol", "session").agg(F.max("high").alias("dh"), F.min("low").alias("dl"))
    days = days.withColumn("week", F.year(thursday) * 100 + F.weekofyear(day))
    by_day = Window.partitionBy("symbol").orderBy("session")
    by_week = Window.partitionBy("symbol").orderBy("week")
    weeks = days.groupBy("symbol", "week").agg(F.max("dh").alias("wh"), F.min("dl").alias("wl")).select(
        "symbol", "week", F.lag("wh", lag).over(by_week).alias("pwh"), F.lag("wl", lag).over(by_week).alias("pwl"))
    out = days.select(
        "symbol", "session", "week", F.lag("dh", lag).over(by_day).alias("pdh"), F.lag("dl", lag).over(by_day).alias("pdl"))
    return out.join(weeks, ["symbol", "week"]).drop("week")


def with_period_ranges(bars: DataFrame, lag: int = 1) -> DataFrame:
    return bars.join(period_ranges(bars, lag), ["symbol", "session"])


def prior_sessions(bars: DataFrame, day: str, days: int) -> DataFrame:
    """All bars of the held sessions just before a day, per symbol.

    Empty where the day itself is not held.
    """
    held = bars.select("symbol", "session").distinct()
    ranked = held.withColumn("rank", F.dense_rank().over(Window.partitionBy("symbol").orderBy("session")))
    here = ranked.filter(F.col("session") == day).select("symbol", F.col("rank").alias("at"))
    wanted = ranked.join(here, "symbol").filter(
        (F.col("rank") >= F.col("at") - days) & (F.col("rank") < F.col("at"))).select("symbol", "session")
    return bars.join(wanted, ["symbol", "session"], "left_semi")


def entry_bars(bars: DataFrame, window: str) -> DataFrame:
    """Bars inside the window, numbered inside their session."""
    inside = bars.filter(tc.in_session(F.col("minute"), window))
    w = Window.partitionBy("symbol", "session").orderBy("ts")
    return inside.withColumn("entry_no", F.row_number().over(w))


def missing_volume_flag(bars: DataFrame) -> DataFrame:
    """Whole-series flag per symbol: does the feed carry volume at all?"""
    return bars.groupBy("symbol").agg(F.bool_or(F.col("volume") > 0).alias("has_volume"))


def concat_sessions(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
