"""Closed bars from a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions import timecols as tc
from tapewright.operators.bars import tick_order

c = F.col


def read_tick_stream(spark: SparkSession, folder: str, schema: T.StructType, files: str, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as an unbounded table."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger)
            .parquet(folder))


def stream_bars(ticks: DataFrame, width: int, anchor: int = tc.RTH_OPEN, delay: str = "30 minutes") -> DataFrame:
    """Bars of a tick stream (symbol, ts, price, id), one row per closed bar.

    The watermark sits on the bucket start, so append mode emits a bar only
    when it can no longer change. The delay must be positive, or the open
    bucket would close too early.
    """
    ny = tc.to_ny(c("ts"))
    keyed = ticks.select(
        "symbol", tc.iso_date(ny).alias("session"), tc.bucket_index(tc.minute_of_day(ny), width, anchor).alias("bucket"),
        tick_order(tc.epoch_micros(c("ts")), c("id")).alias("at"), "price")
    start = F.timestamp_seconds(tc.bucket_start(c("session"), c("bucket"), width, anchor))
    marked = keyed.withColumn("bucket_start", start).withWatermark("bucket_start", delay)
    bars = marked.groupBy("symbol", "session", "bucket", "bucket_start").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select(
        "symbol", F.unix_seconds("bucket_start").alias("ts"), "open", "high", "low", "close", "volume", "session",
        F.pmod(c("bucket") * width + anchor, F.lit(1440)).cast("int").alias("minute"), "bucket_start")


def late_ticks(ticks: DataFrame, bars: DataFrame, width: int, anchor: int = tc.RTH_OPEN) -> DataFrame:
    """Account of a stream's late ticks: symbol, ts (of the bar), late, for each bucket that ticks missed.

    ticks: the same source read as a table; bars: what the stream has written.
    A tick is late if its bucket's bar was written without it, or if its bucket
    is older than the newest bar and never had one. Both tables are summed by
    bucket before they meet.
    """
    ny = tc.to_ny(c("ts"))
    placed = ticks.select("symbol", tc.iso_date(ny).alias("session"), tc.bucket_index(tc.minute_of_day(ny), width, anchor).alias("bucket"))
    came = placed.groupBy("symbol", "session", "bucket").agg(F.count(F.lit(1)).alias("came")).select(
        "symbol", F.unix_seconds(F.timestamp_seconds(tc.bucket_start(c("session"), c("bucket"), width, anchor))).alias("ts"), "came")
    newest = bars.agg(F.max("ts").alias("newest"))
    counted = came.join(bars.select("symbol", "ts", c("volume").cast("long").alias("seen")), ["symbol", "ts"], "left").join(F.broadcast(newest), c("ts") <= c("newest"))
    return counted.select("symbol", "ts", (c("came") - F.coalesce("seen", F.lit(0))).alias("late")).filter("late > 0")
