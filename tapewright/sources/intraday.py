"""Raw one-minute JSON archives: one file per day, every value a string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions import timecols as tc
from tapewright.operators.bars import BAR_COLUMNS

c = F.col
RAW_FIELDS = ("start_time", "end_time", "market_time", "open", "high", "low", "close", "volume", "total_volume")
RAW_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in RAW_FIELDS])


def read_raw_intraday(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """All day files of one symbol; the file stem is the day."""
    raw = spark.read.schema(RAW_SCHEMA).option("multiLine", True).json(path)
    day = F.regexp_replace("_metadata.file_name", r"\.json$", "")
    return raw.select("*", F.lit(symbol).alias("symbol"), day.alias("day"))


def number(name: str) -> Column:
    """A string cell as a double; anything unreadable, NaN too, is NULL."""
    value = c(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def iso_epoch(name: str) -> Column:
    """'2026-08-12T13:30:00Z' to epoch seconds."""
    wall = F.replace(F.substring(name, 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    return tc.epoch_seconds(wall)


def intraday_bars(raw: DataFrame) -> DataFrame:
    """Regular-hours bars: a bad close drops the row, missing volume is zero."""
    rows = raw.filter(c("market_time") == "r").withColumns({
        "ts": iso_epoch("start_time"),
        **{n: number(n) for n in ("open", "high", "low", "close")},
        "volume": F.coalesce(number("volume"), F.lit(0.0)),
    }).filter(c("close").isNotNull())
    return tc.ny_time_columns(rows).select(*BAR_COLUMNS)


def read_intraday_json(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    return intraday_bars(read_raw_intraday(spark, path, symbol))


def day_prints(raw: DataFrame, least: int = 300) -> DataFrame:
    """Per full session: regular open and close, first pre and last post print."""
    at = iso_epoch("start_time")
    when = lambda m: F.when(c("market_time") == m, c("_at"))
    rows = raw.withColumn("_at", at).withColumns({"_o": number("open"), "_c": number("close")})
    # Wrapping the value keeps an unreadable first print from being skipped.
    first = lambda m: F.min_by(F.coalesce("_o", F.lit(float("nan"))), when(m))
    last = lambda m: F.max_by(F.coalesce("_c", F.lit(float("nan"))), when(m))
    days = rows.groupBy("symbol", "day").agg(
        F.count_if(c("market_time") == "r").alias("_n"), first("r").alias("rth_open"), last("r").alias("rth_close"),
        first("pr").alias("pre_first"), last("po").alias("post_last"))
    clean = days.filter(c("_n") >= least).withColumns({
        n: F.when(~F.isnan(n), c(n)) for n in ("rth_open", "rth_close", "pre_first", "post_last")}).drop("_n")
    return clean.filter((c("rth_open") > 0) & (c("rth_close") > 0)).withColumn("day", c("day").cast("date"))


def read_intraday_extended(spark: SparkSession, path: str, symbol: str, least: int = 300) -> DataFrame:
    return day_prints(read_raw_intraday(spark, path, symbol), least)
