"""CSV and JSON tables: chart exports, volatility series, panels, calendars."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions import timecols as tc
from tapewright.operators.bars import BAR_COLUMNS
from tapewright.operators.quality import dedup_latest
from tapewright.sources.intraday import number

c = F.col
REQUIRED = ("time", "open", "high", "low", "close")

# Names whose two price sources disagree, and the benchmark file.
EXCLUDED = ("FDX", "HON")
BENCHMARK = "_SPY"


def normalised_names(names: list[str]) -> list[str]:
    return [n.lstrip("﻿").strip().lower().replace(" ", "_") for n in names]


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def parse_bar_time(raw: Column) -> Column:
    """Epoch number or ISO time with an offset; anything else is an error."""
    text = F.trim(raw)
    epoch = text.try_cast("double").cast("long")
    offset = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    iso = F.unix_seconds(F.try_to_timestamp(text))
    complain = F.raise_error(F.concat(F.lit("time cell without a UTC offset: "), F.coalesce(text, F.lit("(empty)")))).cast("long")
    return F.when(epoch.isNotNull(), epoch).when(offset & iso.isNotNull(), iso).otherwise(complain)


def bar_export(raw: DataFrame, symbol: Column) -> DataFrame:
    """String columns of a chart export to bars plus its x_* series."""
    df = raw.toDF(*normalised_names(raw.columns))
    missing = [n for n in REQUIRED if n not in df.columns]
    if missing:
        raise ValueError(f"export lacks {missing}; it has {raw.columns}")
    volume = F.coalesce(number("volume"), F.lit(0.0)) if "volume" in df.columns else F.lit(0.0)
    extra = [n for n in df.columns if n.startswith("x_")]
    rows = df.select(
        symbol.alias("symbol"), parse_bar_time(c("time")).alias("ts"), *[number(n).alias(n) for n in REQUIRED[1:]],
        volume.alias("volume"), *[number(n).alias(n) for n in extra])
    rows = rows.dropna(subset=list(REQUIRED[1:]))
    return tc.ny_time_columns(rows).select(*BAR_COLUMNS, *extra)


def read_bar_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    out = bar_export(_csv(spark, path), F.lit(symbol))
    if out.isEmpty():
        raise ValueError(f"{path} holds no usable bars")
    return out


def signal_rows(export: DataFrame) -> DataFrame:
    """Exported rows that carry a signal; empty without a direction column."""
    wanted = ["x_sig_dir", "x_sig_score", "x_sig_stop", "x_sig_disp", "x_sig_type"]
    have = [c(n) if n in export.columns else F.lit(None).cast("double").alias(n) for n in wanted]
    rows = export.select("symbol", "ts", *have)
    return rows.filter(c("x_sig_dir").cast("int") != 0).withColumn("x_sig_dir", c("x_sig_dir").cast("int"))


def slash_date(raw: Column) -> Column:
    """M/D/YYYY to a date; unreadable cells are NULL."""
    return F.try_to_timestamp(F.trim(raw), F.lit("M/d/yyyy")).cast("date")


def vol_index(raw: DataFrame) -> DataFrame:
    """Dated value columns; rows without a readable date or value are skipped."""
    df = raw.toDF(*normalised_names(raw.columns))
    values = [n for n in df.columns if n not in ("date", "symbol")]
    keep = [c("symbol")] if "symbol" in df.columns else []
    rows = df.select(*keep, slash_date(c("date")).alias("day"), *[number(n).alias(n) for n in values])
    any_value = reduce(lambda a, b: a | b, [c(n).isNotNull() for n in values])
    return rows.filter(c("day").isNotNull() & any_value)


def close_series(index: DataFrame) -> DataFrame:
    """The close, else the row's only value."""
    values = [n for n in index.columns if n not in ("day", "symbol")]
    keep = [n for n in ("symbol", "day") if n in index.columns]
    present = F.array_compact(F.array(*[c(n) for n in values]))
    only = F.when(F.size(present) == 1, F.element_at(present, 1))
    close = F.coalesce("close", only) if "close" in values else only
    return index.select(*keep, close.alias("level")).filter(c("level").isNotNull())


def read_vol_index_csv(spark: SparkSession, path: str) -> DataFrame:
    return vol_index(_csv(spark, path))


def daily_panel(raw: DataFrame, excluded=EXCLUDED, benchmark: str = BENCHMARK) -> tuple[DataFrame, DataFrame]:
    """(symbol, date, close) strings to the universe and the benchmark."""
    rows = raw.select("symbol", c("date").try_cast("date").alias("day"), number("close").alias("close"))
    universe = rows.filter((c("symbol") != benchmark) & ~c("symbol").isin(*excluded))
    return universe, rows.filter(c("symbol") == benchmark)


def read_daily_panel(spark: SparkSession, folder: str, benchmark: str = BENCHMARK.lstrip("_")) -> tuple[DataFrame, DataFrame]:
    """One CSV per symbol; the file stem is the symbol.

    Spark treats files whose name starts with an underscore as hidden, so the
    benchmark's file goes by its plain name.
    """
    stem = F.regexp_replace("_metadata.file_name", r"\.csv$", "")
    raw = spark.read.option("header", True).csv(folder).select("date", "close", stem.alias("symbol"))
    return daily_panel(raw, benchmark=benchmark)


def spot_series(raw: DataFrame, value: str) -> DataFrame:
    rows = raw.select(*[n for n in raw.columns if n != value], number(value).alias("spot"))
    return rows.filter(c("spot").isNotNull())


def read_spot_csv(spark: SparkSession, path: str, value: str = "spy") -> DataFrame:
    raw = _csv(spark, path)
    return spot_series(raw.toDF(*normalised_names(raw.columns)), value)


def greek_series(raw: DataFrame) -> DataFrame:
    """Net gamma per date from overlapping files; the later file wins.

    raw: file, date, call_gamma, put_gamma as strings.
    """
    rows = raw.withColumn("net", number("call_gamma") + number("put_gamma")).filter(c("net").isNotNull())
    return dedup_latest(rows.select("date", "file", "net"), ["date"], "file").select("date", "net")


def read_greek_series(spark: SparkSession, folder: str) -> DataFrame:
    schema = "date string, call_gamma string, put_gamma string"
    raw = spark.read.schema(schema).option("multiLine", True).json(folder)
    return greek_series(raw.select("*", c("_metadata.file_name").alias("file")))


def event_calendar(raw: DataFrame) -> DataFrame:
    """(ts, name) rows; a missing name reads 'event'."""
    return raw.select(c("ts").cast("long").alias("event_ts"), F.coalesce("name", F.lit("event")).alias("name"))


def read_event_calendar(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of events; a missing file is an empty calendar."""
    schema = "ts long, name string"
    try:
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], schema)
    return event_calendar(raw)


SNAPSHOT_REQUIRED = ("spot", "gamma_flip", "call_wall", "put_wall", "net_gex")


def gamma_snapshots(raw: DataFrame) -> DataFrame:
    """Positioning snapshots; one with an unreadable required field is dropped."""
    rows = raw.select(
        "symbol", *[number(n).alias(n) for n in SNAPSHOT_REQUIRED], number("as_of_ts").cast("long").alias("as_of_ts"),
        number("control_node").alias("control_node"),
        F.coalesce(number("control_node_margin_pct"), F.lit(0.0)).alias("control_node_margin_pct"),
        F.coalesce("source", F.lit("file")).alias("source"))
    return rows.dropna(subset=[*SNAPSHOT_REQUIRED, "as_of_ts"])


def read_gamma_snapshots(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    names = [*SNAPSHOT_REQUIRED, "as_of_ts", "control_node", "control_node_margin_pct", "source"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return gamma_snapshots(raw.withColumn("symbol", F.lit(symbol)))


def trade_list(raw: DataFrame) -> DataFrame:
    """Two rows per trade number folded into one; both legs are needed."""
    df = raw.toDF(*normalised_names(raw.columns))
    entry = c("type").startswith("Entry")
    at = F.concat(c("date_and_time"), F.lit(":00")).try_cast("timestamp_ntz")
    leg = lambda cond, v: F.max(F.when(cond, v))
    out = df.groupBy(c("trade_number").cast("long").alias("trade_no")).agg(
        leg(entry, F.when(c("type").contains("long"), "long").otherwise("short")).alias("side"),
        leg(entry, at).alias("entry_time"), leg(entry, number("price_usd")).alias("entry_price"),
        leg(~entry, at).alias("exit_time"), leg(~entry, c("signal")).alias("exit_reason"),
        F.max(number("net_pnl_usd")).alias("pnl"), F.max(number("return_%")).alias("return_pct"),
        F.max(number("commission_usd")).alias("commission"), F.max(number("duration_(bars)")).cast("long").alias("bars"))
    return out.filter(c("entry_price").isNotNull() & c("exit_time").isNotNull())


def read_trade_list(spark: SparkSession, path: str) -> DataFrame:
    return trade_list(_csv(spark, path))


# --- decision journal and evidence registry -------------------------------------

JOURNAL_SCHEMA = T.StructType([
    T.StructField("ts", T.LongType()), T.StructField("wall_ts", T.DoubleType()), T.StructField("symbol", T.StringType()),
    T.StructField("signal", T.StringType()), T.StructField("direction", T.IntegerType()), T.StructField("action", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("shares", T.LongType()), T.StructField("stop", T.DoubleType()), T.StructField("target", T.DoubleType()),
    T.StructField("data_age_s", T.DoubleType()), T.StructField("context", T.MapType(T.StringType(), T.StringType())),
])


def write_journal(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("append").json(path)


def parse_journal(lines: DataFrame, text: str = "value") -> DataFrame:
    """JSON lines to decisions; blank and torn lines are skipped."""
    schema = T.StructType([*JOURNAL_SCHEMA.fields, T.StructField("_torn", T.StringType())])
    parsed = F.from_json(c(text), schema, {"columnNameOfCorruptRecord": "_torn"})
    kept = lines.filter(F.trim(text) != "").withColumn("_j", parsed)
    keep = [n for n in lines.columns if n != text]
    return kept.filter(c("_j").isNotNull() & c("_j._torn").isNull()).select(
        *keep, *[c("_j")[f.name].alias(f.name) for f in JOURNAL_SCHEMA.fields])


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return parse_journal(spark.read.text(path))


def journal_summary(decisions: DataFrame) -> DataFrame:
    mode, action = F.coalesce("mode", F.lit("?")), F.coalesce("action", F.lit("?"))
    return decisions.groupBy(F.concat_ws(":", mode, action).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def registry_latest(records: DataFrame, order: str) -> DataFrame:
    """The last record added per signal."""
    return dedup_latest(records, ["signal"], order)


def write_registry(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """(series, day) for every held day file: folder name and file stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("series"), F.regexp_replace(F.element_at(parts, -1), r"\.[a-z]+$", "").alias("day"))

