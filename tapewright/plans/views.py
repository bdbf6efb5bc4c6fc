"""Market views on the driver's tables, in Spark and as check expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import bars as ob
from tapewright.operators import order
from tapewright.plans.registry import held, part
from tapewright.session import cut_lineage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("id"))


def bars30(spark: SparkSession, sf: str) -> DataFrame:
    return ob.bars_from_ticks(ticks(spark, sf), 30)


def bars15(spark: SparkSession, sf: str) -> DataFrame:
    return ob.bars_from_ticks(ticks(spark, sf), 15)


def bar_table(spark: SparkSession, sf: str) -> DataFrame:
    """bars30 built once per query, for plans that read the bars repeatedly."""
    return held("bars30", spark, sf, lambda: cut_lineage(bars30(spark, sf)))


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    return order.with_index(bar_table(spark, sf))


def daily_oc(spark: SparkSession, sf: str) -> DataFrame:
    """One open and close per order date."""
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).alias("prints"))


def panel(spark: SparkSession, sf: str, keep: str | None = None) -> DataFrame:
    """Month-end price per supplier: mean unit price of the month."""
    lines = table(spark, sf, "lineitem")
    if keep:
        lines = lines.filter(keep)
    # Texts are written once per group, not per line; a key's first six characters decide its symbol.
    key = F.substring(F.col("l_suppkey").cast("string"), 1, 6)
    priced = lines.select(key.alias("key"), F.trunc(F.to_date("l_shipdate"), "month").alias("first"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    # Rounded once so that both engines rank on the same numbers.
    close = priced.groupBy("key", "first").agg(F.round(F.avg("px"), 7).alias("close"))
    return close.select(F.concat(F.lit("S"), F.lpad("key", 6, "0")).alias("symbol"), F.date_format("first", "yyyy-MM").alias("month"), "close")


def panel_table(spark: SparkSession, sf: str) -> DataFrame:
    """The panel built once per query."""
    return held("panel", spark, sf, lambda: cut_lineage(panel(spark, sf)))


def _bars_sql(width: int) -> str:
    return f"""
    SELECT symbol,
           CAST(epoch((CAST(d AS TIMESTAMP) + to_minutes(CAST(570 + b * {width} AS BIGINT))) AT TIME ZONE 'America/New_York') AS BIGINT) AS ts,
           open, high, low, close, volume, CAST(d AS VARCHAR) AS session,
           CAST((570 + b * {width} + 1440) % 1440 AS BIGINT) AS minute
    FROM (SELECT symbol, CAST(ny AS DATE) AS d,
                 CAST(floor((hour(ny) * 60 + minute(ny) - 570) / {float(width)}) AS BIGINT) AS b,
                 first(price ORDER BY ts, id) AS open, max(price) AS high, min(price) AS low,
                 last(price ORDER BY ts, id) AS close, CAST(count(*) AS DOUBLE) AS volume
          FROM ny_ticks GROUP BY ALL)"""


part("ny_ticks", """
    SELECT event_type AS symbol, ts, value AS price, event_id AS id,
           (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny
    FROM events""")
part("bars", _bars_sql(30))
part("bars_15", _bars_sql(15))
part("b", """
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session, ts) - 1 AS idx,
           row_number() OVER (PARTITION BY symbol, session ORDER BY ts) AS day_pos,
           dense_rank() OVER (PARTITION BY symbol ORDER BY session) AS session_no
    FROM bars""")
part("trs", """
    SELECT *, CASE WHEN idx = 0 THEN high - low ELSE
           greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY idx)),
                    abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY idx))) END AS tr
    FROM b""")
part("seeds14", "SELECT symbol, avg(tr) AS seed FROM trs WHERE idx < 14 GROUP BY symbol HAVING count(*) = 14")
part("atr_walk", """
    SELECT symbol, CAST(13 AS BIGINT) AS idx, seed AS atr FROM seeds14
    UNION ALL
    SELECT w.symbol, w.idx + 1, t.tr * (1.0::DOUBLE / 14) + (1.0::DOUBLE - 1.0::DOUBLE / 14) * w.atr
    FROM atr_walk w JOIN trs t ON t.symbol = w.symbol AND t.idx = w.idx + 1""")
part("ba", "SELECT b.*, a.atr FROM b LEFT JOIN atr_walk a ON a.symbol = b.symbol AND a.idx = b.idx")
part("daily", """
    SELECT CAST(o_orderdate AS DATE) AS day, first(o_totalprice ORDER BY o_orderkey) AS open,
           last(o_totalprice ORDER BY o_orderkey) AS close, count(*) AS prints
    FROM orders GROUP BY 1""")


def _panel_sql(where: str = "") -> str:
    return f"""
    SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, strftime(l_shipdate, '%Y-%m') AS month,
           round(avg(l_extendedprice / l_quantity), 7) AS close
    FROM lineitem {where} GROUP BY 1, 2"""


part("pnl", _panel_sql())
part("pnl_odd", _panel_sql("WHERE l_linenumber % 2 = 1"))
part("pnl_even", _panel_sql("WHERE l_linenumber % 2 = 0"))
