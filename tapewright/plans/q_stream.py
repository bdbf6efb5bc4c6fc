"""Queries: the same tables read as streams, run to their end."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from tapewright.operators.config import ModelConfig
from tapewright.plans import views
from tapewright.plans.q_bars import BARS_OUT, tidy
from tapewright.plans.registry import query
from tapewright.session import shared_dir
from tapewright.streaming import bars as sb
from tapewright.streaming import signals as ss

c = F.col


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tick_stream(spark, sf):
    schema = views.table(spark, sf, "events").schema
    raw = sb.read_tick_stream(spark, sf, schema, "events.parquet")
    return raw.select(c("event_type").alias("symbol"), "ts", c("value").alias("price"), c("event_id").alias("id"))


@query("stream_bars", f"SELECT {BARS_OUT} FROM bars WHERE ts <= (SELECT max(ts) FROM bars) - 1800")
def stream_bars(spark, sf):
    """Half-hour bars that the watermark has closed."""
    out = _place(spark, "bars")
    bars = sb.stream_bars(tick_stream(spark, sf), 30)
    run = (bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", _place(spark, "state"))
           .outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    return tidy(spark.read.parquet(out).drop("bucket_start"))


LIVE = replace(ModelConfig(), traded_window="0930-1500", skip_first_minutes=30, max_signals_per_session=2)


@query("stream_signals", """
    SELECT symbol, ts, session, direction, CASE WHEN late IS NULL AND count(*) FILTER (WHERE late IS NULL) OVER (PARTITION BY symbol, session ORDER BY ts) > 2 THEN 'session_quota' ELSE late END AS rejection
    FROM (SELECT *, CASE WHEN NOT (minute >= 570 AND minute < 900) THEN 'outside_traded_window' WHEN minute < 600 THEN 'opening_noise' END AS late
          FROM (SELECT *, CAST(CASE WHEN close > c6 THEN 1 WHEN close < c6 THEN -1 ELSE 0 END AS BIGINT) AS direction FROM (SELECT *, lag(close, 6) OVER (PARTITION BY symbol, session ORDER BY ts) AS c6 FROM bars)))
    WHERE direction <> 0 AND ts <= (SELECT max(ts) FROM bars) - 1800""")
def stream_signals(spark, sf):
    """Momentum decisions on the half-hour bars that the watermark has closed."""
    out = _place(spark, "signals")
    ss.run(ss.stream_signals(sb.stream_bars(tick_stream(spark, sf), 30), LIVE), out, _place(spark, "state"))
    return tidy(spark.read.schema(ss.DECISION).parquet(out))
