"""Signals and refusal reasons from a stream of closed bars.

Each symbol keeps a ring of its session's last closes, the number of signals
that the session has had, and nothing else. A timer drops the state of a symbol
that has had no bar for a while. No orders, positions or results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewright.operators import score as sc
from tapewright.operators.config import ModelConfig

c = F.col
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISION = "symbol string, ts bigint, session string, direction int, rejection string"


class MomentumState(StatefulProcessor):
    """Sign of the move over the session's last `look_back` bars, refused as `refusal` says or by the session's quota."""

    def __init__(self, look_back: int, quota: int, keep_minutes: int):
        self.look_back, self.quota, self.keep_ms = look_back, quota, keep_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "session string, closes array<double>, signals int, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("ts")
        session, closes, signals, timer = self.state.get() if self.state.exists() else (None, [], 0, None)
        closes, out = list(closes), []
        for bar in bars.itertuples(index=False):
            if bar.session != session:
                session, closes, signals = bar.session, [], 0
            was = closes[0] if len(closes) == self.look_back else None
            closes = [*closes, float(bar.close)][-self.look_back :]
            direction = 0 if was is None else (bar.close > was) - (bar.close < was)
            if direction:
                reason = bar.refusal if isinstance(bar.refusal, str) else None
                if reason is None:
                    signals += 1
                    reason = "session_quota" if signals > self.quota else None
                out.append((key[0], int(bar.ts), session, int(direction), reason))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int(bars["ts"].max()) * 1000 + self.keep_ms
        self.handle.registerTimer(timer)
        self.state.update((session, closes, signals, timer))
        yield pd.DataFrame(out, columns=["symbol", "ts", "session", "direction", "rejection"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["symbol", "ts", "session", "direction", "rejection"])

    def close(self) -> None:
        pass


def stream_signals(bars: DataFrame, cfg: ModelConfig, look_back: int = 6, keep_minutes: int = 3 * 1440) -> DataFrame:
    """Decisions symbol, ts, session, direction, rejection (NULL: a signal) of a stream of closed bars.

    bars: as `stream_bars` gives them, with the watermark on bucket_start. Bars
    of a symbol arrive in order, because a bucket closes only after all
    earlier ones. A symbol silent for keep_minutes starts anew.
    """
    gates = bars.withColumn("blocked_by", F.lit(None).cast("string")).withColumn("refusal", sc.post_gates(cfg))
    rows = gates.select("symbol", "ts", "session", "close", "refusal", "bucket_start")
    return rows.groupBy("symbol").transformWithStateInPandas(
        MomentumState(look_back, cfg.max_signals_per_session, keep_minutes), DECISION, "append", "EventTime")


def run(decisions: DataFrame, out: str, checkpoint: str) -> None:
    """Everything there is, as Parquet; a later run with the same checkpoint goes on from there."""
    spark: SparkSession = decisions.sparkSession
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = (decisions.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                 .outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set(PROVIDER, was)
    query.awaitTermination()
