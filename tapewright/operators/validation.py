"""The gate between evidence and trading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
MIN_TRADES = 200
MIN_T = 2.5


def validation_failures() -> Column:
    """Every reason a record fails, as an array; empty means it passes."""
    return F.array_compact(F.array(
        F.when(c("n_trades") < MIN_TRADES, "too_few_trades"),
        F.when(~F.coalesce(c("mean_r") > 0, F.lit(False)), "mean_not_positive"),
        F.when(~F.coalesce(c("t_vs_null") >= MIN_T, F.lit(False)), "t_below_bar"),
        F.when(~F.coalesce(c("holdout_t") > 0, F.lit(False)), "holdout_sign"),
        F.when(~F.coalesce(c("survives_concentration"), F.lit(False)), "concentrated"),
    ))


def may_trade(configs: DataFrame, records: DataFrame) -> DataFrame:
    """Live settings against the record they were tested under.

    configs: signal, window, stop_atr, target_atr (NULL skips a check);
    records: the evidence plus the tested window, stop_atr and target_atr.
    """
    tested = records.select(
        "signal", "n_trades", "mean_r", "t_vs_null", "holdout_t", "survives_concentration",
        c("window").alias("_w"), c("stop_atr").alias("_s"), c("target_atr").alias("_t"), F.lit(True).alias("_known"))
    joined = configs.join(tested, "signal", "left")
    drift = F.array_compact(F.array(
        F.when(c("window") != c("_w"), "window_differs"),
        F.when(F.abs(c("stop_atr") - c("_s")) > 1e-9, "stop_differs"),
        F.when(F.abs(c("target_atr") - c("_t")) > 1e-9, "target_differs"),
    ))
    reasons = F.when(c("_known").isNull(), F.array(F.lit("no_record"))).otherwise(F.concat(validation_failures(), drift))
    return joined.withColumn("reasons", reasons).select(
        *configs.columns, (F.size("reasons") == 0).alias("allowed"), F.array_join("reasons", "; ").alias("reason"))
