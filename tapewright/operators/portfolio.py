"""Weights, rebalance plans, sizing and admission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def equal_weight(picks: DataFrame, by: list[str], invested: float = 1.0) -> DataFrame:
    n = picks.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return picks.join(n, by).withColumn("weight", F.lit(invested) / c("_n")).drop("_n")


def position_target_union(positions: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Held and wanted symbols: held value and target weight, NULL when absent."""
    return positions.select(*by, "symbol", "value").join(targets.select(*by, "symbol", "weight"), [*by, "symbol"], "full_outer")


def check_targets(targets: DataFrame, by: list[str], allow_leverage: bool = False) -> DataFrame:
    """Targets unchanged; a weight that is NULL, NaN or negative, duplicate symbols or leverage raise when evaluated."""
    good = c("weight").isNotNull() & ~F.isnan("weight") & (c("weight") >= 0)
    targets = targets.withColumn("_bad", F.assert_true(good, "target weight is not a number of 0 or more")).filter(c("_bad").isNull()).drop("_bad")
    sums = targets.groupBy(*by).agg(
        F.sum("weight").alias("_w"), F.count("symbol").alias("_n"), F.count_distinct("symbol").alias("_d"))
    if not allow_leverage:
        sums = sums.withColumn("_lev", F.assert_true(c("_w") <= 1.0 + 1e-9, "target weights are leverage"))
        sums = sums.filter(c("_lev").isNull())
    sums = sums.withColumn("_dup", F.assert_true(c("_n") == c("_d"), "duplicate symbol in targets"))
    return targets.join(sums.filter(c("_dup").isNull()).select(*by), by)


def rebalance_plan(positions: DataFrame, targets: DataFrame, equity: DataFrame, by: list[str],
                   min_notional: float = 1.0, band: float = 0.005) -> DataFrame:
    """One row per symbol that differs: sells first, then buys, each by symbol.

    equity: by..., equity. Exits ignore the no-trade band.
    """
    both = position_target_union(positions, targets, by).join(equity, by)
    cur, want = F.coalesce("value", F.lit(0.0)), F.coalesce(c("weight") * c("equity"), F.lit(0.0))
    diff = want - cur
    small = F.abs(diff) < F.greatest(c("equity") * band, F.lit(min_notional))
    leave = c("weight").isNull()
    reason = (F.when((diff < 0) & leave, "exit").when(small, "inside_band").when(diff < 0, "trim")
              .when(cur == 0, "open").otherwise("add"))
    rows = both.withColumns({"_d": diff, "reason": reason}).filter(c("_d") != 0)
    side = F.when(c("_d") < 0, "sell").otherwise("buy")
    return rows.select(*by, "symbol", side.alias("side"), F.abs("_d").alias("notional"), "reason",
                       (c("reason") != "inside_band").alias("traded"))


def plan_order() -> list[Column]:
    """Sort keys of a plan: sells before buys, then by symbol."""
    return [F.when(c("side") == "sell", 0).otherwise(1), c("symbol")]


def turnover(plan: DataFrame, equity: DataFrame, by: list[str]) -> DataFrame:
    """Two-way traded value over equity."""
    gross = plan.filter("traded").groupBy(*by).agg(F.sum("notional").alias("gross"))
    return gross.join(equity, by).select(*by, "gross", F.when(c("equity") > 0, c("gross") / c("equity")).alias("turnover"))


def drift(positions: DataFrame, targets: DataFrame, equity: DataFrame, by: list[str]) -> DataFrame:
    both = position_target_union(positions, targets, by).join(equity, by)
    off = F.abs(F.coalesce(c("weight") * c("equity"), F.lit(0.0)) - F.coalesce("value", F.lit(0.0)))
    return both.groupBy(*by).agg((F.sum(off) / F.max("equity")).alias("drift"))


def target_book(picks: DataFrame, prices: DataFrame, equity: float, invested: float = 0.98) -> DataFrame:
    """Latest ranking to notionals with last price and whole-share cost share."""
    rows = equal_weight(picks, ["month"], invested).join(prices, ["symbol", "month"])
    return rows.select("symbol", "weight", (c("weight") * equity).alias("notional"), c("close").alias("last"),
                       (c("close") / equity).alias("share_of_equity"))


@dataclass(frozen=True)
class RiskLimits:
    """Percentages of the equity a session starts with."""

    max_daily_loss_pct: float = 3.0
    max_risk_per_trade_pct: float = 1.0
    max_trades_per_day: int = 4
    max_concurrent_positions: int = 2
    max_contracts_per_trade: int = 10
    max_stop_distance_pct: float = 1.5
    sizing_mode: str = "premium"


def trade_budget(limits: RiskLimits, equity: Column, realised: Column) -> Column:
    """Per-trade budget, capped by what the daily loss limit leaves."""
    left = equity * (limits.max_daily_loss_pct / 100.0) + F.least(realised, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(equity * (limits.max_risk_per_trade_pct / 100.0), left))


def position_size(limits: RiskLimits, budget: Column, price: Column, risk: Column, delta: Column | None = None) -> Column:
    """Contracts for a budget under premium or delta risk."""
    full = price * 100.0
    if limits.sizing_mode == "delta":
        per = F.when((delta > 0) & (delta <= 1), F.least(delta * risk * 100.0, full))
    else:
        per = full
    n = F.floor(budget / per)
    capped = F.greatest(F.lit(0), F.least(n, F.lit(limits.max_contracts_per_trade)))
    return F.when((budget > 0) & (price > 0) & (per > 0), capped).otherwise(0).cast("long")


def share_size(budget: Column, risk: Column, equity: Column, price: Column) -> Column:
    """Shares for a budget, never more than the equity can pay for."""
    return F.least(F.floor(budget / risk), F.floor(equity / price)).cast("long")


def trade_admission(rows: DataFrame, limits: RiskLimits) -> DataFrame:
    """First refusal reason per candidate, else its share count.

    rows: entry, stop, price, equity, realised, trades_today, open_positions.
    """
    risk = F.abs(c("entry") - c("stop"))
    left = c("equity") * (limits.max_daily_loss_pct / 100.0) + F.least(c("realised"), F.lit(0.0))
    sized = rows.withColumns({
        "_risk": risk, "_budget": trade_budget(limits, c("equity"), c("realised")), "_left": left,
        "_wide": 100.0 * risk / F.greatest(c("entry"), F.lit(1e-9))})
    sized = sized.withColumn("_shares", F.when((c("_risk") > 0) & (c("price") > 0),
                                               share_size(c("_budget"), c("_risk"), c("equity"), c("price"))))
    reason = F.coalesce(
        F.when(~F.coalesce(c("equity") > 0, F.lit(False)), "not_started"),
        F.when(c("trades_today") >= limits.max_trades_per_day, "trade_cap"),
        F.when(c("open_positions") >= limits.max_concurrent_positions, "position_cap"),
        F.when(c("_left") <= 0, "loss_budget_spent"),
        F.when(~F.coalesce(c("price") > 0, F.lit(False)), "no_price"),
        F.when(c("_wide") > limits.max_stop_distance_pct, "stop_too_wide"),
        F.when(~F.coalesce(c("_risk") > 0, F.lit(False)), "no_stop"),
        F.when(c("_shares") < 1, "budget_too_small"),
    )
    return sized.withColumns({
        "refusal": reason, "shares": F.when(reason.isNull(), c("_shares")).otherwise(0).cast("long")}).drop(
        "_risk", "_budget", "_left", "_wide", "_shares")


def session_risk_ledger(trades: DataFrame, limits: RiskLimits, equity: float) -> DataFrame:
    """Walk each session's trades in order under the daily limits.

    trades: symbol, session, opened, closed (positions), risk, pnl_per_share.
    Adds nothing across sessions; a session's array is as long as its trades.
    """
    daily = equity * limits.max_daily_loss_pct / 100.0
    per_trade = equity * limits.max_risk_per_trade_pct / 100.0
    item = F.struct("opened", "closed", "risk", "pnl_per_share")
    days = trades.groupBy("symbol", "session").agg(F.sort_array(F.collect_list(item)).alias("t"))
    held = F.array().cast("array<struct<closed:bigint,pnl:double>>")
    rows = F.array().cast("array<struct<opened:bigint,shares:bigint,realised:double,verdict:string>>")
    start = F.struct(F.lit(0.0).alias("realised"), F.lit(0).alias("n"), F.lit(False).alias("halted"), held.alias("open"), rows.alias("rows"))

    def settle(acc, x):
        """Book the positions closed by the time this trade opens."""
        due = F.array_sort(F.filter(acc.open, lambda p: p.closed <= x.opened))
        booked = F.aggregate(due, F.struct(acc.realised.alias("realised"), acc.halted.alias("halted")), lambda s, p: F.struct(
            (s.realised + p.pnl).alias("realised"), (s.halted | (s.realised + p.pnl <= -daily)).alias("halted")))
        return F.struct(booked.realised.alias("realised"), acc.n.alias("n"), booked.halted.alias("halted"),
                        F.filter(acc.open, lambda p: p.closed > x.opened).alias("open"), acc.rows.alias("rows"))

    def admit(acc, x):
        left = F.lit(daily) + F.least(acc.realised, F.lit(0.0))
        budget = F.greatest(F.lit(0.0), F.least(F.lit(per_trade), left))
        shares = F.when(x.risk > 0, F.floor(budget / x.risk)).otherwise(0).cast("bigint")
        verdict = (F.when(acc.halted, "halted").when(acc.n >= limits.max_trades_per_day, "trade_cap")
                   .when(F.size(acc.open) >= limits.max_concurrent_positions, "position_cap").when(left <= 0, "loss_budget_spent")
                   .when(shares < 1, "budget_too_small").otherwise("open"))
        taken = verdict == "open"
        pnl = shares.cast("double") * x.pnl_per_share
        return F.struct(
            acc.realised.alias("realised"), (acc.n + taken.cast("int")).alias("n"), acc.halted.alias("halted"),
            F.when(taken, F.concat(acc.open, F.array(F.struct(x.closed.alias("closed"), pnl.alias("pnl"))))).otherwise(acc.open).alias("open"),
            F.concat(acc.rows, F.array(F.struct(x.opened.alias("opened"), F.when(taken, shares).otherwise(0).cast("bigint").alias("shares"),
                                                acc.realised.alias("realised"), verdict.alias("verdict")))).alias("rows"))

    walked = F.aggregate("t", start, lambda acc, x: admit(settle(acc, x), x))
    return days.select("symbol", "session", F.inline(walked["rows"]))
