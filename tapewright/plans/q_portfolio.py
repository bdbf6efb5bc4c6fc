"""Queries: weights, rebalance plans, sizing and admission."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.operators import panel as pn
from tapewright.operators import portfolio as pf
from tapewright.plans import views
from tapewright.plans.q_bars import tidy
from tapewright.plans.q_signals import momentum_trades
from tapewright.plans.registry import R, part, query

c = F.col

# One book per nation: positive balances are held, the ten largest at most are wanted.
part("pos", "SELECT c_nationkey AS book, c_name AS symbol, c_acctbal AS value FROM customer WHERE c_acctbal > 0")
part("tgt", """
    SELECT book, symbol, 0.98 / n AS weight FROM (SELECT *, count(*) OVER (PARTITION BY book) AS n FROM (
      SELECT c_nationkey AS book, c_name AS symbol FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal % 1000 DESC, c_name) <= 10))""")
part("eqt", "SELECT book, sum(value) AS equity FROM pos GROUP BY book")
part("both_pt", """
    SELECT coalesce(p.book, t.book) AS book, coalesce(p.symbol, t.symbol) AS symbol, p.value, t.weight FROM pos p FULL JOIN tgt t ON p.book = t.book AND p.symbol = t.symbol""")
part("plan", """
    SELECT book, symbol, CASE WHEN d < 0 THEN 'sell' ELSE 'buy' END AS side, abs(d) AS notional,
      CASE WHEN d < 0 AND weight IS NULL THEN 'exit' WHEN abs(d) < greatest(equity * 0.005, 1.0) THEN 'inside_band' WHEN d < 0 THEN 'trim' WHEN cur = 0 THEN 'open' ELSE 'add' END AS reason, equity
    FROM (SELECT b.*, e.equity, coalesce(b.value, 0.0) AS cur, coalesce(b.weight * e.equity, 0.0) - coalesce(b.value, 0.0) AS d FROM both_pt b JOIN eqt e ON e.book = b.book) WHERE d <> 0""")


def books(spark, sf):
    cust = views.table(spark, sf, "customer").select(c("c_nationkey").alias("book"), c("c_name").alias("symbol"), c("c_acctbal").alias("value"))
    pos = cust.filter("value > 0")
    w = Window.partitionBy("book").orderBy((c("value") % 1000).desc(), c("symbol"))
    picks = cust.withColumn("rk", F.row_number().over(w)).filter("rk <= 10").select("book", "symbol")
    equity = pos.groupBy("book").agg(F.sum("value").alias("equity"))
    return pos, pf.equal_weight(picks, ["book"], 0.98), equity


def plan(spark, sf):
    pos, targets, equity = books(spark, sf)
    return pf.rebalance_plan(pos, pf.check_targets(targets, ["book"]), equity, ["book"])


@query("equal_weight", f"SELECT CAST(book AS BIGINT) AS book, symbol, {R('weight')} AS weight FROM tgt")
def equal_weight(spark, sf):
    return tidy(books(spark, sf)[1])


@query("position_target_union", f"SELECT CAST(book AS BIGINT) AS book, symbol, value, {R('weight')} AS weight FROM both_pt")
def position_target_union(spark, sf):
    pos, targets, _ = books(spark, sf)
    return tidy(pf.position_target_union(pos, targets, ["book"]))


@query("rebalance_plan", f"SELECT CAST(book AS BIGINT) AS book, symbol, side, {R('notional', 4)} AS notional, reason, reason <> 'inside_band' AS traded FROM plan")
def rebalance_plan(spark, sf):
    return tidy(plan(spark, sf).orderBy("book", *pf.plan_order()), 4)


@query("turnover", f"SELECT CAST(book AS BIGINT) AS book, {R('sum(notional)', 4)} AS gross, {R('sum(notional) / max(equity)')} AS turnover FROM plan WHERE reason <> 'inside_band' GROUP BY book")
def turnover(spark, sf):
    out = pf.turnover(plan(spark, sf), books(spark, sf)[2], ["book"])
    return tidy(out.withColumn("gross", sh.r6("gross", 4)))


@query("drift", f"""
    SELECT CAST(b.book AS BIGINT) AS book, {R('sum(abs(coalesce(b.weight * e.equity, 0.0) - coalesce(b.value, 0.0))) / max(e.equity)')} AS drift FROM both_pt b JOIN eqt e ON e.book = b.book GROUP BY b.book""")
def drift(spark, sf):
    pos, targets, equity = books(spark, sf)
    return tidy(pf.drift(pos, targets, equity, ["book"]))


@query("target_book", f"""
    SELECT symbol, {R('0.98 / count(*) OVER ()')} AS weight, {R('0.98 / count(*) OVER () * 100000.0', 4)} AS notional, {R('close', 7)} AS last, {R('close / 100000.0')} AS share_of_equity
    FROM (SELECT * FROM forms WHERE label = '12-2' AND form_ret IS NOT NULL AND month = (SELECT max(month) FROM pnl)
          QUALIFY row_number() OVER (ORDER BY form_ret DESC, symbol DESC) <= 10)""")
def target_book(spark, sf):
    panel = views.panel_table(spark, sf)
    last = panel.agg(F.max("month").alias("month"))
    picks = pn.momentum_rank(panel, 12, 2, 10).join(F.broadcast(last), "month", "left_semi").select("symbol", "month")
    out = pf.target_book(picks, panel, 100_000.0)
    return out.select("symbol", sh.r6("weight").alias("weight"), sh.r6("notional", 4).alias("notional"), sh.r6("last", 7).alias("last"),
                      sh.r6("share_of_equity").alias("share_of_equity"))


LIMITS = pf.RiskLimits(max_stop_distance_pct=150.0)
part("cand_t", """
    SELECT symbol, ts, entry, stop, entry AS price, CASE WHEN day_pos > 40 THEN 0.0 ELSE 10000.0 END AS equity, -50.0 * (day_pos - 1) / 5.0 AS realised,
           day_pos % 6 AS trades_today, day_pos % 3 AS open_positions, abs(entry - stop) AS risk FROM mom_trades""")


def candidates(spark, sf):
    t = momentum_trades(spark, sf)
    return t.select("symbol", "ts", "entry", "stop", c("entry").alias("price"), F.when(c("day_pos") > 40, 0.0).otherwise(10_000.0).alias("equity"),
                    (-50.0 * (c("day_pos") - 1) / 5.0).alias("realised"), (c("day_pos") % 6).alias("trades_today"), (c("day_pos") % 3).alias("open_positions"))


_budget = "greatest(0.0, least(equity * 0.01, equity * 0.03 + least(realised, 0.0)))"


@query("position_size", f"""
    SELECT symbol, ts, CASE WHEN {_budget} > 0 THEN CAST(least(floor({_budget} / (price * 100.0 / 50.0)), 10) AS BIGINT) ELSE 0 END AS premium_size,
           CASE WHEN {_budget} > 0 AND least(0.5 * risk * 100.0, price / 50.0 * 100.0) > 0 THEN CAST(least(floor({_budget} / least(0.5 * risk * 100.0, price / 50.0 * 100.0)), 10) AS BIGINT) ELSE 0 END AS delta_size
    FROM cand_t WHERE price > 0""")
def position_size(spark, sf):
    """Contracts quoted at a fiftieth of the price, under both risk modes."""
    rows = candidates(spark, sf).filter("price > 0")
    budget = pf.trade_budget(LIMITS, c("equity"), c("realised"))
    risk = F.abs(c("entry") - c("stop"))
    quote = c("price") / 50.0
    delta = pf.RiskLimits(sizing_mode="delta")
    return rows.select("symbol", "ts", pf.position_size(LIMITS, budget, quote, risk).alias("premium_size"),
                       pf.position_size(delta, budget, quote, risk, F.lit(0.5)).alias("delta_size"))


@query("trade_admission", f"""
    SELECT symbol, ts, refusal, CASE WHEN refusal IS NULL THEN shares ELSE 0 END AS shares FROM (
      SELECT *, CASE WHEN NOT equity > 0 THEN 'not_started' WHEN trades_today >= 4 THEN 'trade_cap' WHEN open_positions >= 2 THEN 'position_cap'
        WHEN equity * 0.03 + least(realised, 0.0) <= 0 THEN 'loss_budget_spent' WHEN NOT price > 0 THEN 'no_price' WHEN 100.0 * risk / greatest(entry, 1e-9) > 150.0 THEN 'stop_too_wide'
        WHEN NOT risk > 0 THEN 'no_stop' WHEN shares < 1 THEN 'budget_too_small' END AS refusal
      FROM (SELECT *, CASE WHEN risk > 0 AND price > 0 THEN CAST(least(floor({_budget} / risk), floor(equity / price)) AS BIGINT) END AS shares FROM cand_t))""")
def trade_admission(spark, sf):
    return pf.trade_admission(candidates(spark, sf), LIMITS).select("symbol", "ts", "refusal", "shares")


part("rl", """
    SELECT symbol, session, row_number() OVER (PARTITION BY symbol, session ORDER BY day_pos) AS k, CAST(day_pos AS BIGINT) AS opened, CAST(day_pos + bars_held AS BIGINT) AS closed,
           abs(entry - stop) AS risk, (exit_price - entry) * direction AS pps FROM mom_trades""")
# One trade a step: positions due are booked in the order of their closing (two at most are open), then the trade is admitted or refused.
part("rl_walk", """
    SELECT symbol, session, CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS realised, 0 AS n, false AS halted, []::STRUCT(closed BIGINT, pnl DOUBLE)[] AS positions, CAST(0 AS BIGINT) AS opened, CAST(0 AS BIGINT) AS shares, '' AS verdict
    FROM rl WHERE k = 1
    UNION ALL
    SELECT symbol, session, k, realised, CASE WHEN verdict = 'open' THEN n + 1 ELSE n END, halted,
           CASE WHEN verdict = 'open' THEN list_append(positions, {'closed': closed, 'pnl': CAST(shares AS DOUBLE) * pps}) ELSE positions END, opened, CASE WHEN verdict = 'open' THEN shares ELSE 0 END, verdict
    FROM (SELECT *, CASE WHEN halted THEN 'halted' WHEN n >= 4 THEN 'trade_cap' WHEN len(positions) >= 2 THEN 'position_cap' WHEN 300.0 + least(realised, 0.0) <= 0 THEN 'loss_budget_spent'
                         WHEN shares < 1 THEN 'budget_too_small' ELSE 'open' END AS verdict
          FROM (SELECT *, CASE WHEN risk > 0 THEN CAST(floor(greatest(0.0, least(100.0, 300.0 + least(realised, 0.0))) / risk) AS BIGINT) ELSE 0 END AS shares
                FROM (SELECT symbol, session, k, n, opened, closed, risk, pps, CASE WHEN len(due) = 2 THEN once + due[2].pnl ELSE once END AS realised,
                             halted OR (len(due) >= 1 AND once <= -300.0) OR (len(due) = 2 AND once + due[2].pnl <= -300.0) AS halted, list_filter(positions, lambda p: p.closed > opened) AS positions
                      FROM (SELECT *, CASE WHEN len(due) >= 1 THEN before + due[1].pnl ELSE before END AS once
                            FROM (SELECT r.symbol, r.session, r.k, w.n, w.halted, w.positions, w.realised AS before, r.opened, r.closed, r.risk, r.pps,
                                         list_sort(list_filter(w.positions, lambda p: p.closed <= r.opened)) AS due
                                  FROM rl_walk w JOIN rl r ON r.symbol = w.symbol AND r.session = w.session AND r.k = w.k + 1)))))""")


@query("session_risk_ledger", f"SELECT symbol, session, opened, shares, {R('realised', 4)} AS realised, verdict FROM rl_walk WHERE k > 0")
def session_risk_ledger(spark, sf):
    """Every session's momentum trades walked under the daily limits."""
    t = momentum_trades(spark, sf)
    rows = t.select("symbol", "session", c("day_pos").cast("long").alias("opened"), (c("day_pos") + c("bars_held")).cast("long").alias("closed"),
                    F.abs(c("entry") - c("stop")).alias("risk"), ((c("exit_price") - c("entry")) * c("direction")).alias("pnl_per_share"))
    return tidy(pf.session_risk_ledger(rows, pf.RiskLimits(), 10_000.0), 4)
