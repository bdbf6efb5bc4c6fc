"""Queries: signals, first touch, random nulls and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.functions import stats as st
from tapewright.functions import timecols as tc
from tapewright.operators import indicators as ind
from tapewright.operators import nulls as nl
from tapewright.operators import resolve as rs
from tapewright.operators import signals as sg
from tapewright.operators.order import with_index
from tapewright.plans import views
from tapewright.plans.q_bars import ema_sql, tidy
from tapewright.plans.registry import R, held, part, query
from tapewright.session import cut_lineage

c = F.col
SEEDS = list(range(1000, 1020))
STRUCTURES = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)]
WINDOW = "0930-1600"

for _n in (8, 12, 20, 26, 50):
    part(f"ema{_n}", ema_sql(_n))

part("edges", """
    SELECT symbol, session, day_open, lag(day_close) OVER (PARTITION BY symbol ORDER BY session) AS prev_close FROM (
      SELECT symbol, session, first(open ORDER BY ts) AS day_open, last(close ORDER BY ts) AS day_close FROM bars GROUP BY symbol, session)""")
part("sb", """
    SELECT a.*, e.day_open, e.prev_close, r.pdh, r.pdl, o.or_high, o.or_low, o.or_complete,
           lag(a.close, 6) OVER s AS c6, avg(a.high - a.low) OVER s20 AS rmean, count(*) OVER s20 AS rn20,
           first_value(a.open) OVER s AS fo, first_value(a.close) OVER s AS fc,
           lag(a.high, 1) OVER s AS h1, lag(a.low, 1) OVER s AS l1, lag(a.high, 2) OVER s AS h2, lag(a.low, 2) OVER s AS l2
    FROM ba a JOIN edges e ON e.symbol = a.symbol AND e.session = a.session
    JOIN ranges r ON r.symbol = a.symbol AND r.session = a.session
    JOIN orng o ON o.symbol = a.symbol AND o.idx = a.idx
    WINDOW s AS (PARTITION BY a.symbol, a.session ORDER BY a.ts),
           s20 AS (PARTITION BY a.symbol, a.session ORDER BY a.ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
part("sig", """
    SELECT *,
      CASE WHEN or_complete AND or_high > or_low AND close > or_high THEN 1 WHEN or_complete AND or_high > or_low AND close < or_low THEN -1 ELSE 0 END AS opening_range_break,
      CASE WHEN day_pos <= 3 AND abs((day_open - prev_close) / prev_close) >= 0.001 THEN CASE WHEN day_open > prev_close THEN -1 ELSE 1 END ELSE 0 END AS gap_fade,
      CASE WHEN high > pdh AND close < pdh THEN -1 WHEN low < pdl AND close > pdl THEN 1 ELSE 0 END AS prev_day_sweep_reclaim,
      CASE WHEN close > pdh THEN 1 WHEN close < pdl THEN -1 ELSE 0 END AS prev_day_break,
      CASE WHEN close > c6 THEN 1 WHEN close < c6 THEN -1 ELSE 0 END AS momentum_6,
      CASE WHEN rn20 = 20 AND rmean > 0 AND high - low >= 2.0 * rmean THEN CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END ELSE 0 END AS range_expansion,
      CASE WHEN day_pos BETWEEN 4 AND 6 THEN CASE WHEN fc > fo THEN 1 WHEN fc < fo THEN -1 ELSE 0 END ELSE 0 END AS first_bar_continuation,
      CASE WHEN h1 <= h2 AND l1 >= l2 THEN CASE WHEN close > h1 THEN 1 WHEN close < l1 THEN -1 ELSE 0 END ELSE 0 END AS inside_bar_break
    FROM sb""")


def enriched(spark, sf):
    """Indexed bars with ATR, shared by the branches of a query."""
    return held("enriched", spark, sf, lambda: cut_lineage(ind.atr(views.indexed(spark, sf))))


def _signal_query(name: str, add, column: str | None = None, needs=lambda d: d):
    column = column or name

    @query(name, f"SELECT symbol, ts, CAST({column} AS BIGINT) AS signal FROM sig")
    def run(spark, sf):
        return tidy(add(needs(views.indexed(spark, sf))).select("symbol", "ts", "signal"))

    return run


# The test bars are half-hourly, so the opening range is two hours.
_signal_query("opening_range_break", lambda d: sg.opening_range_break(d, 120))
_signal_query("gap_fade", sg.gap_fade, needs=sg.with_session_edges)
_signal_query("prev_day_sweep_reclaim", sg.prev_day_sweep_reclaim, needs=sg.with_prev_day)
_signal_query("prev_day_break", sg.prev_day_break, needs=sg.with_prev_day)
_signal_query("momentum", lambda d: sg.momentum(d, 6), "momentum_6")
_signal_query("range_expansion", sg.range_expansion)
_signal_query("first_bar_continuation", sg.first_bar_continuation)
_signal_query("inside_bar_break", sg.inside_bar_break)

part("emas", """
    SELECT b.symbol, b.idx, b.ts, b.close, b.high, b.low, b.day_pos, f.ema AS f, s.ema AS s,
           lag(f.ema) OVER w AS f0, lag(s.ema) OVER w AS s0, lag(s.ema, 5) OVER (PARTITION BY b.symbol ORDER BY b.idx) AS s5
    FROM b JOIN ema9 f ON f.symbol = b.symbol AND f.idx = b.idx JOIN ema21 s ON s.symbol = b.symbol AND s.idx = b.idx
    WINDOW w AS (PARTITION BY b.symbol, b.session ORDER BY b.ts)""")
part("ema_sig", """
    SELECT symbol, ts,
      CASE WHEN idx >= 23 AND f0 <= s0 AND f > s THEN 1 WHEN idx >= 23 AND f0 >= s0 AND f < s THEN -1 ELSE 0 END AS x,
      CASE WHEN close > s THEN 1 WHEN close < s THEN -1 ELSE 0 END AS t,
      CASE WHEN idx >= 23 AND day_pos >= 2 AND f > s AND low <= f AND close > f THEN 1
           WHEN idx >= 23 AND day_pos >= 2 AND f < s AND high >= f AND close < f THEN -1 ELSE 0 END AS p,
      CASE WHEN idx >= 27 AND s > s5 THEN 1 WHEN idx >= 27 AND s < s5 THEN -1 ELSE 0 END AS l
    FROM emas""")


def _emas(spark, sf):
    return ind.bounded_ema(ind.bounded_ema(views.indexed(spark, sf), 9, "f"), 21, "s")


@query("ema_cross", "SELECT symbol, ts, CAST(x AS BIGINT) AS signal FROM ema_sig")
def ema_cross(spark, sf):
    return tidy(sg.ema_cross(_emas(spark, sf), "f", "s", 21).select("symbol", "ts", "signal"))


@query("ema_trend", "SELECT symbol, ts, CAST(t AS BIGINT) AS signal FROM ema_sig")
def ema_trend(spark, sf):
    return tidy(sg.ema_trend(_emas(spark, sf), "s").select("symbol", "ts", "signal"))


@query("ema_pullback", "SELECT symbol, ts, CAST(p AS BIGINT) AS signal FROM ema_sig")
def ema_pullback(spark, sf):
    return tidy(sg.ema_pullback(_emas(spark, sf), "f", "s", 21).select("symbol", "ts", "signal"))


@query("ema_slope", "SELECT symbol, ts, CAST(l AS BIGINT) AS signal FROM ema_sig")
def ema_slope(spark, sf):
    return tidy(sg.ema_slope(_emas(spark, sf), "s", 21).select("symbol", "ts", "signal"))


@query("signal_interface", """
    SELECT symbol, ts, CAST(CASE WHEN close > m THEN 1 WHEN close < m THEN -1 ELSE 0 END AS BIGINT) AS signal
    FROM (SELECT symbol, ts, close, (lag(close, 1) OVER w + lag(close, 2) OVER w) / 2.0 AS m FROM b WINDOW w AS (PARTITION BY symbol ORDER BY idx))""")
def signal_interface(spark, sf):
    """A user's pandas signal: close against the mean of the two before it."""

    def rule(frame):
        mean = (frame["close"].shift(1) + frame["close"].shift(2)) / 2.0
        return (frame["close"] > mean).astype("int32") - (frame["close"] < mean).astype("int32")

    out = sg.python_signal(views.indexed(spark, sf), rule, 2, ["close"])
    return tidy(out.select("symbol", "ts", "signal"))


# --- first touch -----------------------------------------------------------

def touch_sql(src: str, hold: int | None = None) -> str:
    """First touch of the rows of `src` (direction, entry, stop, target)."""
    cap = f"AND f.day_pos <= e.day_pos + {hold}" if hold else ""
    return f"""
    SELECT *, CASE WHEN stop_at IS NOT NULL AND (target_at IS NULL OR stop_at <= target_at) THEN 'stop'
                   WHEN target_at IS NOT NULL THEN 'target' ELSE 'time' END AS outcome,
              CASE WHEN stop_at IS NOT NULL AND (target_at IS NULL OR stop_at <= target_at) THEN stop
                   WHEN target_at IS NOT NULL THEN target ELSE last_close END AS exit_price,
              CASE WHEN stop_at IS NOT NULL AND (target_at IS NULL OR stop_at <= target_at) THEN stop_at
                   WHEN target_at IS NOT NULL THEN target_at ELSE n_after END AS bars_held
    FROM (SELECT e.*, min(CASE WHEN (e.direction > 0 AND f.low <= e.stop) OR (e.direction < 0 AND f.high >= e.stop) THEN f.day_pos - e.day_pos END) AS stop_at,
                 min(CASE WHEN (e.direction > 0 AND f.high >= e.target) OR (e.direction < 0 AND f.low <= e.target) THEN f.day_pos - e.day_pos END) AS target_at,
                 max(f.day_pos - e.day_pos) AS n_after, arg_max(f.close, f.day_pos) AS last_close
          FROM {src} e JOIN b f ON f.symbol = e.symbol AND f.session = e.session AND f.day_pos > e.day_pos {cap}
          GROUP BY ALL)"""


RES_R = """CASE WHEN outcome = 'stop' THEN -1.0 WHEN outcome = 'target' THEN target_atr / stop_atr
                ELSE (exit_price - entry) * direction / (stop_atr * atr) END - 0.02 / stop_atr"""

part("mom_entries", """
    SELECT symbol, session, ts, minute, day_pos, momentum_6 AS direction, close AS entry, atr, 1.0 AS stop_atr, 2.0 AS target_atr,
           close - momentum_6 * 1.0 * atr AS stop, close + momentum_6 * 2.0 * atr AS target
    FROM sig WHERE momentum_6 <> 0 AND atr > 0""")
part("mom_touch", touch_sql("mom_entries", 60))
part("mom_trades", f"SELECT *, {RES_R} AS r FROM mom_touch")
part("mom_first", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY day_pos) AS rn
                   FROM mom_trades WHERE minute >= 570 AND minute < 960) WHERE rn = 1""")


def momentum_entries(spark, sf):
    df = sg.momentum(enriched(spark, sf), 6, "direction")
    return df.select("symbol", "session", "ts", "minute", "day_pos", "direction", c("close").alias("entry"), "atr",
                     F.lit(1.0).alias("stop_atr"), F.lit(2.0).alias("target_atr"))


def momentum_trades(spark, sf):
    return rs.resolve_entry(momentum_entries(spark, sf), rs.session_paths(views.bar_table(spark, sf)))


@query("resolve_entry", f"""
    SELECT symbol, ts, CAST(direction AS BIGINT) AS direction, outcome, {R('exit_price')} AS exit_price, bars_held, {R('r')} AS r FROM mom_trades""")
def resolve_entry(spark, sf):
    return tidy(momentum_trades(spark, sf).select("symbol", "ts", "direction", "outcome", "exit_price", "bars_held", "r"))


def first_trades(spark, sf):
    inside = momentum_trades(spark, sf).filter(tc.in_session(c("minute"), WINDOW))
    return rs.first_n_per_session(inside, [])


@query("first_n_per_session", f"SELECT symbol, session, ts, CAST(direction AS BIGINT) AS direction, outcome, {R('r')} AS r FROM mom_first")
def first_n_per_session(spark, sf):
    return tidy(first_trades(spark, sf).select("symbol", "session", "ts", "direction", "outcome", "r"))


@query("group_outcomes", "SELECT symbol, outcome, count(*) AS n FROM mom_trades GROUP BY symbol, outcome")
def group_outcomes(spark, sf):
    return rs.group_outcomes(momentum_trades(spark, sf), ["symbol"])


STATS_SQL = f"""count(r) AS n, {R('avg(r)')} AS mean, {R('CASE WHEN count(r) >= 2 THEN stddev_samp(r) / sqrt(count(r)) END')} AS se,
           {R('CASE WHEN count(r) >= 2 THEN avg(r) / nullif(stddev_samp(r) / sqrt(count(r)), 0) END')} AS t, {R('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)')} AS win"""


@query("mean_se_t", f"SELECT symbol, {STATS_SQL} FROM mom_first GROUP BY symbol")
def mean_se_t(spark, sf):
    s = st.mean_se_t(c("r"))
    return tidy(first_trades(spark, sf).groupBy("symbol").agg(*[v.alias(k) for k, v in s.items()]))


part("orb_signals", """
    SELECT symbol, session, ts, day_pos, prev_day_break AS direction, close AS entry, atr,
           CASE WHEN prev_day_break > 0 THEN low ELSE high END AS stop,
           close + prev_day_break * 1.5 * abs(close - CASE WHEN prev_day_break > 0 THEN low ELSE high END) AS target, 1.5::DOUBLE AS target_r
    FROM sig WHERE prev_day_break <> 0 AND abs(close - CASE WHEN prev_day_break > 0 THEN low ELSE high END) > 0""")
part("orb_touch", touch_sql("orb_signals"))
SIG_R = """CASE WHEN outcome = 'stop' THEN -1.0 WHEN outcome = 'target' THEN target_r
                ELSE (exit_price - entry) * direction / abs(entry - stop) END"""
part("orb_trades", f"SELECT *, {SIG_R} AS r FROM orb_touch")
part("grid_signals", """
    SELECT s.symbol, s.session, s.ts, s.day_pos, s.direction, s.entry, s.stop, s.entry + s.direction * g.g * abs(s.entry - s.stop) AS target, g.g AS target_r
    FROM orb_signals s CROSS JOIN (SELECT unnest([0.5, 0.75, 1.0, 1.5, 2.0, 3.0])::DOUBLE AS g) g""")
part("grid_touch", touch_sql("grid_signals"))
part("grid_trades", f"SELECT *, {SIG_R} AS r FROM grid_touch")


def break_signals(spark, sf):
    df = sg.prev_day_break(sg.with_prev_day(enriched(spark, sf)), "direction").filter("direction <> 0")
    stop = F.when(c("direction") > 0, c("low")).otherwise(c("high"))
    out = df.select("symbol", "session", "ts", "day_pos", "direction", c("close").alias("entry"), "atr", stop.alias("stop"))
    return out.withColumns({
        "target": c("entry") + c("direction") * 1.5 * F.abs(c("entry") - c("stop")), "target_r": F.lit(1.5)})


def _paths(spark, sf):
    return rs.session_paths(views.bar_table(spark, sf))


@query("resolve_signal", f"SELECT symbol, ts, outcome, {R('exit_price')} AS exit_price, bars_held, {R('r')} AS r FROM orb_trades")
def resolve_signal(spark, sf):
    out = rs.resolve_signal(break_signals(spark, sf), _paths(spark, sf))
    return tidy(out.select("symbol", "ts", "outcome", "exit_price", "bars_held", "r"))


R_GRID = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)


@query("resolve_at_r", f"SELECT symbol, ts, target_r, outcome, bars_held, {R('r')} AS r FROM grid_trades")
def resolve_at_r(spark, sf):
    out = rs.resolve_at_r(break_signals(spark, sf), _paths(spark, sf), R_GRID)
    return tidy(out.select("symbol", "ts", "target_r", "outcome", "bars_held", "r"))


@query("exit_sweep", f"""
    SELECT target_r, count(*) AS n, count(*) FILTER (WHERE outcome = 'target') AS wins, {R('avg(r)')} AS mean_r,
           {R('stddev_samp(r) / sqrt(count(*))')} AS se, {R('sum(r)')} AS total_r,
           count(*) FILTER (WHERE outcome = 'stop') AS stops, count(*) FILTER (WHERE outcome = 'time') AS times
    FROM grid_trades GROUP BY target_r""")
def exit_sweep(spark, sf):
    return tidy(rs.exit_sweep(rs.resolve_at_r(break_signals(spark, sf), _paths(spark, sf), R_GRID)))


@query("r_multiple", f"""
    SELECT s.symbol, s.ts, {R('CASE WHEN abs(s.entry - s.stop) > 0 THEN (e.day_open - s.entry) * s.direction / abs(s.entry - s.stop) ELSE 0.0 END')} AS open_r
    FROM orb_signals s JOIN edges e ON e.symbol = s.symbol AND e.session = s.session""")
def r_multiple(spark, sf):
    df = sg.with_session_edges(views.indexed(spark, sf)).select("symbol", "ts", "day_open")
    out = break_signals(spark, sf).filter("abs(entry - stop) > 0").join(df, ["symbol", "ts"])
    return tidy(out.select("symbol", "ts", sh.r_multiple(c("entry"), c("stop"), c("day_open"), c("direction") > 0).alias("open_r")))


@query("backtest_trades", f"""
    SELECT symbol, ts, outcome, {R('r - 0.02 * coalesce(atr, 0.0) / abs(entry - stop)')} AS r_net,
           {R('CASE WHEN atr > 0 THEN abs(entry - stop) / atr END')} AS stop_atr FROM orb_trades""")
def backtest_trades(spark, sf):
    return tidy(rs.backtest_trades(break_signals(spark, sf), _paths(spark, sf)).select("symbol", "ts", "outcome", "r_net", "stop_atr"))


@query("outcome_summary", f"""
    SELECT symbol, count(*) AS resolved, count(*) FILTER (WHERE outcome = 'target') AS targets, count(*) FILTER (WHERE outcome = 'stop') AS stops,
           count(*) FILTER (WHERE outcome = 'time') AS times, {R('sum(r)')} AS total_r, {R('avg(r)')} AS mean_r,
           {R('stddev_samp(r) / sqrt(count(*))')} AS se, {R("count(*) FILTER (WHERE outcome = 'target') / count(*)")} AS hit_rate
    FROM orb_trades GROUP BY symbol""")
def outcome_summary(spark, sf):
    return tidy(rs.outcome_summary(rs.resolve_signal(break_signals(spark, sf), _paths(spark, sf)), ["symbol"]))


# --- random nulls ----------------------------------------------------------

part("spots", """
    SELECT symbol, session, list(day_pos ORDER BY day_pos) AS spots FROM b WHERE minute >= 570 AND minute < 960 GROUP BY symbol, session""")
part("draws", """
    SELECT d.symbol, d.session, d.seed, m.mode, d.day_pos,
           CASE WHEN m.mode = 'long' THEN 1 WHEN m.mode = 'short' THEN -1 ELSE d.coin END AS direction, a.close AS entry, a.atr
    FROM (SELECT symbol, session, seed, spots[1 + ('0x' || substr(h, 1, 8))::BIGINT % len(spots)] AS day_pos,
                 CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END AS coin
          FROM (SELECT *, md5(CAST(seed AS VARCHAR) || '|' || symbol || '|' || session) AS h
                FROM spots CROSS JOIN (SELECT unnest(range(1000, 1020)) AS seed))) d
    CROSS JOIN (SELECT unnest(['random', 'long', 'short']) AS mode) m
    JOIN ba a ON a.symbol = d.symbol AND a.session = d.session AND a.day_pos = d.day_pos""")
part("null_entries", """
    SELECT d.*, g.s AS stop_atr, g.t AS target_atr, entry - direction * g.s * atr AS stop, entry + direction * g.t * atr AS target
    FROM draws d CROSS JOIN (SELECT * FROM (VALUES (1.0::DOUBLE, 1.0::DOUBLE), (1.0, 2.0), (2.0, 2.0)) v(s, t)) g WHERE atr > 0""")
part("null_touch", touch_sql("null_entries", 60))
part("null_trades", f"SELECT *, {RES_R} AS r FROM null_touch")


@query("random_null_entries", f"""
    SELECT symbol, session, CAST(seed AS BIGINT) AS seed, mode, day_pos, CAST(direction AS BIGINT) AS direction, entry, {R('atr')} AS atr FROM draws""")
def random_null_entries(spark, sf):
    return tidy(nl.random_null_entries(enriched(spark, sf), WINDOW, SEEDS))


def null_trades(spark, sf, structures=None, seeds=None, modes=nl.MODES, hold=60):
    return nl.random_null_trades(enriched(spark, sf), WINDOW, seeds or SEEDS, structures or STRUCTURES, hold, modes)


@query("bootstrap_average", f"""
    SELECT mode, stop_atr, target_atr, {R('avg(m)')} AS mean_r, {R('stddev_samp(m) / sqrt(count(m))')} AS se, {R('avg(w)')} AS win,
           CAST(floor(avg(k)) AS BIGINT) AS n
    FROM (SELECT mode, stop_atr, target_atr, seed, avg(r) AS m, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS w, count(*) AS k
          FROM null_trades GROUP BY ALL) GROUP BY mode, stop_atr, target_atr""")
def bootstrap_average(spark, sf):
    return tidy(nl.bootstrap_average(null_trades(spark, sf), ["mode", "stop_atr", "target_atr"]))


@query("drift_table", f"""
    SELECT stop_atr, target_atr, {R("max(CASE WHEN mode = 'random' THEN m END)")} AS random_r, {R("max(CASE WHEN mode = 'long' THEN m END)")} AS long_r,
           {R("max(CASE WHEN mode = 'short' THEN m END)")} AS short_r,
           {R("max(CASE WHEN mode = 'long' THEN m END) - max(CASE WHEN mode = 'short' THEN m END)")} AS drift
    FROM (SELECT mode, stop_atr, target_atr, avg(m) AS m FROM (SELECT mode, stop_atr, target_atr, seed, avg(r) AS m FROM null_trades GROUP BY ALL) GROUP BY ALL)
    GROUP BY stop_atr, target_atr""")
def drift_table(spark, sf):
    rates = nl.bootstrap_average(null_trades(spark, sf), ["mode", "stop_atr", "target_atr"])
    return tidy(nl.drift_table(rates))


NULL_STOPS = (0.5, 1.0, 1.5, 2.0)
NULL_TARGETS = (1.0, 2.0, 3.0)
part("grid_entries", """
    SELECT d.symbol, d.session, d.seed, d.day_pos, d.direction, d.entry, d.atr, g.s AS stop_atr, g.s * g.t AS target_atr, g.t AS target_r,
           entry - direction * g.s * atr AS stop, entry + direction * (g.s * g.t) * atr AS target
    FROM draws d CROSS JOIN (SELECT s.s, t.t FROM (SELECT unnest([0.5, 1.0, 1.5, 2.0])::DOUBLE AS s) s CROSS JOIN (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS t) t) g
    WHERE atr > 0 AND mode = 'random'""")
part("ngrid_touch", touch_sql("grid_entries"))
part("ngrid_trades", f"SELECT *, {RES_R} AS r FROM ngrid_touch")
part("ngrid", """
    SELECT stop_atr, target_r, sum(k) / 20.0 AS n_per_seed, sum(s1) / sum(k) AS mean_r_net,
           sqrt(sum(s2) / sum(k) - (sum(s1) / sum(k)) * (sum(s1) / sum(k))) AS sd_r, stddev_pop(s1 / k) AS seed_spread, sum(w) / sum(k) AS win
    FROM (SELECT stop_atr, target_r, seed, sum(r) AS s1, sum(r * r) AS s2, count(*) AS k, count(*) FILTER (WHERE r > 0) AS w FROM ngrid_trades GROUP BY ALL)
    GROUP BY stop_atr, target_r""")


def grid_rows(spark, sf):
    structures = [(s, s * t) for s in NULL_STOPS for t in NULL_TARGETS]
    trades = null_trades(spark, sf, structures, modes=("random",), hold=10_000)
    trades = trades.withColumn("target_r", F.round(c("target_atr") / c("stop_atr"), 6))
    return nl.null_grid(trades, len(SEEDS), ["stop_atr", "target_r"])


@query("null_grid", f"""
    SELECT stop_atr, target_r, {R('n_per_seed')} AS n_per_seed, {R('mean_r_net')} AS mean_r_net, {R('sd_r')} AS sd_r,
           {R('seed_spread')} AS seed_spread, {R('win')} AS win FROM ngrid""")
def null_grid(spark, sf):
    return tidy(grid_rows(spark, sf))


part("orb_mid", "SELECT symbol, median(abs(entry - stop) / atr) AS med_stop, median(target_r) AS med_target FROM orb_trades WHERE atr > 0 GROUP BY symbol")
part("orb_match", """
    SELECT * FROM (SELECT m.*, g.*, abs(ln(g.stop_atr / med_stop)) + abs(ln(g.target_r / med_target)) AS distance,
             row_number() OVER (PARTITION BY symbol ORDER BY abs(ln(g.stop_atr / med_stop)) + abs(ln(g.target_r / med_target)), g.stop_atr, g.target_r) AS rn
      FROM orb_mid m CROSS JOIN ngrid g) WHERE rn = 1""")


def matched_null(spark, sf):
    trades = rs.backtest_trades(break_signals(spark, sf), _paths(spark, sf)).filter("atr > 0")
    return trades, nl.null_structure_match(trades, grid_rows(spark, sf), ["symbol"])


@query("null_structure_match", f"""
    SELECT symbol, {R('med_stop')} AS med_stop, {R('med_target')} AS med_target, {R('distance')} AS distance, stop_atr, target_r, {R('mean_r_net')} AS mean_r_net
    FROM orb_match""")
def null_structure_match(spark, sf):
    _, match = matched_null(spark, sf)
    return tidy(match.select("symbol", "med_stop", "med_target", "distance", "stop_atr", "target_r", "mean_r_net"))


@query("welch_vs_pooled_null", f"""
    SELECT t.symbol, t.n, {R('(t.m - k.mean_r_net) / sqrt(t.v / t.n + k.sd_r * k.sd_r / k.n_per_seed)')} AS t_null
    FROM (SELECT symbol, count(*) AS n, avg(r - 0.02 * atr / abs(entry - stop)) AS m, var_samp(r - 0.02 * atr / abs(entry - stop)) AS v
          FROM orb_trades WHERE atr > 0 GROUP BY symbol) t JOIN orb_match k ON k.symbol = t.symbol""")
def welch_vs_pooled_null(spark, sf):
    trades, match = matched_null(spark, sf)
    agg = trades.groupBy("symbol").agg(F.count("r_net").alias("n"), F.avg("r_net").alias("m"), F.var_samp("r_net").alias("v"))
    t = st.welch_t(c("m"), c("v"), c("n"), c("mean_r_net"), c("sd_r") * c("sd_r"), c("n_per_seed"))
    return tidy(agg.join(match, "symbol").select("symbol", "n", t.alias("t_null")))


@query("welch_t", f"""
    SELECT symbol, count(*) FILTER (WHERE direction > 0) AS n_a, count(*) FILTER (WHERE direction < 0) AS n_b,
           {R('avg(r) FILTER (WHERE direction > 0) - avg(r) FILTER (WHERE direction < 0)')} AS diff,
           {R('''(avg(r) FILTER (WHERE direction > 0) - avg(r) FILTER (WHERE direction < 0)) / sqrt(
              var_samp(r) FILTER (WHERE direction > 0) / count(*) FILTER (WHERE direction > 0) + var_samp(r) FILTER (WHERE direction < 0) / count(*) FILTER (WHERE direction < 0))''')} AS t
    FROM mom_trades GROUP BY symbol""")
def welch_t(spark, sf):
    w = st.welch_groups(c("r"), c("direction") > 0)
    return tidy(momentum_trades(spark, sf).groupBy("symbol").agg(*[v.alias(k) for k, v in w.items()]))


part("mom_var", """
    SELECT symbol, session, ts, minute, day_pos, k AS look_back,
      CASE WHEN close > ck THEN 1 WHEN close < ck THEN -1 ELSE 0 END AS direction, close AS entry, atr, 1.0 AS stop_atr, 2.0 AS target_atr
    FROM (SELECT *, 3 AS k, lag(close, 3) OVER s AS ck FROM ba WINDOW s AS (PARTITION BY symbol, session ORDER BY ts)
          UNION SELECT *, 6, lag(close, 6) OVER s FROM ba WINDOW s AS (PARTITION BY symbol, session ORDER BY ts)
          UNION SELECT *, 9, lag(close, 9) OVER s FROM ba WINDOW s AS (PARTITION BY symbol, session ORDER BY ts))""")
part("mom_var_e", "SELECT *, entry - direction * atr AS stop, entry + direction * 2.0 * atr AS target FROM mom_var WHERE direction <> 0 AND atr > 0")
part("mom_var_t", touch_sql("mom_var_e", 60))
part("mom_var_r", f"SELECT *, {RES_R} AS r FROM mom_var_t")


@query("ablation_table", f"""
    SELECT CAST(x.look_back AS BIGINT) AS look_back, x.n AS trades, x.n - y.n AS delta, {R('x.hit')} AS hit_rate, {R('x.m')} AS mean_r, {R('x.se')} AS se, {R('x.tot', 4)} AS total_r
    FROM (SELECT look_back, count(*) AS n, count(*) FILTER (WHERE outcome = 'target') / count(*) AS hit, avg(r) AS m, stddev_samp(r) / sqrt(count(*)) AS se, sum(r) AS tot
          FROM mom_var_r GROUP BY look_back) x
    CROSS JOIN (SELECT count(*) AS n FROM mom_var_r WHERE look_back = 6) y""")
def ablation_table(spark, sf):
    """One row per changed setting, with the trade count against the base."""
    df = enriched(spark, sf)
    for k in (3, 6, 9):
        df = sg.momentum(df, k, f"m{k}")
    keep = ["symbol", "session", "day_pos", "entry", "atr", "stop_atr", "target_atr"]
    base = df.withColumns({"entry": c("close"), "stop_atr": F.lit(1.0), "target_atr": F.lit(2.0)})
    entries = sg.stack_signals(base, ["m3", "m6", "m9"], keep)
    trades = rs.resolve_entry(entries, _paths(spark, sf))
    rows = rs.outcome_summary(trades, ["signal_name"]).withColumn("look_back", F.substring("signal_name", 2, 1).cast("long"))
    ref = rows.filter("look_back = 6").select(c("resolved").alias("_base"))
    out = rows.join(F.broadcast(ref)).select(
        "look_back", c("resolved").alias("trades"), (c("resolved") - c("_base")).alias("delta"), "hit_rate", "mean_r", "se",
        sh.r6("total_r", 4).alias("total_r"))
    return tidy(out)


CANDS = ["opening_range_break", "gap_fade", "prev_day_sweep_reclaim", "prev_day_break", "momentum_6", "range_expansion",
         "first_bar_continuation", "inside_bar_break"]
OPPOSITE = {"opening_range_fade": "opening_range_break", "gap_continue": "gap_fade", "mean_reversion_6": "momentum_6",
            "range_expansion_fade": "range_expansion"}
part("cand_long", " UNION ALL_ ".replace("ALL_", "BY NAME").join(
    [f"SELECT '{n}' AS signal_name, {n} AS direction, symbol, session, minute, day_pos, close AS entry, atr FROM sig" for n in CANDS]
    + [f"SELECT '{n}' AS signal_name, -{s} AS direction, symbol, session, minute, day_pos, close AS entry, atr FROM sig" for n, s in OPPOSITE.items()]))


def batch_sql(src: str, least: int) -> tuple[str, str, str, str, str]:
    entries = f"""
    SELECT l.*, g.s AS stop_atr, g.t AS target_atr, entry - direction * g.s * atr AS stop, entry + direction * g.t * atr AS target
    FROM {src} l CROSS JOIN (SELECT * FROM (VALUES (1.0::DOUBLE, 1.0::DOUBLE), (1.0, 2.0), (2.0, 2.0)) v(s, t)) g
    WHERE atr > 0 AND direction <> 0 AND minute >= 570 AND minute < 960"""
    return entries


part("cand_entries", batch_sql("cand_long", 20))
part("cand_touch", touch_sql("cand_entries", 60))
part("cand_first", f"""
    SELECT * FROM (SELECT *, {RES_R} AS r, row_number() OVER (PARTITION BY symbol, session, signal_name, stop_atr, target_atr ORDER BY day_pos) AS rn FROM cand_touch) WHERE rn = 1""")
part("null_one", "SELECT stop_atr, target_atr, count(*) AS n0, avg(r) AS m0, var_samp(r) AS v0 FROM null_trades WHERE seed = 1007 AND mode = 'random' GROUP BY ALL")
BATCH_OUT = f"""
    SELECT signal_name, stop_atr, target_atr, n, {R('m')} AS mean_r, {R('win')} AS win, {R('(m - m0) / sqrt(v / n + v0 / n0)')} AS t_null,
           coalesce(abs((m - m0) / sqrt(v / n + v0 / n0)) >= 2.5 AND n >= 30, false) AS survives
    FROM (SELECT signal_name, stop_atr, target_atr, count(*) AS n, avg(r) AS m, var_samp(r) AS v, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win
          FROM {{src}} GROUP BY ALL HAVING count(*) >= {{least}}) JOIN null_one USING (stop_atr, target_atr)"""


def candidate_report(df, names, spark, sf, least: int):
    """Every candidate under every structure against one random draw."""
    keep = ["symbol", "session", "day_pos", "entry", "atr"]
    inside = df.filter(tc.in_session(c("minute"), WINDOW)).withColumn("entry", c("close"))
    stacked = sg.stack_signals(inside, names, keep)
    grid = F.array(*[F.struct(F.lit(s).alias("stop_atr"), F.lit(t).alias("target_atr")) for s, t in STRUCTURES])
    entries = stacked.select("*", F.inline(grid))
    trades = rs.resolve_entry(entries, _paths(spark, sf))
    first = rs.first_n_per_session(trades, ["signal_name", "stop_atr", "target_atr"])
    null = null_trades(spark, sf, seeds=[1007], modes=("random",)).groupBy("stop_atr", "target_atr").agg(
        F.count("r").alias("n0"), F.avg("r").alias("m0"), F.var_samp("r").alias("v0"))
    rows = first.groupBy("signal_name", "stop_atr", "target_atr").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean_r"), F.var_samp("r").alias("v"), st.win_share(c("r")).alias("win"))
    t = st.welch_t(c("mean_r"), c("v"), c("n"), c("m0"), c("v0"), c("n0"))
    out = rows.filter(c("n") >= least).join(null, ["stop_atr", "target_atr"]).withColumn("t_null", t)
    survives = sh.truthy((F.abs(c("t_null")) >= 2.5) & (c("n") >= 30))
    return out.select("signal_name", "stop_atr", "target_atr", "n", "mean_r", "win", "t_null", survives.alias("survives"))


@query("candidate_batch", BATCH_OUT.format(src="cand_first", least=20))
def candidate_batch(spark, sf):
    df, names = sg.candidate_signals(enriched(spark, sf), 120)
    return tidy(candidate_report(df, names, spark, sf, 20))


_pair = lambda f, s: f"""
    SELECT b.symbol, b.idx, CASE WHEN b.idx >= {s + 2} AND f0 <= s0 AND f > s THEN 1 WHEN b.idx >= {s + 2} AND f0 >= s0 AND f < s THEN -1 ELSE 0 END AS x{f}_{s},
           CASE WHEN b.idx >= {s + 2} AND day_pos >= 2 AND f > s AND low <= f AND close > f THEN 1
                WHEN b.idx >= {s + 2} AND day_pos >= 2 AND f < s AND high >= f AND close < f THEN -1 ELSE 0 END AS p{f}_{s}
    FROM (SELECT b.*, f.ema AS f, s.ema AS s, lag(f.ema) OVER w AS f0, lag(s.ema) OVER w AS s0
          FROM b JOIN ema{f} f ON f.symbol = b.symbol AND f.idx = b.idx JOIN ema{s} s ON s.symbol = b.symbol AND s.idx = b.idx
          WINDOW w AS (PARTITION BY b.symbol, b.session ORDER BY b.ts)) b"""  # noqa: E731
_one = lambda n: f"""
    SELECT symbol, idx, CASE WHEN close > e THEN 1 WHEN close < e THEN -1 ELSE 0 END AS t{n},
           CASE WHEN idx >= {n + 6} AND e > e5 THEN 1 WHEN idx >= {n + 6} AND e < e5 THEN -1 ELSE 0 END AS l{n}
    FROM (SELECT b.*, e.ema AS e, lag(e.ema, 5) OVER (PARTITION BY b.symbol ORDER BY b.idx) AS e5 FROM b JOIN ema{n} e ON e.symbol = b.symbol AND e.idx = b.idx)"""  # noqa: E731
PAIRS = [(9, 21), (8, 21), (12, 26), (20, 50)]
for _f, _s in PAIRS:
    part(f"pair_{_f}_{_s}", _pair(_f, _s))
for _n in (21, 50):
    part(f"one_{_n}", _one(_n))
_ema_cols = [(f"ema_cross_{f}_{s}", f"x{f}_{s}", f"pair_{f}_{s}") for f, s in PAIRS] + [
    (f"ema_pullback_{f}_{s}", f"p{f}_{s}", f"pair_{f}_{s}") for f, s in PAIRS] + [
    (f"ema_trend_{n}", f"t{n}", f"one_{n}") for n in (21, 50)] + [(f"ema_slope_{n}", f"l{n}", f"one_{n}") for n in (21, 50)]
part("ema_long", " UNION BY NAME ".join(
    f"SELECT '{name}' AS signal_name, q.{col} AS direction, a.symbol, a.session, a.minute, a.day_pos, a.close AS entry, a.atr FROM ba a JOIN {tab} q ON q.symbol = a.symbol AND q.idx = a.idx"
    for name, col, tab in _ema_cols))
part("emac_entries", batch_sql("ema_long", 50))
part("emac_touch", touch_sql("emac_entries", 60))
part("emac_first", f"""
    SELECT * FROM (SELECT *, {RES_R} AS r, row_number() OVER (PARTITION BY symbol, session, signal_name, stop_atr, target_atr ORDER BY day_pos) AS rn FROM emac_touch) WHERE rn = 1""")


@query("ema_candidate_batch", BATCH_OUT.format(src="emac_first", least=50))
def ema_candidate_batch(spark, sf):
    df, names = sg.ema_candidates(enriched(spark, sf))
    return tidy(candidate_report(df, names, spark, sf, 50))


# --- corrections for many tests --------------------------------------------

part("tests_k", "SELECT symbol, session, count(*) AS k FROM (SELECT symbol, CAST(CAST(ny AS DATE) AS VARCHAR) AS session FROM ny_ticks) GROUP BY ALL")
_u = "sqrt(-2.0 * ln(0.05 / k / 2.0))"


def _test_counts(spark, sf):
    """Number of tests per symbol-day: one per tick."""
    t = views.ticks(spark, sf).select("symbol", tc.iso_date(tc.to_ny(c("ts"))).alias("session"))
    return t.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("k"))


@query("bonferroni_t", f"""
    SELECT symbol, session, k, {R('u - (2.515517 + 0.802853 * u + 0.010328 * u * u) / (1.0 + 1.432788 * u + 0.189269 * u * u + 0.001308 * u * u * u)')} AS bar
    FROM (SELECT *, {_u} AS u FROM tests_k)""")
def bonferroni_t(spark, sf):
    return tidy(_test_counts(spark, sf).withColumn("bar", st.bonferroni_t(c("k"))))


@query("expected_max_t", f"""
    SELECT symbol, session, k, {R('CASE WHEN k > 1 THEN sqrt(2.0 * ln(k)) - (ln(ln(k)) + ln(4.0 * pi())) / (2.0 * sqrt(2.0 * ln(k))) ELSE 0.0 END')} AS bar
    FROM tests_k""")
def expected_max_t(spark, sf):
    return tidy(_test_counts(spark, sf).withColumn("bar", st.expected_max_t(c("k"))))


def flagship(spark, sf):
    """Does a two-bar momentum rule beat zero? Ticks to trades to t."""
    df = sg.momentum(ind.atr(with_index(views.bars30(spark, sf))), 2, "direction")
    entries = df.select("symbol", "session", "ts", "minute", "day_pos", "direction", c("close").alias("entry"), "atr",
                        F.lit(1.0).alias("stop_atr"), F.lit(2.0).alias("target_atr"))
    trades = rs.resolve_entry(entries, _paths(spark, sf))
    s = st.mean_se_t(c("r"))
    return tidy(trades.groupBy("symbol").agg(*[v.alias(k) for k, v in s.items()]))
