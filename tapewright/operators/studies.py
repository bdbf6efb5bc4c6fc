"""Daily and intraday studies: legs, straddles, regimes, noise-area momentum.

Windows here run over one row per (symbol, day) or inside one session; the
tick- and bar-level work happens in partially aggregated group-bys before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import stats as st
from tapewright.operators.medians import exact_medians
from tapewright.operators.order import session_so_far, session_w
from tapewright.operators.ranks import with_rank

c = F.col
MAX_GAP_DAYS = 5
STRADDLE_FACTOR = 0.7979
STRADDLE_COST = 0.02


def day_w() -> Window:
    return Window.partitionBy("symbol").orderBy("day")


# --- overnight and intraday legs --------------------------------------------

def overnight_split(days: DataFrame, max_gap: int = MAX_GAP_DAYS) -> DataFrame:
    """Log legs per pair of held days: overnight, intraday and total.

    days: symbol, day, open, close. Pairs too far apart are skipped.
    """
    w = day_w()
    paired = days.withColumns({"_pd": F.lag("day").over(w), "_pc": F.lag("close").over(w)})
    kept = paired.filter(c("_pd").isNotNull() & (F.datediff("day", "_pd") <= max_gap))
    return kept.select(
        "symbol", "day", F.log(c("open") / c("_pc")).alias("overnight"), F.log(c("close") / c("open")).alias("intraday"),
        F.log(c("close") / c("_pc")).alias("total"))


def overnight_subwindows(days: DataFrame, max_gap: int = MAX_GAP_DAYS) -> DataFrame:
    """Post-close, true-gap and pre-open log legs; a missing print drops the pair.

    days: symbol, day, rth_open, rth_close, pre_first, post_last.
    """
    w = day_w()
    near = days.withColumn("_pd", F.lag("day").over(w)).filter(
        c("_pd").isNotNull() & (F.datediff("day", "_pd") <= max_gap)).drop("_pd")
    paired = near.withColumns({
        "_pd": F.lag("day").over(w), "_pc": F.lag("rth_close").over(w), "_pp": F.lag("post_last").over(w)})
    usable = (F.datediff("day", "_pd") <= max_gap) & (c("_pp") > 0) & (c("pre_first") > 0) & (c("_pc") > 0) & (c("rth_open") > 0)
    return paired.filter(usable).select(
        "symbol", "day", F.log(c("_pp") / c("_pc")).alias("post_close"), F.log(c("pre_first") / c("_pp")).alias("true_gap"),
        F.log(c("rth_open") / c("pre_first")).alias("pre_open"))


def cost_adjusted_legs(legs: DataFrame, cost_bp: float = 1.0) -> DataFrame:
    """Round-trip cost off each leg every day; holding pays none."""
    cost = cost_bp / 1e4
    on, idy, hold = c("overnight") - cost, c("intraday") - cost, c("total")
    out = legs.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), st.annualise_log(on).alias("overnight_ann"), st.annualise_log(idy).alias("intraday_ann"),
        st.annualise_log(hold).alias("hold_ann"), st.sharpe(on, 252).alias("overnight_sharpe"),
        st.sharpe(hold, 252).alias("hold_sharpe"), (1e4 * F.avg("overnight")).alias("break_even_bp"))
    return out.withColumn("edge", c("overnight_ann") - c("hold_ann"))


# --- returns inside and across sessions --------------------------------------

def with_small(found: DataFrame, rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """Results with too_few: groups of fewer than `least` rows have one row of NULLs instead of vanishing."""
    small = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).filter(c("_size") < least).select(*by, F.lit(True).alias("too_few"))
    return found.withColumn("too_few", F.lit(False)).unionByName(small, allowMissingColumns=True)


def log_returns(bars: DataFrame, least: int = 100) -> DataFrame:
    """Close-to-close log returns of each session; NULL and too_few where it has not enough usable closes."""
    usable = bars.filter(c("close") > 0)
    w = session_w()
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol", "session"))
    out = usable.withColumns({"_n": size, "_pc": F.lag("close").over(w)}).filter(c("_pc").isNotNull())
    few = c("_n") < least
    return out.select("symbol", "session", "ts", F.when(~few, F.log(c("close") / c("_pc"))).alias("ret"), few.alias("too_few"))


def variance_ratio(returns: DataFrame, q: int, least: int = 8) -> DataFrame:
    """Variance of non-overlapping q-sums over q times the single variance; NULL and too_few under `least` sums."""
    w = Window.partitionBy("symbol", "session")
    placed = returns.withColumns({"_rn": F.row_number().over(w.orderBy("ts")), "_k": F.floor(F.count("ret").over(w) / q)})
    block = F.when((c("_k") >= least) & (c("_rn") <= c("_k") * q), F.floor((c("_rn") - 1) / q))
    blocks = placed.groupBy("symbol", "session", block.alias("_b")).agg(
        F.sum("ret").alias("_s"), F.sum(c("ret") * c("ret")).alias("_ss"), F.count(F.lit(1)).alias("_c"))
    used = lambda x: F.when(c("_b").isNotNull(), c(x))
    n, s = F.sum(used("_c")), F.sum(used("_s"))
    var1 = (F.sum(used("_ss")) - s * s / n) / (n - 1)
    return blocks.groupBy("symbol", "session").agg(
        F.count("_b").alias("blocks"), F.when(var1 > 0, F.var_samp(used("_s")) / (q * var1)).alias("variance_ratio"), (F.count("_b") == 0).alias("too_few"))


def autocorr1(returns: DataFrame, least: int = 30) -> DataFrame:
    """Lag-1 autocorrelation with the full-series mean in both factors; NULL and too_few under `least` returns."""
    w = Window.partitionBy("symbol", "session")
    centred = returns.withColumn("_d", c("ret") - F.avg("ret").over(w))
    lagged = centred.withColumn("_p", F.lag("_d").over(w.orderBy("ts")))
    den, n = F.sum(c("_d") * c("_d")), F.count("ret")
    return lagged.groupBy("symbol", "session").agg(
        n.alias("n"), F.when((n >= least) & (den > 0), F.sum(c("_d") * c("_p")) / den).alias("autocorr"), (n < least).alias("too_few"))


def realised_vol(returns: DataFrame, least: int = 30, per_day: int = 390) -> DataFrame:
    """Session volatility in percent, NULL and too_few with no more than `least` returns, and the last one known before."""
    n = F.count("ret")
    vol = returns.groupBy("symbol", "session").agg(
        F.when(n > least, F.stddev_samp("ret") * math.sqrt(per_day) * 100).alias("vol"), (n <= least).alias("too_few"))
    before = Window.partitionBy("symbol").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    return vol.withColumn("prev_vol", F.last("vol", ignorenulls=True).over(before))


def rolling_realised_vol(days: DataFrame, length: int = 22) -> DataFrame:
    """Annualised volatility of the last daily log returns, in percent."""
    w = day_w()
    rets = days.withColumn("ret", F.log(c("close") / F.lag("close").over(w))).filter(c("ret").isNotNull())
    frame = w.rowsBetween(-(length - 1), 0)
    full = F.count("ret").over(frame) == length
    return rets.select("symbol", "day", F.when(full, F.stddev_samp("ret").over(frame) * math.sqrt(252) * 100).alias("vol"))


# --- straddles and their predictors ------------------------------------------

def vol_spot_join(spot: DataFrame, vol: DataFrame, horizon: float = 1.0) -> DataFrame:
    """One-day straddle P&L on the days both series hold.

    spot: symbol, day, spot; vol: symbol, day, level. The next day is the next
    day of the intersection.
    """
    both = spot.join(vol, ["symbol", "day"]).withColumn("_next", F.lead("spot").over(day_w()))
    usable = both.filter((c("spot") > 0) & (c("_next") > 0) & (c("level") > 0))
    cost = STRADDLE_FACTOR * (c("level") / 100.0) * math.sqrt(horizon / 252.0)
    move = F.abs((c("_next") - c("spot")) / c("spot"))
    return usable.select("symbol", "day", (c("level") / 100.0).alias("implied"), cost.alias("straddle"), move.alias("payoff"),
                         (move - cost * (1.0 + STRADDLE_COST)).alias("pnl"))


def vol_ratio_predictors(straddles: DataFrame, levels: DataFrame) -> DataFrame:
    """Six predictors known on the day, long: symbol, day, predictor, value, pnl.

    levels: day, series in {vix, vix9d, vix3m, vvix, skew}, level. A missing
    series makes the predictor missing and the row is dropped.
    """
    names = ("vix", "vix9d", "vix3m", "vvix", "skew")
    wide = levels.groupBy("day").agg(*[F.max(F.when(c("series") == n, c("level"))).alias(n) for n in names])
    joined = straddles.join(wide, "day", "left")
    implied = c("implied") * 100.0
    over = lambda a, b: F.when(b != 0, a / b)
    rows = F.array(
        F.struct(F.lit("implied").alias("predictor"), implied.alias("value")),
        F.struct(F.lit("implied_over_vix").alias("predictor"), over(implied, c("vix")).alias("value")),
        F.struct(F.lit("vix9d_over_vix").alias("predictor"), over(c("vix9d"), c("vix")).alias("value")),
        F.struct(F.lit("vix_over_vix3m").alias("predictor"), over(c("vix"), c("vix3m")).alias("value")),
        F.struct(F.lit("vvix").alias("predictor"), c("vvix").alias("value")),
        F.struct(F.lit("skew").alias("predictor"), c("skew").alias("value")),
    )
    return joined.select("symbol", "day", "pnl", F.inline(rows)).filter(c("value").isNotNull())


def deciles(rows: DataFrame, by: list[str], key: str, value: str, tie: str, least: int = 200) -> DataFrame:
    """Exact tenths of the sorted predictor (cuts at q*n // 10), not ntile; too_few for groups under `least` rows."""
    placed = with_rank(rows, by, key, tie).filter(c("_n") >= least).withColumn(
        "decile", F.floor((10 * c("_rn") - 1) / c("_n")).cast("long") + 1)
    found = placed.groupBy(*by, "decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), st.std_error(c(value)).alias("se"),
        st.t_stat(c(value)).alias("t"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    return with_small(found, rows, by, least)


def with_tercile(rows: DataFrame, by: list[str], key: str, tie: str, name: str = "tercile", least: int = 0) -> DataFrame:
    """0, 1 or 2 by rank; the last third takes the remainder. Groups under `least` rows are left out."""
    ranked = with_rank(rows, by, key, tie).filter(c("_n") >= least)
    k = F.floor(c("_n") / 3)
    third = F.when(k > 0, F.least(F.floor((c("_rn") - 1) / k), F.lit(2))).otherwise(2)
    return ranked.withColumn(name, third.cast("long")).drop("_rn", "_n")


def terciles(rows: DataFrame, by: list[str], key: str, value: str, tie: str, least: int = 0) -> DataFrame:
    return with_tercile(rows, by, key, tie, least=least).groupBy(*by, "tercile").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), st.std_error(c(value)).alias("se"), st.t_stat(c(value)).alias("t"))


def regime_straddle_join(regimes: DataFrame, straddles: DataFrame, least: int = 60) -> DataFrame:
    """Straddle P&L by tercile of the regime reading known before the day; too_few for symbols under `least` days."""
    rows = regimes.select("symbol", "day", "reading").join(straddles.select("symbol", "day", "pnl"), ["symbol", "day"])
    return with_small(terciles(rows, ["symbol"], "reading", "pnl", "day", least), rows, ["symbol"], least)


def group_gradient(rows: DataFrame, by: list[str], key: str, value: str, tie: str) -> DataFrame:
    """Welch test across the sign of the key, with tercile means beside it."""
    placed = with_tercile(rows, by, key, tie)
    welch = st.welch_groups(c(value), c(key) > 0)
    third = lambda i: F.avg(F.when(c("tercile") == i, c(value)))
    return placed.groupBy(*by).agg(
        *[v.alias(k) for k, v in welch.items()], third(0).alias("low_mean"), third(1).alias("mid_mean"), third(2).alias("high_mean"))


def stratified_control(rows: DataFrame, by: list[str], least: int = 60) -> DataFrame:
    """Does g still matter inside thirds of the control pv?

    rows: g, pv, tv and `day`. Each third is split at its median g (strictly
    above against the rest) and tested on tv. too_few for groups under `least`
    rows.
    """
    placed = with_tercile(rows, by, "pv", "day", "stratum", least)
    mid = exact_medians(placed, [*by, "stratum"], ["g"]).withColumnRenamed("g", "_med")
    joined = placed.join(mid, [*by, "stratum"])
    welch = st.welch_groups(c("tv"), c("g") > c("_med"))
    return with_small(joined.groupBy(*by, "stratum").agg(*[v.alias(k) for k, v in welch.items()]), rows, by, least)


# --- noise-area momentum ------------------------------------------------------

def session_grid(bars: DataFrame, least: int = 300, step: int = 1, start: int = 570) -> DataFrame:
    """Price and running VWAP at each clock minute of each full session.

    The clock is positional: the n-th bar ends at start + n*step.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol", "session"))
    tp = (c("high") + c("low") + c("close")) / 3.0
    run = session_so_far()
    every = Window.partitionBy("symbol", "session")
    placed = bars.withColumn("_n", size).filter(c("_n") >= least).withColumns({
        "clock": (F.row_number().over(session_w()) * step + start).cast("int"),
        "_pv": F.sum(tp * c("volume")).over(run), "_v": F.sum("volume").over(run),
        "open_px": F.min_by("open", "ts").over(every), "close_px": F.max_by("close", "ts").over(every),
    })
    days = placed.select("symbol", "session").distinct()
    numbered = days.withColumn("session_no", F.row_number().over(Window.partitionBy("symbol").orderBy("session")))
    return placed.join(numbered, ["symbol", "session"]).select(
        "symbol", "session", "session_no", "clock", c("close").alias("price"),
        F.when(c("_v") > 0, c("_pv") / c("_v")).otherwise(c("close")).alias("vwap"), "open_px", "close_px",
        (c("_n") * step + start).cast("int").alias("last_clock"))


def noise_sigma(grid: DataFrame, decisions: list[int], look_back: int = 14) -> DataFrame:
    """Add sigma: mean absolute move from the open at this clock, last sessions.

    The frame is a RANGE over session numbers, so a session without the clock
    never pulls in an older one.
    """
    w = Window.partitionBy("symbol", "clock").orderBy("session_no").rangeBetween(-look_back, -1)
    move = F.when(c("open_px") > 0, F.abs(c("price") / c("open_px") - 1.0))
    at = grid.filter(c("clock").isin(decisions)).withColumn("_m", move)
    return at.withColumn("sigma", F.when(c("session_no") > look_back, F.avg("_m").over(w))).drop("_m")


def noise_area_positions(grid: DataFrame, decisions: list[int], look_back: int = 14) -> DataFrame:
    """Trades of each session from a fold over its (at most a dozen) decisions.

    Enter beyond the noise band around the open and the previous close, trail
    at the band or the VWAP, reverse at the same decision, flat at the close.
    """
    days = grid.select("symbol", "session", "session_no", "open_px", "close_px", "last_clock").distinct()
    w = Window.partitionBy("symbol").orderBy("session_no")
    days = days.withColumn("prev_close", F.lag("close_px").over(w))
    step = F.struct("clock", "price", "vwap", "sigma")
    plan = noise_sigma(grid, decisions, look_back).filter(c("sigma").isNotNull()).groupBy("symbol", "session").agg(
        F.sort_array(F.collect_list(step)).alias("steps"))
    ready = days.filter((c("session_no") > look_back) & c("prev_close").isNotNull()).join(plan, ["symbol", "session"], "left")
    hi, lo = F.greatest("open_px", "prev_close"), F.least("open_px", "prev_close")
    none = F.array().cast("array<struct<entered:int,exited:int,side:int,entry:double,exit:double>>")
    start = F.struct(F.lit(0).alias("side"), F.lit(0.0).alias("entry"), F.lit(0).alias("entered"), none.alias("trades"))

    def move(acc, x):
        up, down = hi * (1.0 + x.sigma), lo * (1.0 - x.sigma)
        out = ((acc.side == 1) & (x.price < F.greatest(up, x.vwap))) | ((acc.side == -1) & (x.price > F.least(down, x.vwap)))
        closed = F.array(F.struct(acc.entered.alias("entered"), x.clock.alias("exited"), acc.side.alias("side"),
                                  acc.entry.alias("entry"), x.price.alias("exit")))
        flat = out | (acc.side == 0)
        turn = F.when(flat & (x.price > up), 1).when(flat & (x.price < down), -1).otherwise(0)
        opened = turn != 0
        return F.struct(
            F.when(opened, turn).when(flat, 0).otherwise(acc.side).alias("side"),
            F.when(opened, x.price).otherwise(acc.entry).alias("entry"),
            F.when(opened, x.clock).otherwise(acc.entered).alias("entered"),
            F.when(out, F.concat(acc.trades, closed)).otherwise(acc.trades).alias("trades"))

    folded = ready.withColumn("_s", F.aggregate(F.coalesce("steps", F.array().cast(plan.schema["steps"].dataType)), start, move))
    last = F.array(F.struct(c("_s.entered").alias("entered"), c("last_clock").alias("exited"), c("_s.side").alias("side"),
                            c("_s.entry").alias("entry"), c("close_px").alias("exit")))
    trades = F.when(c("_s.side") != 0, F.concat("_s.trades", last)).otherwise(c("_s.trades"))
    return folded.select("symbol", "session", "session_no", "open_px", trades.alias("trades"))


def position_trades(sessions: DataFrame) -> DataFrame:
    """Session rows to one row per trade with its gross result per share."""
    flat = sessions.select("symbol", "session", F.inline("trades"))
    return flat.withColumn("gross", (c("exit") - c("entry")) * c("side"))


def equity_curve(sessions: DataFrame, warmup: int = 14, dynamic: bool = False, capital: float = 100_000.0,
                 target_vol: float = 0.02, max_lev: float = 4.0, cost: float = 0.0045) -> DataFrame:
    """Compound the session results of each symbol: one small row per session.

    The share count is fixed at the open from the running equity, so sessions
    are folded in order; the fold sees one row per (symbol, session) only.
    """
    per_share = sessions.withColumns({
        "gross": F.aggregate("trades", F.lit(0.0), lambda a, t: a + (t.exit - t.entry) * t.side),
        "count": F.size("trades")}).select("symbol", "session", "session_no", "open_px", "gross", "count")
    item = F.struct("session_no", "session", "gross", c("count").cast("long").alias("count"), "open_px")
    per_symbol = per_share.groupBy("symbol").agg(F.array_sort(F.collect_list(item)).alias("_days"))
    add = lambda acc, x: acc + x
    none = F.array().cast("array<struct<session:string,shares:bigint,trades:bigint,ret:double,equity:double>>")
    start = F.struct(F.lit(float(capital)).alias("aum"), F.array_repeat(F.lit(0.0), warmup).alias("recent"), none.alias("rows"))

    def let(value, body):
        """body(value) with the value computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def leverage(recent):
        def spread(mean):
            return F.sqrt(F.aggregate(F.transform(recent, lambda x: (x - mean) * (x - mean)), F.lit(0.0), add) / (warmup - 1))

        sd = let(F.aggregate(recent, F.lit(0.0), add) / warmup, spread)
        return let(sd, lambda v: F.when(v > 0, F.least(F.lit(float(max_lev)), target_vol / v)).otherwise(F.lit(float(max_lev))))

    def fold(acc, x):
        lev = leverage(acc.recent) if dynamic else F.lit(1.0)
        shares = F.when(x.open_px > 0, F.floor(acc.aum * lev / x.open_px)).otherwise(0).cast("long")

        def book(n):
            held = n > 0  # no position is opened without a whole share
            return let(F.when(held, (x.gross - 2.0 * cost * x["count"]) * n).otherwise(0.0), lambda pnl: after(n, held, pnl))

        def after(n, held, pnl):
            ret = F.when(acc.aum > 0, pnl / acc.aum).otherwise(0.0)
            row = F.struct(x.session.alias("session"), n.alias("shares"), F.when(held, x["count"]).otherwise(0).cast("long").alias("trades"),
                           ret.alias("ret"), (acc.aum + pnl).alias("equity"))
            recent = F.slice(F.concat(acc.recent, F.array(ret)), 2, warmup)
            return F.struct((acc.aum + pnl).alias("aum"), recent.alias("recent"), F.concat(acc.rows, F.array(row)).alias("rows"))

        return let(shares, book)

    return per_symbol.select("symbol", F.inline(F.aggregate("_days", start, fold)["rows"]))


def monthly_compound(days: DataFrame, by: list[str], month: Column, value: str) -> DataFrame:
    """Compounded return per calendar month, in percent."""
    lost = F.count_if(c(value) <= -1) > 0
    growth = F.exp(F.sum(F.when(c(value) > -1, F.log1p(value))))
    return days.groupBy(*by, month.alias("month")).agg(F.when(lost, -100.0).otherwise(100.0 * (growth - 1.0)).alias("ret_pct"))


def run_stats(curve: DataFrame, capital: float, least: int = 20) -> DataFrame:
    """Total, yearly return, volatility, Sharpe, drawdown, hit share, trades; NULL and too_few under `least` sessions."""
    w = Window.partitionBy("symbol").orderBy("session")
    peak = F.greatest(F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(capital))
    rows = curve.withColumn("_fall", 1.0 - c("equity") / peak)
    n = F.count(F.lit(1))
    total = F.max_by("equity", "session") / capital - 1.0
    vol = F.stddev_samp("ret") * math.sqrt(252)
    found = rows.groupBy("symbol").agg(
        n.alias("sessions"), total.alias("total"),
        F.when(total > -1, F.pow(1.0 + total, 252.0 / n) - 1.0).alias("irr"), vol.alias("vol"),
        F.when(vol > 0, F.avg("ret") * 252 / vol).alias("sharpe"), F.greatest(F.max("_fall"), F.lit(0.0)).alias("mdd"),
        F.avg((c("ret") > 0).cast("double")).alias("hit"), F.sum("trades").alias("trades"))
    few = c("sessions") < least
    return found.select("symbol", "sessions", *[F.when(~few, c(x)).alias(x) for x in ("total", "irr", "vol", "sharpe", "mdd", "hit", "trades")], few.alias("too_few"))
