"""Queries: daily legs, straddles, regimes and noise-area momentum."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.functions import stats as st
from tapewright.operators import indicators as ind
from tapewright.operators import studies as sd
from tapewright.operators.order import asof_join
from tapewright.functions import timecols as tc
from tapewright.plans import views
from tapewright.plans.q_bars import tidy
from tapewright.plans.registry import R, held, part, query
from tapewright.session import cut_lineage
from tapewright.sources import intraday as si

c = F.col

part("dser", """
    SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, first(o_totalprice ORDER BY o_orderkey) AS open,
           last(o_totalprice ORDER BY o_orderkey) AS close FROM orders GROUP BY 1, 2""")


def daily(spark, sf):
    """One open and close per order priority and date."""
    def make():
        orders = views.table(spark, sf, "orders")
        return cut_lineage(orders.groupBy(c("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close")))
    return held("daily", spark, sf, make)


def dated(df):
    """Dates as ISO text, as in the reports."""
    return tidy(df.withColumn("day", c("day").cast("string")))


part("legs", """
    SELECT symbol, day, ln(open / pc) AS overnight, ln(close / open) AS intraday, ln(close / pc) AS total FROM (
      SELECT *, lag(day) OVER w AS pd, lag(close) OVER w AS pc FROM dser WINDOW w AS (PARTITION BY symbol ORDER BY day))
    WHERE pd IS NOT NULL AND day - pd <= 5""")


@query("overnight_split", f"""
    SELECT symbol, CAST(day AS VARCHAR) AS day, {R('overnight')} AS overnight, {R('intraday')} AS intraday, {R('total')} AS total,
           abs(overnight + intraday - total) < 1e-12 AS identity FROM legs""")
def overnight_split(spark, sf):
    out = sd.overnight_split(daily(spark, sf))
    return dated(out.withColumn("identity", F.abs(c("overnight") + c("intraday") - c("total")) < 1e-12))


@query("cost_adjusted_legs", f"""
    SELECT symbol, count(*) AS n, {R('100.0 * (exp(avg(overnight - 0.0001) * 252) - 1.0)', 5)} AS overnight_ann, {R('100.0 * (exp(avg(intraday - 0.0001) * 252) - 1.0)', 5)} AS intraday_ann,
           {R('100.0 * (exp(avg(total) * 252) - 1.0)', 5)} AS hold_ann, {R('avg(overnight - 0.0001) / stddev_samp(overnight - 0.0001) * sqrt(252.0)')} AS overnight_sharpe,
           {R('avg(total) / stddev_samp(total) * sqrt(252.0)')} AS hold_sharpe, {R('1e4 * avg(overnight)', 5)} AS break_even_bp,
           {R('100.0 * (exp(avg(overnight - 0.0001) * 252) - 1.0) - 100.0 * (exp(avg(total) * 252) - 1.0)', 5)} AS edge
    FROM legs GROUP BY symbol""")
def cost_adjusted_legs(spark, sf):
    out = sd.cost_adjusted_legs(sd.overnight_split(daily(spark, sf)))
    five = lambda n: sh.r6(n, 5).alias(n)
    return tidy(out.select("symbol", "n", five("overnight_ann"), five("intraday_ann"), five("hold_ann"), "overnight_sharpe",
                           "hold_sharpe", five("break_even_bp"), five("edge")))


@query("correlation", f"SELECT symbol, {R('corr(overnight, intraday)')} AS correlation FROM legs GROUP BY symbol")
def correlation(spark, sf):
    legs = sd.overnight_split(daily(spark, sf))
    return tidy(legs.groupBy("symbol").agg(F.corr("overnight", "intraday").alias("correlation")))


# Raw archive rows: half-hour bars with a one-tick bar printing no close.
def raw_rows(spark, sf):
    b = views.bar_table(spark, sf)
    start = F.date_format(tc.utc_wall(c("ts")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(c("minute") < 570, "pr").when(c("minute") < 960, "r").otherwise("po")
    text = lambda n: c(n).cast("string").alias(n)
    return b.select("symbol", c("session").alias("day"), start.alias("start_time"), kind.alias("market_time"),
                    text("open"), text("high"), text("low"), F.when(c("volume") == 1, "n/a").otherwise(c("close").cast("string")).alias("close"),
                    F.when(c("volume") != 2, c("volume").cast("string")).alias("volume"))


part("raw_b", """
    SELECT *, CASE WHEN minute < 570 THEN 'pr' WHEN minute < 960 THEN 'r' ELSE 'po' END AS kind,
           CASE WHEN volume <> 1 THEN close END AS rc, CASE WHEN volume <> 2 THEN volume ELSE 0.0 END AS rvol FROM b""")
part("prints", """
    SELECT symbol, CAST(session AS DATE) AS day, arg_min(open, ts) FILTER (WHERE kind = 'r') AS rth_open,
           first(rc ORDER BY ts DESC) FILTER (WHERE kind = 'r') AS rth_close, arg_min(open, ts) FILTER (WHERE kind = 'pr') AS pre_first,
           first(rc ORDER BY ts DESC) FILTER (WHERE kind = 'po') AS post_last, count(*) FILTER (WHERE kind = 'r') AS n
    FROM raw_b GROUP BY symbol, session""")
part("prints_ok", "SELECT * FROM prints WHERE n >= 6 AND rth_open > 0 AND rth_close > 0")


@query("read_intraday_json", """
    SELECT symbol, ts, open, high, low, close, rvol AS volume, session, minute FROM raw_b WHERE kind = 'r' AND rc IS NOT NULL""")
def read_intraday_json(spark, sf):
    return tidy(si.intraday_bars(raw_rows(spark, sf)))


@query("read_intraday_extended", "SELECT symbol, CAST(day AS VARCHAR) AS day, rth_open, rth_close, pre_first, post_last FROM prints_ok")
def read_intraday_extended(spark, sf):
    return dated(si.day_prints(raw_rows(spark, sf), 6))


@query("overnight_subwindows", f"""
    SELECT symbol, CAST(day AS VARCHAR) AS day, {R('ln(pp / pc)')} AS post_close, {R('ln(pre_first / pp)')} AS true_gap, {R('ln(rth_open / pre_first)')} AS pre_open
    FROM (SELECT *, lag(day) OVER w AS pd, lag(rth_close) OVER w AS pc, lag(post_last) OVER w AS pp
          FROM (SELECT * FROM (SELECT *, lag(day) OVER (PARTITION BY symbol ORDER BY day) AS d0 FROM prints_ok) WHERE day - d0 <= 5)
          WINDOW w AS (PARTITION BY symbol ORDER BY day))
    WHERE day - pd <= 5 AND pp > 0 AND pre_first > 0 AND pc > 0 AND rth_open > 0""")
def overnight_subwindows(spark, sf):
    return dated(sd.overnight_subwindows(si.day_prints(raw_rows(spark, sf), 6)))


# --- returns -----------------------------------------------------------------

part("rets_all", """
    SELECT symbol, session, ts, CASE WHEN n >= 20 THEN ret END AS ret, n < 20 AS too_few FROM (
      SELECT symbol, session, ts, ln(close / lag(close) OVER (PARTITION BY symbol, session ORDER BY ts)) AS ret, count(*) OVER (PARTITION BY symbol, session) AS n FROM b WHERE close > 0) WHERE ret IS NOT NULL""")
part("rets", "SELECT symbol, session, ts, ret FROM rets_all WHERE NOT too_few")
part("ret_days", "SELECT DISTINCT symbol, session FROM rets_all")


def returns(spark, sf):
    return sd.log_returns(views.bar_table(spark, sf), 20)


@query("log_returns", f"SELECT symbol, session, ts, {R('ret')} AS ret, too_few FROM rets_all")
def log_returns(spark, sf):
    return tidy(returns(spark, sf))


@query("variance_ratio", f"""
    SELECT d.symbol, d.session, coalesce(v.blocks, 0) AS blocks, v.variance_ratio, v.blocks IS NULL AS too_few FROM ret_days d LEFT JOIN (
    SELECT symbol, session, count(*) AS blocks, {R('var_samp(s) / (2 * any_value(v1))')} AS variance_ratio FROM (
      SELECT symbol, session, (rn - 1) // 2 AS blk, sum(ret) AS s, any_value(v1) AS v1 FROM (
        SELECT *, var_samp(ret) OVER (PARTITION BY symbol, session) AS v1 FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol, session) AS m FROM rets)
        WHERE m // 2 >= 8 AND rn <= (m // 2) * 2) GROUP BY ALL) GROUP BY symbol, session) v ON v.symbol = d.symbol AND v.session = d.session""")
def variance_ratio(spark, sf):
    return tidy(sd.variance_ratio(returns(spark, sf), 2))


@query("autocorr1", f"""
    SELECT symbol, session, count(ret) AS n, {R('CASE WHEN count(ret) >= 30 THEN sum(d * p) / sum(d * d) END')} AS autocorr, count(ret) < 30 AS too_few FROM (
      SELECT *, lag(d) OVER (PARTITION BY symbol, session ORDER BY ts) AS p FROM (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol, session) AS d FROM rets_all)) GROUP BY symbol, session""")
def autocorr1(spark, sf):
    return tidy(sd.autocorr1(returns(spark, sf)))


@query("realised_vol", f"""
    SELECT symbol, session, {R('vol')} AS vol, too_few, {R('last_value(vol IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS prev_vol FROM (
      SELECT symbol, session, CASE WHEN count(ret) > 24 THEN stddev_samp(ret) * sqrt(390.0) * 100 END AS vol, count(ret) <= 24 AS too_few FROM rets_all GROUP BY symbol, session)""")
def realised_vol(spark, sf):
    return tidy(sd.realised_vol(returns(spark, sf), 24))


part("rolling", """
    SELECT symbol, day, CASE WHEN count(*) OVER w = 22 THEN stddev_samp(ret) OVER w * sqrt(252.0) * 100 END AS vol FROM (
      SELECT symbol, day, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS ret FROM dser) WHERE ret IS NOT NULL
    WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)""")


@query("rolling_realised_vol", f"SELECT symbol, CAST(day AS VARCHAR) AS day, {R('vol', 5)} AS vol FROM rolling")
def rolling_realised_vol(spark, sf):
    out = sd.rolling_realised_vol(daily(spark, sf))
    return dated(out.withColumn("vol", sh.r6("vol", 5)))


@query("overlap_corrected_se", f"""
    SELECT symbol, count(vol) AS n, {R('stddev_samp(vol) / sqrt(count(vol))')} AS naive_se, {R('stddev_samp(vol) / sqrt(count(vol) / 22.0)')} AS corrected_se
    FROM rolling GROUP BY symbol""")
def overlap_corrected_se(spark, sf):
    vols = sd.rolling_realised_vol(daily(spark, sf))
    return tidy(vols.groupBy("symbol").agg(
        F.count("vol").alias("n"), (F.stddev_samp("vol") / F.sqrt(F.count("vol"))).alias("naive_se"),
        st.overlap_corrected_se(c("vol"), 22).alias("corrected_se")))


@query("monthly_compound", f"""
    SELECT symbol, strftime(day, '%Y-%m') AS month, {R('100.0 * (exp(sum(ln(1.0 + r))) - 1.0)', 4)} AS ret_pct
    FROM (SELECT symbol, day, close / open - 1.0 AS r FROM dser) GROUP BY ALL""")
def monthly_compound(spark, sf):
    days = daily(spark, sf).withColumn("r", c("close") / c("open") - 1.0)
    out = sd.monthly_compound(days, ["symbol"], F.date_format("day", "yyyy-MM"), "r")
    return tidy(out, 4)


part("dd", """
    SELECT symbol, max(1.0 - eq / greatest(peak, 100000.0)) AS dd FROM (
      SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY day) AS peak FROM (
        SELECT symbol, day, close AS eq FROM dser)) GROUP BY symbol""")


@query("max_drawdown", f"SELECT symbol, {R('greatest(dd, 0.0)')} AS max_drawdown FROM dd")
def max_drawdown(spark, sf):
    return tidy(ind.max_drawdown(daily(spark, sf), "symbol", "day", "close", 100_000.0))


# --- straddles ----------------------------------------------------------------
# Spot is the daily close of a priority; its volatility level is the close of the priority two further on.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LEVEL_OF = {PRIORITIES[(k + 2) % 5]: p for k, p in enumerate(PRIORITIES)}
part("spot", "SELECT symbol, day, close AS spot FROM dser")
part("voll", "SELECT CASE symbol " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEVEL_OF.items()) + " END AS symbol, day, close / 10000.0 AS level FROM dser")
part("strd", """
    SELECT symbol, day, level / 100.0 AS implied, 0.7979 * (level / 100.0) * sqrt(1.0 / 252.0) AS straddle, abs((nx - spot) / spot) AS payoff,
           abs((nx - spot) / spot) - 0.7979 * (level / 100.0) * sqrt(1.0 / 252.0) * 1.02 AS pnl
    FROM (SELECT s.symbol, s.day, s.spot, v.level, lead(s.spot) OVER (PARTITION BY s.symbol ORDER BY s.day) AS nx
          FROM spot s JOIN voll v ON v.symbol = s.symbol AND v.day = s.day)
    WHERE spot > 0 AND nx > 0 AND level > 0""")


def straddles(spark, sf):
    d = daily(spark, sf)
    spot = d.select("symbol", "day", c("close").alias("spot"))
    name = F.create_map(*[F.lit(x) for pair in LEVEL_OF.items() for x in pair])[c("symbol")]
    vol = d.select(name.alias("symbol"), "day", (c("close") / 10000.0).alias("level"))
    return sd.vol_spot_join(spot, vol)


@query("vol_spot_join", f"""
    SELECT symbol, CAST(day AS VARCHAR) AS day, {R('implied', 9)} AS implied, {R('straddle')} AS straddle, {R('payoff')} AS payoff, {R('pnl')} AS pnl FROM strd""")
def vol_spot_join(spark, sf):
    out = straddles(spark, sf)
    return out.select("symbol", c("day").cast("string").alias("day"), sh.r6("implied", 9).alias("implied"),
                      *[sh.r6(n).alias(n) for n in ("straddle", "payoff", "pnl")])


SERIES = {"vix": ("1-URGENT", "open"), "vix9d": ("2-HIGH", "open"), "vix3m": ("3-MEDIUM", "open"),
          "vvix": ("4-NOT SPECIFIED", "open"), "skew": ("5-LOW", "close")}
part("lvl", " UNION BY NAME ".join(
    f"SELECT '{n}' AS series, day, {col} / 10000.0 AS level FROM dser WHERE symbol = '{sym}'" for n, (sym, col) in SERIES.items()))
part("lvl_wide", "SELECT day, " + ", ".join(f"max(CASE WHEN series = '{n}' THEN level END) AS {n}" for n in SERIES) + " FROM lvl GROUP BY day")
part("preds", """
    SELECT symbol, day, pnl, p.predictor, p.value FROM (
      SELECT s.symbol, s.day, s.pnl, unnest([
        {'predictor': 'implied', 'value': s.implied * 100.0}, {'predictor': 'implied_over_vix', 'value': s.implied * 100.0 / w.vix},
        {'predictor': 'vix9d_over_vix', 'value': w.vix9d / w.vix}, {'predictor': 'vix_over_vix3m', 'value': w.vix / w.vix3m},
        {'predictor': 'vvix', 'value': w.vvix}, {'predictor': 'skew', 'value': w.skew}]) AS p
      FROM strd s LEFT JOIN lvl_wide w ON w.day = s.day) WHERE p.value IS NOT NULL""")


def levels(spark, sf):
    """The five level series, unpivoted from one pass over the daily table."""
    rows = F.array(*[F.struct(F.lit(sym).alias("sym"), F.lit(n).alias("series"), (c(col) / 10000.0).alias("level"))
                     for n, (sym, col) in SERIES.items()])
    return daily(spark, sf).select("symbol", "day", F.inline(rows)).filter(c("symbol") == c("sym")).select("day", "series", "level")


def predictors(spark, sf):
    return sd.vol_ratio_predictors(straddles(spark, sf), levels(spark, sf))


@query("vol_ratio_predictors", f"SELECT symbol, CAST(day AS VARCHAR) AS day, predictor, {R('value')} AS value, {R('pnl')} AS pnl FROM preds")
def vol_ratio_predictors(spark, sf):
    return dated(predictors(spark, sf).select("symbol", "day", "predictor", "value", "pnl"))


@query("deciles", f"""
    SELECT symbol, predictor, (10 * rn - 1) // n + 1 AS decile, count(*) AS n, {R('avg(pnl)')} AS mean, {R('stddev_samp(pnl) / sqrt(count(*))')} AS se,
           {R('avg(pnl) / (stddev_samp(pnl) / sqrt(count(*)))')} AS t, {R('min(value)')} AS lo, {R('max(value)')} AS hi, false AS too_few
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol, predictor ORDER BY value, day) AS rn, count(*) OVER (PARTITION BY symbol, predictor) AS n FROM preds)
    WHERE n >= 200 GROUP BY symbol, predictor, (10 * rn - 1) // n
    UNION ALL SELECT symbol, predictor, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM preds GROUP BY symbol, predictor HAVING count(*) < 200""")
def deciles(spark, sf):
    return tidy(sd.deciles(predictors(spark, sf), ["symbol", "predictor"], "value", "pnl", "day"))


@query("terciles", f"""
    SELECT symbol, least((rn - 1) // (n // 3), 2) AS tercile, count(*) AS n, {R('avg(pnl)')} AS mean, {R('stddev_samp(pnl) / sqrt(count(*))')} AS se,
           {R('avg(pnl) / (stddev_samp(pnl) / sqrt(count(*)))')} AS t
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY implied, day) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM strd)
    GROUP BY symbol, least((rn - 1) // (n // 3), 2)""")
def terciles(spark, sf):
    return tidy(sd.terciles(straddles(spark, sf), ["symbol"], "implied", "pnl", "day"))


# --- regimes ------------------------------------------------------------------
# A dealer reading per line number and ship date.
part("gamma", "SELECT CASE l_linenumber % 5 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PRIORITIES)) + """ END AS symbol, CAST(l_shipdate AS DATE) AS day,
           round(avg(l_discount) - avg(l_tax), 9) AS reading FROM lineitem GROUP BY 1, 2""")
part("regime", """
    SELECT s.symbol, s.day, s.open, s.close, g.reading FROM dser s ASOF JOIN gamma g ON g.symbol = s.symbol AND s.day > g.day""")


def readings(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    name = F.get(F.array(*map(F.lit, PRIORITIES)), (c("l_linenumber") % 5).cast("int"))
    return lines.groupBy(name.alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(
        F.round(F.avg("l_discount") - F.avg("l_tax"), 9).alias("reading"))


def regimes(spark, sf):
    """Each day with the last reading held strictly before it."""
    def make():
        probe = daily(spark, sf).withColumn("_d", F.unix_date("day"))
        ref = readings(spark, sf).select("symbol", F.unix_date("day").alias("_rd"), F.struct("reading").alias("prior"))
        out = asof_join(probe, ref, "symbol", "_d", "_rd", "prior", span=64, strict=True)
        return cut_lineage(out.filter(c("prior").isNotNull()).select("symbol", "day", "open", "close", c("prior.reading").alias("reading")))
    return held("regimes", spark, sf, make)


@query("prior_value_asof", f"SELECT symbol, CAST(day AS VARCHAR) AS day, {R('reading')} AS reading FROM regime")
def prior_value_asof(spark, sf):
    return dated(regimes(spark, sf).select("symbol", "day", "reading"))


part("rstr", "SELECT r.symbol, r.reading, r.day, s.pnl FROM regime r JOIN strd s ON s.symbol = r.symbol AND s.day = r.day")


@query("regime_straddle_join", f"""
    SELECT symbol, least((rn - 1) // (n // 3), 2) AS tercile, count(*) AS n, {R('avg(pnl)')} AS mean, {R('stddev_samp(pnl) / sqrt(count(*))')} AS se,
           {R('avg(pnl) / (stddev_samp(pnl) / sqrt(count(*)))')} AS t, false AS too_few
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY reading, day) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM rstr) WHERE n >= 60 GROUP BY symbol, least((rn - 1) // (n // 3), 2)
    UNION ALL SELECT symbol, NULL, NULL, NULL, NULL, NULL, true FROM rstr GROUP BY symbol HAVING count(*) < 60""")
def regime_straddle_join(spark, sf):
    return tidy(sd.regime_straddle_join(regimes(spark, sf), straddles(spark, sf)))


_w = lambda x, f: f"""(avg({x}) FILTER (WHERE {f}) - avg({x}) FILTER (WHERE NOT ({f}))) / nullif(sqrt(var_samp({x}) FILTER (WHERE {f}) / count(*) FILTER (WHERE {f})
      + var_samp({x}) FILTER (WHERE NOT ({f})) / count(*) FILTER (WHERE NOT ({f}))), 0)"""  # noqa: E731


@query("group_gradient", f"""
    SELECT symbol, count(*) FILTER (WHERE reading > 0) AS n_a, count(*) FILTER (WHERE NOT (reading > 0)) AS n_b,
           {R('avg(v) FILTER (WHERE reading > 0) - avg(v) FILTER (WHERE NOT (reading > 0))')} AS diff, {R(_w('v', 'reading > 0'))} AS t,
           {R('avg(v) FILTER (WHERE k = 0)')} AS low_mean, {R('avg(v) FILTER (WHERE k = 1)')} AS mid_mean, {R('avg(v) FILTER (WHERE k = 2)')} AS high_mean
    FROM (SELECT *, least((rn - 1) // (n // 3), 2) AS k FROM (
      SELECT *, abs(ln(close / open)) AS v, row_number() OVER (PARTITION BY symbol ORDER BY reading, day) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM regime))
    GROUP BY symbol""")
def group_gradient(spark, sf):
    rows = regimes(spark, sf).withColumn("v", F.abs(F.log(c("close") / c("open"))))
    return tidy(sd.group_gradient(rows, ["symbol"], "reading", "v", "day"))


part("ctrl", """
    SELECT * FROM (SELECT symbol, day, reading AS g, abs(ln(close / open)) AS tv, lag(abs(ln(close / open))) OVER (PARTITION BY symbol ORDER BY day) AS pv FROM regime)
    WHERE pv IS NOT NULL""")
part("strata", f"""
    SELECT symbol, stratum, count(*) FILTER (WHERE g > med) AS n_a, count(*) FILTER (WHERE NOT (g > med)) AS n_b,
           avg(tv) FILTER (WHERE g > med) - avg(tv) FILTER (WHERE NOT (g > med)) AS diff, {_w('tv', 'g > med')} AS t
    FROM (SELECT *, median(g) OVER (PARTITION BY symbol, stratum) AS med FROM (
      SELECT *, least((rn - 1) // (n // 3), 2) AS stratum FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pv, day) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM ctrl) WHERE n >= 60))
    GROUP BY symbol, stratum""")


def control(spark, sf):
    v = F.abs(F.log(c("close") / c("open")))
    rows = regimes(spark, sf).select("symbol", "day", c("reading").alias("g"), v.alias("tv"))
    rows = rows.withColumn("pv", F.lag("tv").over(sd.day_w())).filter(c("pv").isNotNull())
    return sd.stratified_control(rows, ["symbol"])


@query("stratified_control", f"""
    SELECT symbol, stratum, n_a, n_b, {R('diff')} AS diff, {R('t')} AS t, false AS too_few FROM strata
    UNION ALL SELECT symbol, NULL, NULL, NULL, NULL, NULL, true FROM ctrl GROUP BY symbol HAVING count(*) < 60""")
def stratified_control(spark, sf):
    return tidy(control(spark, sf))


@query("stouffer", f"SELECT symbol, {R('sum(t) / sqrt(count(t))')} AS z FROM strata GROUP BY symbol")
def stouffer(spark, sf):
    return tidy(control(spark, sf).groupBy("symbol").agg(st.stouffer(c("t")).alias("z")))


# --- noise-area momentum --------------------------------------------------------
DECISIONS = list(range(600, 931, 30))
part("sgrid", """
    SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY session) AS sno FROM (
      SELECT symbol, session, 570 + 30 * row_number() OVER w AS clock, close AS price, count(*) OVER (PARTITION BY symbol, session) AS n,
             sum((high + low + close) / 3.0 * volume) OVER w / sum(volume) OVER w AS vwap,
             first_value(open) OVER w AS open_px, arg_max(close, ts) OVER (PARTITION BY symbol, session) AS close_px
      FROM b WHERE minute >= 570 AND minute < 960 WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)) WHERE n >= 6""")
part("sig_t", """
    SELECT *, CASE WHEN sno > 14 THEN avg(abs(price / open_px - 1.0)) OVER (PARTITION BY symbol, clock ORDER BY sno RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) END AS sigma
    FROM sgrid WHERE clock BETWEEN 600 AND 930""")
part("sday", """
    SELECT symbol, session, sno, any_value(open_px) AS open_px, any_value(close_px) AS close_px, 570 + 30 * any_value(n) AS last_clock FROM sgrid GROUP BY ALL""")
part("sdays", "SELECT * FROM (SELECT *, lag(close_px) OVER (PARTITION BY symbol ORDER BY sno) AS prev_close FROM sday) WHERE sno > 14 AND prev_close IS NOT NULL")
part("steps", """
    SELECT d.symbol, d.session, d.last_clock, d.close_px, row_number() OVER (PARTITION BY d.symbol, d.session ORDER BY t.clock) AS k, t.clock, t.price, t.vwap,
           greatest(d.open_px, d.prev_close) * (1.0 + t.sigma) AS up, least(d.open_px, d.prev_close) * (1.0 - t.sigma) AS dn
    FROM sdays d JOIN sig_t t ON t.symbol = d.symbol AND t.session = d.session WHERE t.sigma IS NOT NULL""")
part("pos_walk", """
    SELECT symbol, session, CAST(0 AS BIGINT) AS k, 0 AS side, 0.0::DOUBLE AS entry, CAST(0 AS BIGINT) AS entered, 0 AS c_side, 0.0::DOUBLE AS c_entry, CAST(0 AS BIGINT) AS c_entered,
           0.0::DOUBLE AS c_exit, CAST(0 AS BIGINT) AS c_exited FROM sdays
    UNION ALL
    SELECT symbol, session, k, CASE WHEN turn <> 0 THEN turn WHEN flat THEN 0 ELSE side END, CASE WHEN turn <> 0 THEN price ELSE entry END, CASE WHEN turn <> 0 THEN clock ELSE entered END,
           CASE WHEN outs THEN side ELSE 0 END, entry, entered, price, clock
    FROM (SELECT *, CASE WHEN flat AND price > up THEN 1 WHEN flat AND price < dn THEN -1 ELSE 0 END AS turn FROM (
      SELECT *, outs OR side = 0 AS flat FROM (
        SELECT s.symbol, s.session, s.k, s.clock, s.price, s.up, s.dn, w.side, w.entry, w.entered,
               (w.side = 1 AND s.price < greatest(s.up, s.vwap)) OR (w.side = -1 AND s.price > least(s.dn, s.vwap)) AS outs
        FROM pos_walk w JOIN steps s ON s.symbol = w.symbol AND s.session = w.session AND s.k = w.k + 1)))""")
part("pos_trades", """
    SELECT symbol, session, c_entered AS entered, c_exited AS exited, c_side AS side, c_entry AS entry, c_exit AS "exit" FROM pos_walk WHERE c_side <> 0
    UNION BY NAME
    SELECT w.symbol, w.session, w.entered, d.last_clock AS exited, w.side, w.entry, d.close_px AS "exit"
    FROM (SELECT * FROM pos_walk QUALIFY row_number() OVER (PARTITION BY symbol, session ORDER BY k DESC) = 1) w
    JOIN sdays d ON d.symbol = w.symbol AND d.session = w.session WHERE w.side <> 0""")


def grid(spark, sf):
    rth = tc.filter_rth(views.bar_table(spark, sf))
    return held("grid", spark, sf, lambda: cut_lineage(sd.session_grid(rth, 6, 30)))


@query("session_grid", f"""
    SELECT symbol, session, sno AS session_no, clock, price, {R('vwap')} AS vwap, open_px, close_px, 570 + 30 * n AS last_clock FROM sgrid""")
def session_grid(spark, sf):
    return tidy(grid(spark, sf))


@query("noise_sigma", f"SELECT symbol, session, clock, {R('sigma')} AS sigma FROM sig_t")
def noise_sigma(spark, sf):
    return tidy(sd.noise_sigma(grid(spark, sf), DECISIONS).select("symbol", "session", "clock", "sigma"))


@query("noise_area_positions", f"""
    SELECT symbol, session, entered, exited, CAST(side AS BIGINT) AS side, {R('entry')} AS entry, {R('"exit"')} AS "exit", {R('("exit" - entry) * side')} AS gross FROM pos_trades""")
def noise_area_positions(spark, sf):
    return tidy(sd.position_trades(sd.noise_area_positions(grid(spark, sf), DECISIONS)))


part("day_sum", """
    SELECT d.symbol, d.session, d.open_px, row_number() OVER (PARTITION BY d.symbol ORDER BY d.sno) AS k, coalesce(t.gross, 0.0) AS gross, coalesce(t.n, 0) AS n
    FROM sdays d LEFT JOIN (SELECT symbol, session, sum(("exit" - entry) * side) AS gross, count(*) AS n FROM pos_trades GROUP BY ALL) t
    ON t.symbol = d.symbol AND t.session = d.session""")
part("eq_walk", """
    SELECT symbol, CAST(0 AS BIGINT) AS k, '' AS session, 100000.0::DOUBLE AS equity, 0.0::DOUBLE AS ret, CAST(0 AS BIGINT) AS shares, CAST(0 AS BIGINT) AS trades,
           list_transform(range(14), lambda x: 0.0::DOUBLE) AS recent FROM (SELECT DISTINCT symbol FROM day_sum)
    UNION ALL
    SELECT symbol, k, session, equity + pnl, CASE WHEN equity > 0 THEN pnl / equity ELSE 0.0 END, shares, CASE WHEN shares > 0 THEN n ELSE 0 END, list_append(recent[2:], CASE WHEN equity > 0 THEN pnl / equity ELSE 0.0 END)
    FROM (SELECT *, CASE WHEN shares > 0 THEN (gross - 0.009 * n) * shares ELSE 0.0 END AS pnl FROM (
      SELECT w.symbol, d.k, d.session, w.equity, w.recent, d.gross, d.n,
             CAST(floor(w.equity * CASE WHEN list_aggregate(w.recent, 'stddev_samp') > 0 THEN least(4.0, 0.02 / list_aggregate(w.recent, 'stddev_samp')) ELSE 4.0 END / d.open_px) AS BIGINT) AS shares
      FROM eq_walk w JOIN day_sum d ON d.symbol = w.symbol AND d.k = w.k + 1))""")


def curve(spark, sf):
    return sd.equity_curve(sd.noise_area_positions(grid(spark, sf), DECISIONS), dynamic=True)


@query("equity_curve", f"SELECT symbol, session, shares, trades, {R('ret')} AS ret, {R('equity', 3)} AS equity FROM eq_walk WHERE k > 0")
def equity_curve(spark, sf):
    out = curve(spark, sf)
    return tidy(out.withColumn("equity", sh.r6("equity", 3)))


@query("run_stats", """
    SELECT symbol, sessions, sessions < 10 AS too_few, """ + ", ".join(f"CASE WHEN sessions >= 10 THEN {x} END AS {x}" for x in ("total", "irr", "vol", "sharpe", "mdd", "hit", "trades")) + f""" FROM (
    SELECT symbol, count(*) AS sessions, {R('arg_max(equity, session) / 100000.0 - 1.0')} AS total, {R('CASE WHEN arg_max(equity, session) > 0 THEN pow(arg_max(equity, session) / 100000.0, 252.0 / count(*)) - 1.0 END')} AS irr,
           {R('stddev_samp(ret) * sqrt(252.0)')} AS vol, {R('CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) * 252 / (stddev_samp(ret) * sqrt(252.0)) END')} AS sharpe,
           {R('greatest(max(1.0 - equity / greatest(peak, 100000.0)), 0.0)')} AS mdd, {R('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)')} AS hit, CAST(sum(trades) AS BIGINT) AS trades
    FROM (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY k) AS peak FROM eq_walk WHERE k > 0) GROUP BY symbol)""")
def run_stats(spark, sf):
    return tidy(sd.run_stats(curve(spark, sf), 100_000.0, 10))
