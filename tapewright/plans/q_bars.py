"""Queries: time columns, bar shapes, filters, resampling, indicators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.functions import timecols as tc
from tapewright.operators import bars as ob
from tapewright.operators import calendar as cal
from tapewright.operators import indicators as ind
from tapewright.operators import order
from tapewright.operators import quality as qa
from tapewright.plans import views
from tapewright.plans.registry import R, held, part, query
from tapewright.session import cut_lineage

c = F.col


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Report form: whole numbers as LONG, doubles rounded."""
    cols = []
    for name, kind in df.dtypes:
        col = c(name)
        if kind in ("int", "smallint", "tinyint"):
            col = col.cast("long")
        elif kind == "double":
            col = sh.r6(col, places)
        cols.append(col.alias(name))
    return df.select(*cols)


BARS_OUT = "symbol, ts, open, high, low, close, volume, session, minute"


@query("ny_time_columns", """
    SELECT id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts, CAST(CAST(ny AS DATE) AS VARCHAR) AS session,
           hour(ny) * 60 + minute(ny) AS minute FROM ny_ticks""")
def ny_time_columns(spark, sf):
    t = views.ticks(spark, sf).withColumn("ts", tc.epoch_seconds(c("ts")))
    return tidy(tc.ny_time_columns(t).select("id", "ts", "session", "minute"))


@query("trading_date", """
    SELECT id, CAST(CAST(ny + INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS trading_date FROM ny_ticks""")
def trading_date(spark, sf):
    ny = tc.to_ny(c("ts"))
    return views.ticks(spark, sf).select("id", tc.trading_date(ny).alias("trading_date"))


@query("bar_shape_columns", f"""
    SELECT symbol, ts, {R('high - low')} AS "range", greatest(open, close) AS body_top, least(open, close) AS body_bottom,
           {R('CASE WHEN high > low THEN (greatest(open, close) - least(open, close)) / (high - low) ELSE 0.0 END')} AS body_fraction,
           close > open AS is_up, close < open AS is_down,
           {R('CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END')} AS close_position
    FROM bars""")
def bar_shape_columns(spark, sf):
    out = sh.bar_shape_columns(views.bars30(spark, sf))
    return tidy(out.drop("open", "high", "low", "close", "volume", "session", "minute"))


@query("true_range", f"SELECT symbol, ts, {R('tr')} AS tr FROM trs")
def true_range(spark, sf):
    return tidy(ind.true_range(views.indexed(spark, sf)).select("symbol", "ts", "tr"))


@query("rel_err", f"""
    SELECT a.symbol, a.month, {R('abs(a.close - b.close) / greatest(abs(a.close), abs(b.close), 1e-9)')} AS err
    FROM pnl_odd a JOIN pnl_even b ON a.symbol = b.symbol AND a.month = b.month""")
def rel_err(spark, sf):
    a = views.panel(spark, sf, "l_linenumber % 2 = 1")
    b = views.panel(spark, sf, "l_linenumber % 2 = 0").withColumnRenamed("close", "other")
    return tidy(a.join(b, ["symbol", "month"]).select("symbol", "month", sh.rel_err(c("close"), c("other")).alias("err")))


@query("resample_bars", f"""
    SELECT symbol, CAST(epoch((CAST(d AS TIMESTAMP) + to_minutes(CAST(570 + g * 45 AS BIGINT))) AT TIME ZONE 'America/New_York') AS BIGINT) AS ts,
           open, high, low, close, volume, CAST(d AS VARCHAR) AS session, CAST((570 + g * 45 + 1440) % 1440 AS BIGINT) AS minute
    FROM (SELECT symbol, CAST(session AS DATE) AS d, CAST(floor((minute - 570) / 45.0) AS BIGINT) AS g,
                 first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close,
                 sum(volume) AS volume FROM bars_15 GROUP BY ALL)""")
def resample_bars(spark, sf):
    return tidy(ob.resample_bars(views.bars15(spark, sf), 45))


@query("tick_bars", f"SELECT {BARS_OUT} FROM bars")
def tick_bars(spark, sf):
    return tidy(views.bars30(spark, sf))


@query("bucket_key", """
    SELECT id, CAST(CAST(ny AS DATE) AS VARCHAR) AS session, b AS bucket,
           CAST(epoch((date_trunc('day', ny) + to_minutes(570 + b * 45)) AT TIME ZONE 'America/New_York') AS BIGINT) AS bucket_ts
    FROM (SELECT *, CAST(floor((hour(ny) * 60 + minute(ny) - 570) / 45.0) AS BIGINT) AS b FROM ny_ticks)""")
def bucket_key(spark, sf):
    ny = tc.to_ny(c("ts"))
    keyed = views.ticks(spark, sf).select("id", tc.iso_date(ny).alias("session"),
                                          tc.bucket_index(tc.minute_of_day(ny), 45).alias("bucket"))
    return tidy(keyed.withColumn("bucket_ts", tc.bucket_start(c("session"), c("bucket"), 45)))


@query("infer_timeframe", """
    SELECT symbol, arg_max(gap, n * 1e12 - first_ts) AS timeframe FROM (
      SELECT symbol, gap, count(*) AS n, min(ts) AS first_ts FROM (
        SELECT symbol, ts, CAST(floor((ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) / 60) AS BIGINT) AS gap FROM bars_15)
      WHERE gap > 0 GROUP BY symbol, gap) GROUP BY symbol""")
def infer_timeframe(spark, sf):
    return ob.infer_timeframe(views.bars15(spark, sf))


# A session spec per bar, so that specs live in a column.
part("specs", """
    SELECT symbol, ts, minute, lpad(CAST(s // 60 AS VARCHAR), 2, '0') || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '-' ||
           lpad(CAST(e // 60 AS VARCHAR), 2, '0') || lpad(CAST(e % 60 AS VARCHAR), 2, '0') AS spec
    FROM (SELECT *, (day_pos * 120 + session_no * 30) % 1440 AS s, (day_pos * 120 + session_no * 30 + 480) % 1440 AS e FROM b)""")
part("spec_bounds", """
    SELECT *, CAST(substr(spec, 1, 2) AS BIGINT) * 60 + CAST(substr(spec, 3, 2) AS BIGINT) AS start_min,
           CASE WHEN substr(spec, 6, 4) = '0000' THEN 1440
                ELSE CAST(substr(spec, 6, 2) AS BIGINT) * 60 + CAST(substr(spec, 8, 2) AS BIGINT) END AS end_min
    FROM specs""")


def _specs(spark, sf):
    b = views.indexed(spark, sf)
    s = F.pmod(c("day_pos") * 120 + c("session_no") * 30, F.lit(1440))
    e = F.pmod(s + 480, F.lit(1440))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    spec = F.concat(two(s / 60), two(F.pmod(s, F.lit(60))), F.lit("-"), two(e / 60), two(F.pmod(e, F.lit(60))))
    return b.select("symbol", "ts", "minute", spec.alias("spec"))


@query("parse_session", "SELECT symbol, ts, spec, start_min, end_min FROM spec_bounds")
def parse_session(spark, sf):
    start, end = tc.session_bounds(c("spec"))
    return tidy(_specs(spark, sf).select("symbol", "ts", "spec", start.alias("start_min"), end.alias("end_min")))


@query("in_window", """
    SELECT symbol, ts, spec, CASE WHEN start_min <= end_min THEN minute >= start_min AND minute < end_min
           ELSE minute >= start_min OR minute < end_min END AS inside FROM spec_bounds""")
def in_window(spark, sf):
    start, end = tc.session_bounds(c("spec"))
    return _specs(spark, sf).select("symbol", "ts", "spec", tc.in_window(c("minute"), start, end).alias("inside"))


@query("in_session", """
    SELECT symbol, ts, minute >= 570 AND minute < 960 AS ny, minute >= 1080 AS asia, minute >= 1320 OR minute < 180 AS overnight
    FROM bars""")
def in_session(spark, sf):
    m = c("minute")
    return views.bars30(spark, sf).select(
        "symbol", "ts", tc.in_session(m, "0930-1600").alias("ny"), tc.in_session(m, "1800-0000").alias("asia"),
        tc.in_session(m, "2200-0300").alias("overnight"))


@query("filter_rth", f"SELECT {BARS_OUT} FROM bars WHERE minute >= 570 AND minute < 960")
def filter_rth(spark, sf):
    return tidy(tc.filter_rth(views.bars30(spark, sf)))


@query("slice_window", f"SELECT {BARS_OUT} FROM bars WHERE minute >= 600 AND minute < 720")
def slice_window(spark, sf):
    return tidy(tc.slice_window(views.bars30(spark, sf), 600, 720))


# The calendar: the largest tick of every type on every New York day.
part("cal", """
    SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS event_ts, symbol || '-' || CAST(id AS VARCHAR) AS name FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ny AS DATE) ORDER BY price DESC, id) AS rn FROM ny_ticks) WHERE rn = 1""")


def calendar(spark, sf):
    """Read once: the largest price and, of these, the smallest id are one number (prices to six decimals)."""
    def make():
        t = views.ticks(spark, sf).withColumn("day", tc.iso_date(tc.to_ny(c("ts"))))
        rank = F.round(c("price") * 1e6).cast("decimal(20,0)") * F.lit(Decimal(10**17)) - c("id")
        top = t.groupBy("symbol", "day").agg(F.max_by("ts", rank).alias("ts"), F.max_by("id", rank).alias("id"))
        return cut_lineage(top.select(tc.epoch_seconds(c("ts")).alias("event_ts"), F.concat_ws("-", "symbol", c("id").cast("string")).alias("name")))
    return held("calendar", spark, sf, make)


@query("event_blackout", """
    SELECT t.id, first(e.name ORDER BY e.event_ts, e.name) AS blocked_by
    FROM (SELECT id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts FROM ny_ticks) t
    LEFT JOIN cal e ON t.ts >= e.event_ts - 900 AND t.ts <= e.event_ts + 900 GROUP BY t.id""")
def event_blackout(spark, sf):
    t = views.ticks(spark, sf).select("id", tc.epoch_seconds(c("ts")).alias("ts"))
    return cal.event_blackout(t, calendar(spark, sf)).select("id", "blocked_by")


@query("event_calendar_local", """
    SELECT CAST(epoch(strptime(strftime(ny, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') AT TIME ZONE 'America/New_York') AS BIGINT) AS event_ts,
           'tick-' || CAST(id AS VARCHAR) AS name FROM ny_ticks""")
def event_calendar_local(spark, sf):
    ny = tc.to_ny(c("ts"))
    stamp = F.substring(ny.cast("string"), 1, 16)
    entries = views.ticks(spark, sf).select(stamp.alias("stamp"), F.concat(F.lit("tick-"), c("id").cast("string")).alias("name"))
    return cal.event_calendar_local(entries)


@query("ohlc_quality_check", """
    SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE NOT (low <= least(open, close) AND high >= greatest(open, close))) AS broken,
           count(*) FILTER (WHERE volume <= 0) AS zero_volume,
           CASE WHEN count(*) FILTER (WHERE volume <= 0) = count(*) THEN 'warn'
                WHEN count(*) FILTER (WHERE volume <= 0) > 0 THEN 'fail' ELSE 'ok' END AS volume_verdict
    FROM bars GROUP BY symbol""")
def ohlc_quality_check(spark, sf):
    return qa.ohlc_quality_check(views.bars30(spark, sf))


@query("staleness_gate", """
    SELECT symbol, ts, age, age IS NULL OR age > 3600 AS stale FROM (
      SELECT symbol, ts, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS age FROM bars)""")
def staleness_gate(spark, sf):
    aged = order.over_history(views.indexed(spark, sf), 1, lambda d, w: d.withColumn("age", c("ts") - F.lag("ts").over(w)))
    return aged.select("symbol", "ts", "age", qa.staleness_gate(c("age"), 3600).alias("stale"))


@query("prior_sessions", f"""
    SELECT b.symbol, b.ts, b.session, b.close FROM b JOIN (SELECT DISTINCT symbol, session_no AS at FROM b WHERE session = '2024-01-15') d
    ON b.symbol = d.symbol AND b.session_no >= d.at - 3 AND b.session_no < d.at""")
def prior_sessions(spark, sf):
    return ob.prior_sessions(views.bars30(spark, sf), "2024-01-15", 3).select("symbol", "ts", "session", "close")


@query("entry_bars", """
    SELECT symbol, session, ts, row_number() OVER (PARTITION BY symbol, session ORDER BY ts) AS entry_no
    FROM bars WHERE minute >= 570 AND minute < 720""")
def entry_bars(spark, sf):
    return tidy(ob.entry_bars(views.bars30(spark, sf), "0930-1200").select("symbol", "session", "ts", "entry_no"))


@query("missing_volume_flag", "SELECT symbol, bool_or(volume > 0) AS has_volume FROM bars GROUP BY symbol")
def missing_volume_flag(spark, sf):
    return ob.missing_volume_flag(views.bars30(spark, sf))


part("day_rng", """
    SELECT symbol, session, max(high) AS dh, min(low) AS dl, isoyear(CAST(session AS DATE)) * 100 + week(CAST(session AS DATE)) AS wk
    FROM bars GROUP BY symbol, session""")
part("week_rng", """
    SELECT symbol, wk, lag(wh) OVER w AS pwh, lag(wl) OVER w AS pwl FROM (
      SELECT symbol, wk, max(dh) AS wh, min(dl) AS wl FROM day_rng GROUP BY symbol, wk)
    WINDOW w AS (PARTITION BY symbol ORDER BY wk)""")
part("ranges", """
    SELECT d.symbol, d.session, lag(dh) OVER w AS pdh, lag(dl) OVER w AS pdl, k.pwh, k.pwl
    FROM day_rng d JOIN week_rng k ON k.symbol = d.symbol AND k.wk = d.wk
    WINDOW w AS (PARTITION BY d.symbol ORDER BY d.session)""")


@query("period_ranges", "SELECT symbol, session, pdh, pdl, pwh, pwl FROM ranges")
def period_ranges(spark, sf):
    return ob.period_ranges(views.bars30(spark, sf))


part("tr_rma", """
    SELECT symbol, CAST(4 AS BIGINT) AS idx, avg(close) AS y FROM b WHERE idx < 5 GROUP BY symbol
    UNION ALL
    SELECT w.symbol, w.idx + 1, t.close * (1.0::DOUBLE / 5) + (1.0::DOUBLE - 1.0::DOUBLE / 5) * w.y
    FROM tr_rma w JOIN b t ON t.symbol = w.symbol AND t.idx = w.idx + 1""")


@query("rma", f"SELECT b.symbol, b.ts, {R('w.y')} AS rma FROM b LEFT JOIN tr_rma w ON w.symbol = b.symbol AND w.idx = b.idx")
def rma(spark, sf):
    return tidy(ind.rma(views.indexed(spark, sf), "close", 5, "rma").select("symbol", "ts", "rma"))


@query("atr", f"SELECT symbol, ts, {R('atr')} AS atr FROM ba")
def atr(spark, sf):
    return tidy(ind.atr(views.indexed(spark, sf)).select("symbol", "ts", "atr"))


part("pivots", """
    SELECT symbol, idx, ts,
      CASE WHEN count(*) OVER b5 = 5 AND count(*) OVER f5 = 5 AND max(high) OVER b5 < high AND max(high) OVER f5 <= high THEN high END AS ph,
      CASE WHEN count(*) OVER b5 = 5 AND count(*) OVER f5 = 5 AND min(low) OVER b5 > low AND min(low) OVER f5 >= low THEN low END AS pl
    FROM b WINDOW b5 AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
                  f5 AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")


@query("pivot_high", "SELECT symbol, ts, lag(ph, 5) OVER (PARTITION BY symbol ORDER BY idx) AS pivot_high FROM pivots")
def pivot_high(spark, sf):
    return ind.pivot_high(views.indexed(spark, sf), 5, 5).select("symbol", "ts", "pivot_high")


@query("pivot_low", "SELECT symbol, ts, lag(pl, 5) OVER (PARTITION BY symbol ORDER BY idx) AS pivot_low FROM pivots")
def pivot_low(spark, sf):
    return ind.pivot_low(views.indexed(spark, sf), 5, 5).select("symbol", "ts", "pivot_low")


@query("rolling_extremes", """
    SELECT symbol, ts, max(high) OVER w AS highest, min(low) OVER w AS lowest FROM b
    WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def rolling_extremes(spark, sf):
    return ind.rolling_extremes(views.indexed(spark, sf), 10).select("symbol", "ts", "highest", "lowest")


part("vw", """
    SELECT *, CASE WHEN sv > 0 THEN spv / sv ELSE tp END AS vwap,
           CASE WHEN sv > 0 THEN sqrt(greatest(sppv / sv - (spv / sv) * (spv / sv), 0.0)) ELSE 0.0 END AS vwap_sd
    FROM (SELECT *, sum(tp * volume) OVER w AS spv, sum(volume) OVER w AS sv, sum(tp * tp * volume) OVER w AS sppv
          FROM (SELECT *, (high + low + close) / 3.0 AS tp FROM ba)
          WINDOW w AS (PARTITION BY symbol, session ORDER BY ts))""")


@query("session_vwap", f"SELECT symbol, ts, {R('vwap', 9)} AS vwap, {R('vwap_sd', 4)} AS vwap_sd FROM vw")
def session_vwap(spark, sf):
    out = ind.session_vwap(views.bars30(spark, sf))
    return out.select("symbol", "ts", sh.r6("vwap", 9).alias("vwap"), sh.r6("vwap_sd", 4).alias("vwap_sd"))


part("rv", """
    SELECT *, CASE WHEN count(*) OVER w >= 3 AND avg(volume) OVER w > 0 THEN volume / avg(volume) OVER w ELSE 1.0 END AS rvol
    FROM b WINDOW w AS (PARTITION BY symbol, minute ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")


@query("relative_volume", f"SELECT symbol, ts, {R('rvol')} AS rvol FROM rv")
def relative_volume(spark, sf):
    return tidy(ind.relative_volume(views.bars30(spark, sf)).select("symbol", "ts", "rvol"))


part("kos", """
    SELECT *, first_value(CASE WHEN minute >= 570 THEN open END IGNORE NULLS) OVER w AS ko_ny_open,
           first_value(CASE WHEN minute >= 600 THEN open END IGNORE NULLS) OVER w AS ko_macro,
           first_value(CASE WHEN minute >= 810 THEN open END IGNORE NULLS) OVER w AS ko_pm
    FROM ba WINDOW w AS (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


@query("key_opens", "SELECT symbol, ts, ko_ny_open, ko_macro, ko_pm FROM kos")
def key_opens(spark, sf):
    return ind.key_opens(views.bars30(spark, sf)).select("symbol", "ts", "ko_ny_open", "ko_macro", "ko_pm")


@query("key_open_distance", f"""
    SELECT symbol, ts, {R('least(abs(close - ko_ny_open), abs(close - ko_macro), abs(close - ko_pm))')} AS distance,
           coalesce(least(abs(close - ko_ny_open), abs(close - ko_macro), abs(close - ko_pm)) <= atr * 0.15, false) AS near
    FROM kos""")
def key_open_distance(spark, sf):
    df = ind.key_opens(ind.atr(views.indexed(spark, sf)))
    return tidy(df.select("symbol", "ts", ind.key_open_distance(c("close")).alias("distance"),
                          ind.near_key_open(c("close"), c("atr") * 0.15).alias("near")))


@query("session_bar_index", "SELECT symbol, ts, day_pos FROM b")
def session_bar_index(spark, sf):
    return tidy(ind.session_bar_index(views.bars30(spark, sf)).select("symbol", "ts", "day_pos"))


part("orng", """
    SELECT *, max(CASE WHEN minute < om + 120 THEN high END) OVER w AS or_high,
           min(CASE WHEN minute < om + 120 THEN low END) OVER w AS or_low, minute >= om + 120 AS or_complete
    FROM (SELECT *, first_value(minute) OVER (PARTITION BY symbol, session ORDER BY ts) AS om FROM b)
    WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)""")


@query("opening_range", "SELECT symbol, ts, or_high, or_low, or_complete FROM orng")
def opening_range(spark, sf):
    return ind.opening_range(views.bars30(spark, sf), 120).select("symbol", "ts", "or_high", "or_low", "or_complete")


@query("prev_session_extremes", "SELECT b.symbol, b.ts, r.pdh, r.pdl FROM b JOIN ranges r ON r.symbol = b.symbol AND r.session = b.session")
def prev_session_extremes(spark, sf):
    return ob.with_period_ranges(views.bars30(spark, sf)).select("symbol", "ts", "pdh", "pdl")


def ema_sql(n: int) -> str:
    k = f"(2.0::DOUBLE / {n + 1}.0::DOUBLE)"
    return f"""
    SELECT symbol, idx, CASE WHEN idx >= {n} THEN list_reduce(list_concat([list_sum(arr[1:{n}]) / {n}.0::DOUBLE], arr[{n + 1}:]),
             lambda e, x: x * {k} + e * (1.0::DOUBLE - {k})) END AS ema
    FROM (SELECT symbol, idx, list(close) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {10 * n - 1} PRECEDING AND CURRENT ROW) AS arr FROM b)"""


part("ema9", ema_sql(9))
part("ema21", ema_sql(21))


@query("bounded_ema", f"""
    SELECT b.symbol, b.ts, {R('f.ema')} AS ema9, {R('s.ema')} AS ema21 FROM b
    JOIN ema9 f ON f.symbol = b.symbol AND f.idx = b.idx JOIN ema21 s ON s.symbol = b.symbol AND s.idx = b.idx""")
def bounded_ema(spark, sf):
    df = ind.bounded_ema(ind.bounded_ema(views.indexed(spark, sf), 9, "ema9"), 21, "ema21")
    return tidy(df.select("symbol", "ts", "ema9", "ema21"))
