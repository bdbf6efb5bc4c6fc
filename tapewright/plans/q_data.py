"""Queries: sources, data quality, trade reports, security records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.functions import timecols as tc
from tapewright.operators import bars as ob
from tapewright.operators import quality as qa
from tapewright.operators import trades as tr
from tapewright.plans import views
from tapewright.plans.q_bars import BARS_OUT, calendar, tidy
from tapewright.plans.q_panel import strategy
from tapewright.plans.q_signals import enriched, momentum_trades
from tapewright.plans.q_studies import daily, dated
from tapewright.plans.registry import R, part, query
from tapewright.sources import tables as st
from tapewright.operators import indicators as ind
from tapewright.operators import signals as sg

c = F.col


# --- chart exports: half the time cells are ISO, one-tick bars have a bad low -----

def raw_export(spark, sf):
    b = views.bar_table(spark, sf)
    iso = F.date_format(tc.utc_wall(c("ts")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = lambda n, to: c(n).cast("string").alias(to)
    return b.select(
        c("symbol"), F.when(c("minute") < 720, iso).otherwise(c("ts").cast("string")).alias(" Time"), text("open", "Open"), text("high", "High "),
        F.when(c("volume") == 1, "-").otherwise(c("low").cast("string")).alias("Low"), text("close", "Close"),
        F.when(c("volume") == 2, "n/a").otherwise(c("volume").cast("string")).alias("Volume"),
        F.when(c("close") > c("open") * 1.5, "1").when(c("close") * 1.5 < c("open"), "-1").when(c("close") == c("open"), "NaN").otherwise("0").alias("X Sig Dir"),
        text("close", "X Sig Score"))


part("expo", """
    SELECT symbol, ts, open, high, low, close, CASE WHEN volume = 2 THEN 0.0 ELSE volume END AS volume, session, minute,
           CASE WHEN close > open * 1.5 THEN 1 WHEN close * 1.5 < open THEN -1 WHEN close = open THEN NULL ELSE 0 END AS x_sig_dir, close AS x_sig_score
    FROM b WHERE volume <> 1""")


@query("read_bar_csv", f"SELECT {BARS_OUT}, CAST(x_sig_dir AS DOUBLE) AS x_sig_dir, x_sig_score FROM expo")
def read_bar_csv(spark, sf):
    raw = raw_export(spark, sf)
    return tidy(st.bar_export(raw, c("symbol")))


@query("signal_rows", "SELECT symbol, ts, CAST(x_sig_dir AS BIGINT) AS x_sig_dir, x_sig_score FROM expo WHERE x_sig_dir <> 0")
def signal_rows(spark, sf):
    rows = st.signal_rows(st.bar_export(raw_export(spark, sf), c("symbol")))
    return tidy(rows.select("symbol", "ts", "x_sig_dir", "x_sig_score"))


@query("parse_bar_time", "SELECT id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts FROM ny_ticks")
def parse_bar_time(spark, sf):
    """Ticks stamped with the New York offset."""
    t = views.ticks(spark, sf)
    stamp = F.concat(F.substring(F.replace((c("ts") - F.expr("interval 5 hours")).cast("string"), F.lit(" "), F.lit("T")), 1, 19), F.lit("-05:00"))
    return t.select("id", st.parse_bar_time(stamp).alias("ts"))


# --- volatility files: a close above 450000 is unreadable --------------------------

def raw_vol(spark, sf):
    d = daily(spark, sf)
    bad = c("close") > 450_000
    return d.select("symbol", F.date_format("day", "M/d/yyyy").alias("﻿DATE"), F.when(bad, "n/a").otherwise(c("close").cast("string")).alias("CLOSE"),
                    c("open").cast("string").alias("OPEN"))


@query("read_vol_index_csv", "SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN close > 450000 THEN NULL ELSE close END AS close, open FROM dser")
def read_vol_index_csv(spark, sf):
    return dated(st.vol_index(raw_vol(spark, sf)))


@query("close_series", "SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN close > 450000 THEN open ELSE close END AS level FROM dser")
def close_series(spark, sf):
    return dated(st.close_series(st.vol_index(raw_vol(spark, sf))))


def raw_panel(spark, sf):
    d = daily(spark, sf)
    name = F.when(c("symbol") == "5-LOW", "FDX").when(c("symbol") == "4-NOT SPECIFIED", "_SPY").otherwise(c("symbol"))
    return d.select(name.alias("symbol"), c("day").cast("string").alias("date"), c("close").cast("string").alias("close"))


@query("read_daily_panel", """
    SELECT CASE WHEN symbol = '4-NOT SPECIFIED' THEN '_SPY' ELSE symbol END AS symbol, symbol = '4-NOT SPECIFIED' AS benchmark, CAST(day AS VARCHAR) AS day, close
    FROM dser WHERE symbol <> '5-LOW'""")
def read_daily_panel(spark, sf):
    universe, bench = st.daily_panel(raw_panel(spark, sf))
    return dated(universe.withColumn("benchmark", F.lit(False)).unionByName(bench.withColumn("benchmark", F.lit(True))))


@query("read_spot_csv", "SELECT symbol, CAST(day AS VARCHAR) AS day, close AS spot FROM dser WHERE close <= 450000")
def read_spot_csv(spark, sf):
    raw = daily(spark, sf).select("symbol", "day", F.when(c("close") > 450_000, "bad").otherwise(c("close").cast("string")).alias("spy"))
    return dated(st.spot_series(raw, "spy"))


@query("read_greek_series", f"""
    SELECT date, {R('net', 8)} AS net FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY file DESC) AS rn FROM (
      SELECT CAST(l_linenumber AS VARCHAR) AS file, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, round(avg(l_discount), 6) - round(avg(l_tax), 6) AS net FROM lineitem GROUP BY 1, 2)) WHERE rn = 1""")
def read_greek_series(spark, sf):
    """Each line number plays one overlapping file of daily readings."""
    lines = views.table(spark, sf, "lineitem")
    raw = lines.groupBy(c("l_linenumber").cast("string").alias("file"), F.to_date("l_shipdate").cast("string").alias("date")).agg(
        F.round(F.avg("l_discount"), 6).cast("string").alias("call_gamma"), (-F.round(F.avg("l_tax"), 6)).cast("string").alias("put_gamma"))
    return tidy(st.greek_series(raw), 8)


@query("read_event_calendar", "SELECT event_ts, CASE WHEN event_ts % 86400 < 43200 THEN 'event' ELSE name END AS name FROM cal")
def read_event_calendar(spark, sf):
    """The calendar through JSON text; morning events lost their name."""
    named = F.when(c("event_ts") % 86400 >= 43200, c("name"))
    text = calendar(spark, sf).select(F.to_json(F.struct(c("event_ts").alias("ts"), named.alias("name"))).alias("t"))
    raw = text.select(F.from_json("t", "ts long, name string").alias("j")).select("j.*")
    return st.event_calendar(raw)


@query("read_gamma_snapshots", """
    SELECT o_orderpriority AS symbol, o_orderkey AS as_of_ts, o_totalprice AS spot, o_totalprice * 0.5 AS gamma_flip, 0.0::DOUBLE AS control_node_margin_pct, 'file' AS source
    FROM orders WHERE o_orderstatus <> 'P'""")
def read_gamma_snapshots(spark, sf):
    """One snapshot per order; open orders carry an unreadable wall."""
    o = views.table(spark, sf, "orders")
    s = lambda x, n: x.cast("string").alias(n)
    price = c("o_totalprice")
    none = F.lit(None).cast("string")
    raw = o.select(
        c("o_orderpriority").alias("symbol"), s(price, "spot"), s(price * 0.5, "gamma_flip"), s(price * 1.1, "call_wall"),
        F.when(c("o_orderstatus") == "P", "?").otherwise((price * 0.9).cast("string")).alias("put_wall"), s(price * 1e3, "net_gex"),
        s(c("o_orderkey"), "as_of_ts"), none.alias("control_node"), none.alias("control_node_margin_pct"), none.alias("source"))
    return st.gamma_snapshots(raw).select("symbol", "as_of_ts", "spot", "gamma_flip", "control_node_margin_pct", "source")


# --- trade lists: an order is a trade, open orders lack the exit leg -----------------

def raw_trades(spark, sf):
    o = views.table(spark, sf, "orders")
    side = F.when(c("o_orderpriority") < "3", "long").otherwise("short")
    base = o.select(c("o_orderkey").cast("string").alias("Trade number"), side.alias("_side"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("Date and time"),
                    c("o_totalprice").cast("string").alias("Price USD"), (c("o_totalprice") - 250000.0).cast("string").alias("Net PnL USD"),
                    F.lit("1.0").alias("Return %"), F.lit("2.5").alias("Commission USD"), F.lit("7").alias("Duration (bars)"), c("o_orderstatus"), c("o_orderpriority"))
    entry = base.withColumns({"Type": F.concat(F.lit("Entry "), c("_side")), "Signal": F.lit("in")})
    leave = base.filter("o_orderstatus <> 'P'").withColumns({"Type": F.concat(F.lit("Exit "), c("_side")), "Signal": c("o_orderpriority")})
    return entry.unionByName(leave).drop("_side", "o_orderstatus", "o_orderpriority")


part("tlist", """
    SELECT o_orderkey AS trade_no, CASE WHEN o_orderpriority < '3' THEN 'long' ELSE 'short' END AS side, o_orderdate AS entry_time, o_totalprice AS entry_price,
           o_orderpriority AS exit_reason, o_totalprice - 250000.0 AS pnl, 2.5 AS commission FROM orders WHERE o_orderstatus <> 'P'""")


@query("read_trade_list", f"SELECT trade_no, side, entry_price, exit_reason, {R('pnl')} AS pnl, CAST(commission AS DOUBLE) AS commission, 7::BIGINT AS bars FROM tlist")
def read_trade_list(spark, sf):
    out = st.trade_list(raw_trades(spark, sf))
    return tidy(out.select("trade_no", "side", "entry_price", "exit_reason", "pnl", "commission", "bars"))


@query("era_buckets", f"""
    SELECT y0 + (y - y0) // 5 * 5 AS era, count(*) AS n, {R('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)')} AS win, {R('sum(pnl)', 2)} AS total
    FROM (SELECT *, year(entry_time) AS y, (SELECT min(year(entry_time)) FROM tlist) AS y0 FROM tlist) GROUP BY 1""")
def era_buckets(spark, sf):
    out = tr.era_buckets(st.trade_list(raw_trades(spark, sf)))
    return tidy(out.withColumn("total", sh.r6("total", 2)))


@query("trade_breakdowns", f"""
    SELECT exit_reason, side, count(*) AS n, {R('sum(pnl)', 2)} AS total, {R('avg(pnl)', 4)} AS mean, {R('stddev_samp(pnl) / sqrt(count(*))', 4)} AS se,
           {R('avg(pnl) / (stddev_samp(pnl) / sqrt(count(*)))')} AS t, {R("median(CASE WHEN exit_reason IN ('1-URGENT', '2-HIGH') AND pnl < 0 THEN abs(pnl + commission) / 100.0 END)")} AS median_risk
    FROM tlist GROUP BY GROUPING SETS ((exit_reason), (side), ())""")
def trade_breakdowns(spark, sf):
    out = tr.trade_breakdowns(st.trade_list(raw_trades(spark, sf)), ["1-URGENT", "2-HIGH"])
    return out.select("exit_reason", "side", "n", sh.r6("total", 2).alias("total"), sh.r6("mean", 4).alias("mean"), sh.r6("se", 4).alias("se"),
                      sh.r6("t").alias("t"), sh.r6("median_risk").alias("median_risk"))


# --- journal, registry, archive ---------------------------------------------------------

@query("decision_journal", """
    SELECT CASE WHEN price > 50 THEN 'live' ELSE 'shadow' END || ':' || symbol AS kind, count(*) AS n FROM ny_ticks WHERE price <= 200 GROUP BY 1""")
def decision_journal(spark, sf):
    """Ticks as decisions in JSON lines; those above 200 were torn in writing."""
    t = views.ticks(spark, sf)
    row = F.struct(tc.epoch_seconds(c("ts")).alias("ts"), c("symbol").alias("action"), F.when(c("price") > 50, "live").otherwise("shadow").alias("mode"),
                   c("price").alias("price"))
    text = F.to_json(row)
    lines = t.select(F.when(c("price") > 200, F.substring(text, 1, 30)).otherwise(text).alias("value"))
    return st.journal_summary(st.parse_journal(lines))


@query("validation_registry", f"SELECT label AS signal, month AS tested_at, {R('ret')} AS mean_r FROM strat QUALIFY row_number() OVER (PARTITION BY label ORDER BY month DESC) = 1")
def validation_registry(spark, sf):
    """Every month re-tests the strategy; the last record stands."""
    rec = strategy(spark, sf).select(c("label").alias("signal"), c("month").alias("tested_at"), c("ret").alias("mean_r"))
    return tidy(st.registry_latest(rec, "tested_at"))


@query("archive_coverage", """
    SELECT o_orderpriority AS series, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day,
           CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day FROM orders GROUP BY 1""")
def archive_coverage(spark, sf):
    files = views.table(spark, sf, "orders").select(c("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day"))
    out = qa.archive_coverage(files)
    return out.select("series", "days", c("first_day").cast("string").alias("first_day"), c("last_day").cast("string").alias("last_day"))


@query("missing_days", """
    SELECT s.series, CAST(s.day AS VARCHAR) AS day FROM (
      SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT symbol AS series, min(day) AS lo, max(day) AS hi FROM dser GROUP BY 1)) s
    ANTI JOIN dser d ON d.symbol = s.series AND d.day = s.day WHERE isodow(s.day) < 6""")
def missing_days(spark, sf):
    held = daily(spark, sf).select(c("symbol").alias("series"), "day")
    return qa.missing_days(held).select("series", c("day").cast("string").alias("day"))


def halves(spark, sf):
    return views.panel(spark, sf, "l_linenumber % 2 = 1"), views.panel(spark, sf, "l_linenumber % 2 = 0")


part("bps", "SELECT a.symbol, 1e4 * abs(a.close - b.close) / b.close AS bp FROM pnl_odd a JOIN pnl_even b ON a.symbol = b.symbol AND a.month = b.month WHERE b.close > 0")
part("verd", """
    SELECT symbol, n AS shared, med AS median_bp, p95 AS p95_bp, NOT (med > 4500.0 OR p95 > 60000.0) AS accepted FROM (
      SELECT symbol, max(n) AS n, median(bp) AS med, max(CASE WHEN rn = least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1 THEN bp END) AS p95
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bp) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bps) GROUP BY symbol)""")


@query("panel_overlap_check", f"SELECT symbol, shared, {R('median_bp', 4)} AS median_bp, {R('p95_bp', 4)} AS p95_bp, accepted FROM verd")
def panel_overlap_check(spark, sf):
    old, new = halves(spark, sf)
    return tidy(qa.panel_overlap_check(old, new, "symbol", "month", "close", 4500.0, 60_000.0), 4)


@query("panel_merge", """
    SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.month, b.month) AS month, coalesce(b.close, a.close) AS close
    FROM pnl_odd a FULL JOIN (SELECT e.* FROM pnl_even e LEFT JOIN verd v ON v.symbol = e.symbol WHERE coalesce(v.accepted, true)) b ON a.symbol = b.symbol AND a.month = b.month""")
def panel_merge(spark, sf):
    old, new = halves(spark, sf)
    verdict = qa.panel_overlap_check(old, new, "symbol", "month", "close", 4500.0, 60_000.0)
    return qa.panel_merge(old, new, "symbol", "month", "close", verdict)


# --- differences between two versions -----------------------------------------------------

@query("series_diff", f"""
    SELECT 'panel' AS layer, count(*) AS compared, count(*) FILTER (WHERE abs(a.close - b.close) > 300.0) AS mismatched,
           {R('100.0 * count(*) FILTER (WHERE abs(a.close - b.close) > 300.0) / count(*)')} AS differ_pct, min(CASE WHEN abs(a.close - b.close) > 300.0 THEN a.month END) AS first_mismatch
    FROM pnl_odd a JOIN pnl_even b ON a.symbol = b.symbol AND a.month = b.month""")
def series_diff(spark, sf):
    a, b = halves(spark, sf)
    return tidy(qa.series_diff(a, b, ["symbol", "month"], "month", "close", 300.0, "panel"))


part("lag2", """
    SELECT d.symbol, d.session, lag(dh, 2) OVER w AS pdh, lag(dl, 2) OVER w AS pdl FROM day_rng d WINDOW w AS (PARTITION BY d.symbol ORDER BY d.session)""")
part("atr10_seed", "SELECT symbol, avg(tr) AS seed FROM trs WHERE idx < 10 GROUP BY symbol")
part("atr10_walk", """
    SELECT symbol, CAST(9 AS BIGINT) AS idx, seed AS atr FROM atr10_seed
    UNION ALL
    SELECT w.symbol, w.idx + 1, t.tr * (1.0::DOUBLE / 10) + (1.0::DOUBLE - 1.0::DOUBLE / 10) * w.atr FROM atr10_walk w JOIN trs t ON t.symbol = w.symbol AND t.idx = w.idx + 1""")
_rel = "abs(x - y) / greatest(abs(x), abs(y), 1e-9)"


@query("layered_diff", f"""
    SELECT layer, count(e) AS compared, {R('median(e)')} AS median_err, {R('max(e)')} AS worst_err FROM (SELECT unnest(['atr', 'pdh', 'pdl']) AS layer) LEFT JOIN (
      SELECT 'atr' AS layer, {_rel} AS e FROM (SELECT a.atr AS x, w.atr AS y FROM ba a JOIN atr10_walk w ON w.symbol = a.symbol AND w.idx = a.idx WHERE a.idx >= 200)
      UNION BY NAME SELECT * FROM (SELECT 'pdh' AS layer, {_rel} AS e FROM (SELECT r.pdh AS x, l.pdh AS y FROM ranges r JOIN lag2 l ON l.symbol = r.symbol AND l.session = r.session))
      UNION BY NAME SELECT * FROM (SELECT 'pdl' AS layer, {_rel} AS e FROM (SELECT r.pdl AS x, l.pdl AS y FROM ranges r JOIN lag2 l ON l.symbol = r.symbol AND l.session = r.session))) USING (layer)
    GROUP BY layer""".replace("UNION BY NAME", "UNION ALL BY NAME"))
def layered_diff(spark, sf):
    """ATR(14) against ATR(10) after the warm-up; ranges at lag 1 against lag 2."""
    df = enriched(spark, sf)
    other = ind.atr(df.drop("atr"), 10)
    warm = max(14 * 10, 200)
    r1, r2 = ob.period_ranges(df, 1), ob.period_ranges(df, 2)
    keys = ["symbol", "session"]
    layers = [qa.relative_layer(df.filter(c("idx") >= warm), other, ["symbol", "idx"], "atr", "atr"),
              qa.relative_layer(r1, r2, keys, "pdh", "pdh"), qa.relative_layer(r1, r2, keys, "pdl", "pdl")]
    return tidy(qa.layered_diff(layers))


part("sl", "SELECT symbol, ts, momentum_6 AS direction, close AS score FROM sig WHERE momentum_6 <> 0")
part("sr", "SELECT symbol, ts, CASE WHEN close > open THEN 1 ELSE -1 END AS direction, (open + close) / 2.0 AS score FROM sig WHERE close <> open")
part("sdiff", """
    SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, CASE WHEN b.ts IS NULL THEN 'left_only' WHEN a.ts IS NULL THEN 'right_only'
      WHEN a.direction <> b.direction THEN 'wrong_direction' WHEN abs(a.score - b.score) > 10.0 THEN 'wrong_score' ELSE 'matched' END AS kind
    FROM sl a FULL JOIN sr b ON a.symbol = b.symbol AND a.ts = b.ts""")


def two_lists(spark, sf):
    df = sg.momentum(enriched(spark, sf), 6, "direction")
    left = df.filter("direction <> 0").select("symbol", "ts", "direction", c("close").alias("score"))
    up = F.when(sh.is_up(), 1).otherwise(-1)
    right = df.filter("close <> open").select("symbol", "ts", up.alias("direction"), ((c("open") + c("close")) / 2.0).alias("score"))
    return left, right


@query("signal_diff", "SELECT symbol, ts, kind FROM sdiff")
def signal_diff(spark, sf):
    return qa.signal_diff(*two_lists(spark, sf), ["symbol", "ts"], 10.0)


@query("only_in_one", "SELECT symbol, ts, kind FROM sdiff WHERE kind IN ('left_only', 'right_only')")
def only_in_one(spark, sf):
    left, right = two_lists(spark, sf)
    keys = ["symbol", "ts"]
    a = qa.only_in_left(left, right, keys).withColumn("kind", F.lit("left_only"))
    return a.unionByName(qa.only_in_left(right, left, keys).withColumn("kind", F.lit("right_only")))


_NAMES = ["opening_range_break", "prev_day_break", "momentum_6", "inside_bar_break"]
part("builds", " UNION BY NAME ".join(f"SELECT '{n}' AS build, symbol, ts, {n} AS direction, close, open, session FROM sig WHERE {n} <> 0" for n in _NAMES))


def builds(spark, sf):
    df, _ = sg.candidate_signals(enriched(spark, sf), 120)
    return sg.stack_signals(df, _NAMES, ["symbol", "ts", "session", "open", "close"]).withColumnRenamed("signal_name", "build")


@query("shared_signal_bars", """
    SELECT a.build AS build_a, b.build AS build_b, count(*) AS shared FROM builds a JOIN builds b ON a.symbol = b.symbol AND a.ts = b.ts AND a.build < b.build GROUP BY ALL""")
def shared_signal_bars(spark, sf):
    return tr.shared_signal_bars(builds(spark, sf), ["symbol", "ts"])


@query("direction_year_split", f"""
    SELECT build, CAST(year AS BIGINT) AS year, CAST(direction AS BIGINT) AS direction, count(*) AS n, {R('avg((close - open) * d)')} AS mean
    FROM (SELECT *, year(CAST(session AS DATE)) AS year, direction AS d FROM builds) GROUP BY GROUPING SETS ((build, year), (build, direction))""")
def direction_year_split(spark, sf):
    rows = builds(spark, sf).withColumns({"year": F.substring("session", 1, 4).cast("int"), "r": (c("close") - c("open")) * c("direction")})
    return tidy(tr.direction_year_split(rows))


@query("state_distribution", """
    SELECT symbol, count(*) FILTER (WHERE momentum_6 > 0) AS ups, count(*) FILTER (WHERE momentum_6 < 0) AS downs, count(*) FILTER (WHERE momentum_6 = 0) AS zeros,
           count(*) FILTER (WHERE momentum_6 <> 0) = 0 AS never_set FROM sig GROUP BY symbol""")
def state_distribution(spark, sf):
    return qa.state_distribution(sg.momentum(views.indexed(spark, sf)), "signal", ["symbol"])


@query("period_split", """
    SELECT CASE WHEN session < '2024-01-16' THEN 'is' ELSE 'oos' END AS period, symbol, count(*) AS bars, count(DISTINCT session) AS sessions FROM bars GROUP BY ALL""")
def period_split(spark, sf):
    b = views.bars30(spark, sf)
    period = F.when(c("session") < "2024-01-16", "is").otherwise("oos")
    return b.groupBy(period.alias("period"), "symbol").agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("session").alias("sessions"))


@query("concat_sessions", f"SELECT {BARS_OUT} FROM bars")
def concat_sessions(spark, sf):
    b = views.bar_table(spark, sf)
    return tidy(ob.concat_sessions(b.filter("session < '2024-01-16'"), b.filter("session >= '2024-01-16'")))


# --- security records ------------------------------------------------------------------------

part("msf", """
    SELECT l_suppkey AS permno, CAST(max(CAST(l_shipdate AS DATE)) AS DATE) AS date, CASE WHEN count(*) > 3 THEN round(avg(l_discount) - avg(l_tax), 6) END AS ret,
           CASE WHEN count(*) = 4 THEN -1.0 ELSE 1.0 END * round(avg(l_extendedprice / l_quantity), 7) AS prc, CAST(sum(l_quantity) AS DOUBLE) AS shrout
    FROM lineitem GROUP BY l_suppkey, strftime(l_shipdate, '%Y-%m')""")
part("names", """
    SELECT s_suppkey AS permno, DATE '1994-01-01' AS namedt, DATE '1998-03-15' AS nameendt, 10 + s_nationkey % 3 AS shrcd, 1 + s_nationkey % 4 AS exchcd, s_name AS ticker FROM supplier
    UNION BY NAME SELECT s_suppkey, DATE '1998-03-01' AS namedt, DATE '2002-01-01' AS nameendt, 10 + s_nationkey % 3 AS shrcd, 1 + s_nationkey % 4 AS exchcd, s_name || '-B' AS ticker, s_suppkey AS permno FROM supplier""".replace("SELECT s_suppkey, DATE '1998-03-01'", "SELECT DATE '1998-03-01'"))
part("dels", "SELECT s_suppkey AS permno, DATE '1999-06-10' AS dlstdt, round(s_acctbal / 100000.0, 6) AS dlret, 500 AS dlstcd FROM supplier WHERE s_acctbal < 3000")
part("master", """
    SELECT a.permno, a.date, a.ret, a.prc, a.shrout, b.shrcd, b.exchcd, b.ticker, b.namedt, d.dlret FROM msf a JOIN names b ON a.permno = b.permno AND b.namedt <= a.date AND a.date <= last_day(b.nameendt)
    LEFT JOIN dels d ON a.permno = d.permno AND date_trunc('month', a.date) = date_trunc('month', d.dlstdt) WHERE b.shrcd IN (10, 11) AND b.exchcd IN (1, 2, 3)""")


def master(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    n = F.count(F.lit(1))
    msf = lines.groupBy(c("l_suppkey").alias("permno"), F.date_format(F.to_date("l_shipdate"), "yyyy-MM").alias("_m")).agg(
        F.max(F.to_date("l_shipdate")).alias("date"), F.when(n > 3, F.round(F.avg("l_discount") - F.avg("l_tax"), 6)).alias("ret"),
        (F.when(n == 4, -1.0).otherwise(1.0) * F.round(F.avg(c("l_extendedprice") / c("l_quantity")), 7)).alias("prc"), F.sum("l_quantity").alias("shrout")).drop("_m")
    sup = views.table(spark, sf, "supplier")
    d = lambda s: F.lit(s).cast("date")
    spans = F.array(F.struct(d("1994-01-01").alias("namedt"), d("1998-03-15").alias("nameendt"), F.lit("").alias("sfx")),
                    F.struct(d("1998-03-01").alias("namedt"), d("2002-01-01").alias("nameendt"), F.lit("-B").alias("sfx")))
    names = sup.select(c("s_suppkey").alias("permno"), (10 + c("s_nationkey") % 3).alias("shrcd"), (1 + c("s_nationkey") % 4).alias("exchcd"), "s_name", F.inline(spans))
    names = names.withColumn("ticker", F.concat("s_name", "sfx")).drop("s_name", "sfx")
    dels = sup.filter("s_acctbal < 3000").select(c("s_suppkey").alias("permno"), d("1999-06-10").alias("dlstdt"), F.round(c("s_acctbal") / 100000.0, 6).alias("dlret"),
                                                 F.lit(500).alias("dlstcd"))
    return tr.security_master_join(msf, names, dels)


def _dates(df):
    return df.withColumns({n: c(n).cast("string") for n, k in df.dtypes if k == "date"})


@query("security_master_join", f"SELECT permno, CAST(date AS VARCHAR) AS date, {R('ret')} AS ret, ticker, {R('dlret')} AS dlret FROM master")
def security_master_join(spark, sf):
    return tidy(_dates(master(spark, sf).select("permno", "date", "ret", "ticker", "dlret")))


@query("dedup_latest", "SELECT permno, CAST(date AS VARCHAR) AS date, ticker FROM master QUALIFY row_number() OVER (PARTITION BY permno, date ORDER BY namedt DESC) = 1")
def dedup_latest(spark, sf):
    return _dates(qa.dedup_latest(master(spark, sf), ["permno", "date"], "namedt").select("permno", "date", "ticker"))


@query("delisting_adjusted_return", f"""
    SELECT permno, CAST(date AS VARCHAR) AS date, ticker, {R('coalesce((1.0 + ret) * (1.0 + dlret) - 1.0, dlret, ret)')} AS ret_adj, {R('abs(prc) * shrout', 3)} AS mktcap FROM master""")
def delisting_adjusted_return(spark, sf):
    out = tr.delisting_adjusted_return(master(spark, sf))
    return _dates(out).select("permno", "date", "ticker", sh.r6("ret_adj").alias("ret_adj"), sh.r6("mktcap", 3).alias("mktcap"))
