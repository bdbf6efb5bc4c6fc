"""Queries: ranges, sweeps, manipulation, gaps, divergence, change of state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.operators import bars as ob
from tapewright.operators import detect as dt
from tapewright.operators import levels as lv
from tapewright.operators import order
from tapewright.operators.config import ModelConfig
from tapewright.plans import views
from tapewright.plans.q_bars import tidy
from tapewright.plans.q_signals import enriched
from tapewright.plans.registry import R, held, part, query
from tapewright.session import cut_lineage

c = F.col
CFG = ModelConfig(rb_timeframes=(30, 60), base_timeframe=30)
PEER = {"click": "error", "error": "purchase", "purchase": "signup", "signup": "view", "view": "click"}


# --- previous day and week ------------------------------------------------------

part("br", """
    SELECT a.*, r.pdh, r.pdl, r.pwh, r.pwl, coalesce(r.pdh - r.pdl > 0, false) AS ready, a.close > a.open AS bull
    FROM ba a JOIN ranges r ON r.symbol = a.symbol AND r.session = a.session""")


def ranged(spark, sf):
    return held("ranged", spark, sf, lambda: cut_lineage(ob.with_period_ranges(enriched(spark, sf))))


@query("dealing_range_columns", f"""
    SELECT symbol, ts, {R('(pdh + pdl) / 2.0')} AS daily_eq, {R('pdh - pdl')} AS daily_range, {R('(pwh + pwl) / 2.0')} AS weekly_eq,
           {R('pwh - pwl')} AS weekly_range, ready FROM br""")
def dealing_range_columns(spark, sf):
    out = sh.dealing_range_columns(ranged(spark, sf))
    return tidy(out.select("symbol", "ts", "daily_eq", "daily_range", "weekly_eq", "weekly_range", "ready"))


@query("equilibrium_filter", """
    SELECT symbol, ts, ready AND coalesce(CASE WHEN bull THEN close < (pdh + pdl) / 2.0 - (pdh - pdl) * 0.1 ELSE close > (pdh + pdl) / 2.0 + (pdh - pdl) * 0.1 END, false) AS favourable FROM br""")
def equilibrium_filter(spark, sf):
    return ranged(spark, sf).select("symbol", "ts", sh.favourable(c("close"), sh.is_up()).alias("favourable"))


_half = lambda h, l, p="close": f"CASE WHEN {h} - {l} > 0 THEN (CASE WHEN bull THEN ({h} + {l}) / 2.0 - {p} ELSE {p} - ({h} + {l}) / 2.0 END) / (({h} - {l}) / 2.0) ELSE 0.0 END"
_depth = f"pow(least(greatest({_half('pdh', 'pdl')}, 0.0), 1.0) * 0.65 + least(greatest({_half('pwh', 'pwl')}, 0.0), 1.0) * 0.35, 1.5)"


@query("deep_on_both", f"SELECT symbol, ts, ({_half('pdh', 'pdl')}) > 0.45 AND ({_half('pwh', 'pwl')}) > 0.45 AS deep FROM br")
def deep_on_both(spark, sf):
    return ranged(spark, sf).select("symbol", "ts", sh.deep_on_both(c("close"), sh.is_up()).alias("deep"))


@query("dealing_depth", f"SELECT symbol, ts, {R(_depth)} AS depth FROM br")
def dealing_depth(spark, sf):
    return tidy(ranged(spark, sf).select("symbol", "ts", sh.dealing_depth(c("close"), sh.is_up()).alias("depth")))


part("zoned", """
    SELECT *, lag(least(open, close)) OVER w AS ztop, lag(low) OVER w AS zbot, lag(close > open) OVER w AS zbull FROM b WINDOW w AS (PARTITION BY symbol ORDER BY idx)""")


@query("zone_predicates", f"""
    SELECT symbol, ts, {R('ztop - zbot')} AS height, low <= ztop AND high >= zbot AS touches,
           CASE WHEN zbull THEN low < zbot - 0.5 ELSE high > zbot + 0.5 END AS broken FROM zoned WHERE ztop IS NOT NULL""")
def zone_predicates(spark, sf):
    """Each bar against the zone under the body of the bar before it."""
    out = order.over_history(views.indexed(spark, sf), 1, lambda d, w: d.withColumns({
        "ztop": F.lag(sh.body_bottom()).over(w), "zbot": F.lag("low").over(w), "zbull": F.lag(sh.is_up()).over(w)}))
    return tidy(out.filter(c("ztop").isNotNull()).select(
        "symbol", "ts", (c("ztop") - c("zbot")).alias("height"), sh.zone_contains(c("ztop"), c("zbot")).alias("touches"),
        sh.zone_invalidated(c("zbull"), c("zbot"), 0.5).alias("broken")))


# --- session ranges ----------------------------------------------------------------

def _ses_sql(start: int, end: int) -> str:
    return f"""
    SELECT *, last_value(CASE WHEN ex THEN hi END IGNORE NULLS) OVER s AS fhi, last_value(CASE WHEN ex THEN lo END IGNORE NULLS) OVER s AS flo,
           coalesce(last_value(CASE WHEN ex THEN true WHEN en THEN false END IGNORE NULLS) OVER s, false) AS complete,
           bool_or(ex) OVER (PARTITION BY symbol, session ORDER BY idx) AS done
    FROM (SELECT *, CASE WHEN isl > 0 THEN max(CASE WHEN inside THEN high END) OVER i END AS hi, CASE WHEN isl > 0 THEN min(CASE WHEN inside THEN low END) OVER i END AS lo
          FROM (SELECT *, sum(CASE WHEN en THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY idx) AS isl
                FROM (SELECT *, inside AND NOT was AS en, NOT inside AND was AS ex
                      FROM (SELECT *, coalesce(lag(inside) OVER (PARTITION BY symbol ORDER BY idx), false) AS was
                            FROM (SELECT symbol, session, idx, ts, high, low, close, minute >= {start} AND minute < {end} AS inside FROM b))))
          WINDOW i AS (PARTITION BY symbol, isl ORDER BY idx))
    WINDOW s AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


part("ses_london", _ses_sql(180, 660))
part("ses_ny", _ses_sql(570, 960))


@query("session_running_range", "SELECT symbol, ts, inside, hi AS run_high, lo AS run_low FROM ses_ny")
def session_running_range(spark, sf):
    out = lv.session_running_range(views.indexed(spark, sf), "0930-1600", "ny")
    return out.select("symbol", "ts", c("ny_inside").alias("inside"), c("ny_high").alias("run_high"), c("ny_low").alias("run_low"))


@query("finalised_session_range", "SELECT symbol, ts, fhi AS final_high, flo AS final_low FROM ses_london")
def finalised_session_range(spark, sf):
    out = lv.finalised_session_range(views.indexed(spark, sf), "0300-1100", "ln")
    return out.select("symbol", "ts", c("ln_final_high").alias("final_high"), c("ln_final_low").alias("final_low"))


@query("px_session_range", "SELECT symbol, ts, hi AS px_high, lo AS px_low, complete, done FROM ses_ny")
def px_session_range(spark, sf):
    out = lv.px_session_range(views.indexed(spark, sf), "0930-1600", "px")
    return out.select("symbol", "ts", "px_high", "px_low", c("px_complete").alias("complete"), c("px_done").alias("done"))


part("liq", """
    SELECT a.*, l.fhi AS lhi, l.flo AS llo, n.fhi AS nhi, n.flo AS nlo, n.hi AS phi, n.lo AS plo, n.complete AS pcomplete, n.done AS pdone
    FROM br a JOIN ses_london l ON l.symbol = a.symbol AND l.idx = a.idx JOIN ses_ny n ON n.symbol = a.symbol AND n.idx = a.idx""")


def liquid(spark, sf):
    return held("liquid", spark, sf, lambda: cut_lineage(lv.with_liquidity(ranged(spark, sf), CFG)))


_lows = "list_filter([CASE WHEN ready THEN pdl END, llo, nlo, plo], lambda x: x IS NOT NULL)"
_highs = "list_filter([CASE WHEN ready THEN pdh END, lhi, nhi, phi], lambda x: x IS NOT NULL)"
_join = lambda x: f"array_to_string(list_transform({x}, lambda v: CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR)), ';')"


@query("liquidity_levels", f"SELECT symbol, ts, {_join(_lows)} AS lows, {_join(_highs)} AS highs FROM liq")
def liquidity_levels(spark, sf):
    """Levels in hundredths, in a fixed order."""
    text = lambda high: F.array_join(F.transform(
        lv.liquidity_levels(CFG, high), lambda v: F.round(v * 100).cast("long").cast("string")), ";")
    return liquid(spark, sf).select("symbol", "ts", text(False).alias("lows"), text(True).alias("highs"))


part("swp", f"""
    SELECT *, len(list_filter({_lows}, lambda v: ll < v AND close > v)) > 0 AS sweep_bull, len(list_filter({_highs}, lambda v: hh > v AND close < v)) > 0 AS sweep_bear
    FROM (SELECT *, min(low) OVER w AS ll, max(high) OVER w AS hh FROM liq WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""")


@query("rolling_sweep", "SELECT symbol, ts, sweep_bull, sweep_bear FROM swp")
def rolling_sweep(spark, sf):
    return lv.rolling_sweep(liquid(spark, sf), CFG).select("symbol", "ts", "sweep_bull", "sweep_bear")


part("raid", """
    SELECT symbol, idx, ts, hq AND sum(CAST(hq AS INT)) OVER h = 1 AS raid_bear, lq AND sum(CAST(lq AS INT)) OVER l = 1 AS raid_bull
    FROM (SELECT *, minute >= 420 AND minute < 660 AND hn > 0 AND close < first_value(hod) OVER (PARTITION BY symbol, session, hn ORDER BY idx) AS hq,
                 minute >= 420 AND minute < 660 AND ln > 0 AND close > first_value(lod) OVER (PARTITION BY symbol, session, ln ORDER BY idx) AS lq
          FROM (SELECT *, sum(CASE WHEN high > hod THEN 1 ELSE 0 END) OVER d AS hn, sum(CASE WHEN low < lod THEN 1 ELSE 0 END) OVER d AS ln
                FROM (SELECT *, max(high) OVER p AS hod, min(low) OVER p AS lod FROM b
                      WINDOW p AS (PARTITION BY symbol, session ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
                WINDOW d AS (PARTITION BY symbol, session ORDER BY idx)))
    WINDOW h AS (PARTITION BY symbol, session, hn ORDER BY idx), l AS (PARTITION BY symbol, session, ln ORDER BY idx)""")


@query("day_extreme_raid", "SELECT symbol, ts, raid_bear, raid_bull FROM raid")
def day_extreme_raid(spark, sf):
    return lv.day_extreme_raid(views.indexed(spark, sf), CFG).select("symbol", "ts", "raid_bear", "raid_bull")


part("manip", """
    SELECT symbol, idx, ts, bool_or(bull_ev) OVER w AS manip_bull, bool_or(bear_ev) OVER w AS manip_bear
    FROM (SELECT q.symbol, q.idx, q.ts,
                 minute >= 420 AND minute < 660 AND coalesce((ready AND low < pdl AND close > pdl) OR raid_bull OR (pdone AND low < plo AND close > plo), false) AS bull_ev,
                 minute >= 420 AND minute < 660 AND coalesce((ready AND high > pdh AND close < pdh) OR raid_bear OR (pdone AND high > phi AND close < phi), false) AS bear_ev
          FROM liq q JOIN raid r ON r.symbol = q.symbol AND r.idx = q.idx)
    WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)""")


@query("manipulation_latch", "SELECT symbol, ts, manip_bull, manip_bear FROM manip")
def manipulation_latch(spark, sf):
    return lv.manipulation_latch(liquid(spark, sf), CFG).select("symbol", "ts", "manip_bull", "manip_bear")


part("draws_t", """
    SELECT symbol, idx, ts, list_min(list_filter([pdh, pwh, CASE WHEN pcomplete THEN phi END], lambda v: v > close)) AS draw_up,
           list_max(list_filter([pdl, pwl, CASE WHEN pcomplete THEN plo END], lambda v: v < close)) AS draw_down FROM liq""")


@query("draw_targets", "SELECT symbol, ts, draw_up, draw_down FROM draws_t")
def draw_targets(spark, sf):
    return lv.draw_targets(liquid(spark, sf), CFG).select("symbol", "ts", "draw_up", "draw_down")


@query("context_series", f"""
    SELECT q.symbol, q.ts, pdh, pdl, pwh, pwl, {R(_depth.replace('bull', 'true'))} AS depth_bull, {R(_depth.replace('bull', 'false'))} AS depth_bear,
           draw_up, draw_down, sweep_bull, sweep_bear FROM swp q JOIN draws_t d ON d.symbol = q.symbol AND d.idx = q.idx""")
def context_series(spark, sf):
    out = lv.draw_targets(lv.rolling_sweep(liquid(spark, sf), CFG), CFG)
    return tidy(out.select("symbol", "ts", "pdh", "pdl", "pwh", "pwl", sh.dealing_depth(c("close"), F.lit(True)).alias("depth_bull"),
                           sh.dealing_depth(c("close"), F.lit(False)).alias("depth_bear"), "draw_up", "draw_down", "sweep_bull", "sweep_bear"))


# --- higher timeframe, change of state, bias -----------------------------------------

part("h60", """
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session, ts) - 1 AS idx FROM (
      SELECT symbol, session, CAST(epoch((CAST(session AS TIMESTAMP) + to_minutes(CAST(570 + g * 60 AS BIGINT))) AT TIME ZONE 'America/New_York') AS BIGINT) AS ts,
             open, high, low, close, volume
      FROM (SELECT symbol, session, CAST(floor((minute - 570) / 60.0) AS BIGINT) AS g, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
                   last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars GROUP BY ALL))""")
part("closed60", """
    SELECT b.symbol, b.idx, b.ts, max(h.idx) AS htf_idx FROM b LEFT JOIN h60 h ON h.symbol = b.symbol AND h.ts + 3600 <= b.ts GROUP BY b.symbol, b.idx, b.ts""")


def htf60(spark, sf):
    return held("htf60", spark, sf, lambda: cut_lineage(order.with_index(ob.resample_bars(views.bar_table(spark, sf), 60))))


@query("closed_htf_asof", "SELECT c.symbol, c.ts, h.ts AS htf_ts, h.close AS htf_close FROM closed60 c LEFT JOIN h60 h ON h.symbol = c.symbol AND h.idx = c.htf_idx")
def closed_htf_asof(spark, sf):
    htf = htf60(spark, sf).withColumn("v", F.struct(c("ts").alias("htf_ts"), c("close").alias("htf_close")))
    out = lv.closed_htf_asof(views.indexed(spark, sf).select("symbol", "ts"), htf, 60, "v", span=86_400)
    return out.select("symbol", "ts", "v.htf_ts", "v.htf_close")


def run_sql(src: str, look: int, test: str) -> str:
    return f"""
    SELECT *, rest[len].o AS lvl, rest[len].i AS start_idx FROM (
      SELECT *, CASE WHEN len(rest) = 0 THEN 0 ELSE coalesce(nullif(list_position(list_transform(rest, lambda x: x.m), false), 0) - 1, len(rest)) END AS len FROM (
        SELECT *, CASE WHEN coalesce(list_position(list_transform(arr, lambda x: x.m), true), 0) > 0 THEN arr[list_position(list_transform(arr, lambda x: x.m), true):] ELSE [] END AS rest FROM (
          SELECT *, list_reverse(coalesce(list({{'o': open, 'm': {test}, 'i': idx}}) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {look} PRECEDING AND 1 PRECEDING), [])) AS arr,
                 lag(close) OVER (PARTITION BY symbol ORDER BY idx) AS pclose FROM {src})))"""


part("run_dn", run_sql("b", 4, "close < open"))
part("run_up", run_sql("b", 4, "close > open"))


@query("opposing_run", """
    SELECT d.symbol, d.ts, d.lvl AS down_level, CAST(d.len AS BIGINT) AS down_len, d.start_idx AS down_start, u.lvl AS up_level, CAST(u.len AS BIGINT) AS up_len, u.start_idx AS up_start
    FROM run_dn d JOIN run_up u ON u.symbol = d.symbol AND u.idx = d.idx""")
def opposing_run(spark, sf):
    out = dt.opposing_run(dt.opposing_run(views.indexed(spark, sf), 4, True, "down"), 4, False, "up")
    return tidy(out.select("symbol", "ts", "down_level", "down_len", "down_start", "up_level", "up_len", "up_start"))


part("held_dn", """
    SELECT d.*, coalesce(x.ext_idx BETWEEN d.start_idx AND d.start_idx + d.len - 1, false) AS holds
    FROM run_dn d LEFT JOIN (SELECT a.symbol, a.idx, arg_min(p.idx, p.low * 1e6 + p.idx * 1e-3) AS ext_idx FROM b a JOIN b p ON p.symbol = a.symbol AND p.idx < a.idx AND p.idx >= a.idx - 4 GROUP BY ALL) x
    ON x.symbol = d.symbol AND x.idx = d.idx""")


@query("run_holds_extreme", "SELECT symbol, ts, holds FROM held_dn")
def run_holds_extreme(spark, sf):
    out = dt.opposing_run(views.indexed(spark, sf), 4, True, "r")
    return dt.run_holds_extreme(out, 4, True, "r", "holds").select("symbol", "ts", "holds")


@query("change_of_state", """
    SELECT d.symbol, d.ts, coalesce(d.len >= 2 AND d.close > d.lvl AND d.pclose <= d.lvl, false) AS bull_fired,
           coalesce(u.len >= 2 AND u.close < u.lvl AND u.pclose >= u.lvl, false) AS bear_fired
    FROM run_dn d JOIN run_up u ON u.symbol = d.symbol AND u.idx = d.idx""")
def change_of_state(spark, sf):
    out = dt.change_of_state(dt.change_of_state(views.indexed(spark, sf), True, 4, CFG, "bull_fired"), False, 4, CFG, "bear_fired")
    return out.select("symbol", "ts", "bull_fired", "bear_fired")


part("hrun_dn", run_sql("h60", 6, "close < open"))
part("hrun_up", run_sql("h60", 6, "close > open"))
part("hdir", """
    SELECT d.symbol, d.idx, d.ts, CASE WHEN d.len >= 2 AND d.close > d.lvl AND d.pclose <= d.lvl THEN 1 WHEN u.len >= 2 AND u.close < u.lvl AND u.pclose >= u.lvl THEN -1 ELSE 0 END AS direction
    FROM hrun_dn d JOIN hrun_up u ON u.symbol = d.symbol AND u.idx = d.idx""")
part("hbias", """
    SELECT symbol, idx, ts, CASE WHEN idx - set_at <= 24 THEN d END AS bias FROM (
      SELECT *, last_value(CASE WHEN direction <> 0 THEN direction END IGNORE NULLS) OVER w AS d, last_value(CASE WHEN direction <> 0 THEN idx END IGNORE NULLS) OVER w AS set_at FROM hdir
      WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
part("bias_b", "SELECT c.symbol, c.idx, c.ts, h.bias FROM closed60 c LEFT JOIN hbias h ON h.symbol = c.symbol AND h.idx = c.htf_idx")


@query("change_direction", "SELECT symbol, idx, CAST(direction AS BIGINT) AS direction FROM hdir")
def change_direction(spark, sf):
    return tidy(dt.change_direction(htf60(spark, sf), CFG).select("symbol", "idx", "direction"))


def biased(df, spark, sf):
    """Add the bias known at each base bar."""
    state = dt.bias_state(htf60(spark, sf), CFG).withColumn("_b", F.struct("bias"))
    return lv.closed_htf_asof(df, state, 60, "_b", span=86_400).withColumn("bias", c("_b.bias")).drop("_b")


@query("bias_state", "SELECT symbol, ts, CAST(bias AS BIGINT) AS bias FROM bias_b")
def bias_state(spark, sf):
    return tidy(biased(views.indexed(spark, sf).select("symbol", "ts"), spark, sf))


# --- fair value gaps and opening gaps -----------------------------------------------------

part("fvg", """
    SELECT symbol, session, ts, idx, direction, CASE WHEN direction > 0 THEN low ELSE al END AS top, CASE WHEN direction > 0 THEN ah ELSE high END AS bottom, ah AS ob_top, al AS ob_bottom
    FROM (SELECT *, CASE WHEN low > ah AND low - ah >= 0.5 THEN 1 WHEN high < al AND al - high >= 0.5 THEN -1 END AS direction
          FROM (SELECT *, lag(high, 2) OVER w AS ah, lag(low, 2) OVER w AS al FROM h60 WINDOW w AS (PARTITION BY symbol ORDER BY idx)))
    WHERE direction IS NOT NULL""")


@query("fvg_detect", "SELECT symbol, ts, idx, CAST(direction AS BIGINT) AS direction, top, bottom, ob_top, ob_bottom FROM fvg")
def fvg_detect(spark, sf):
    return tidy(lv.fvg_detect(htf60(spark, sf), 0.5).drop("session"))


@query("gap_columns", f"""
    SELECT symbol, ts, {R('(top + bottom) / 2.0', 5)} AS mid, coalesce(lo2 >= bottom AND lo2 <= top, false) AS inside,
           coalesce((lo2 >= bottom AND lo2 <= top) OR (lo2 >= ob_bottom AND lo2 <= ob_top), false) AS inside_ob
    FROM (SELECT f.*, n.close AS lo2 FROM fvg f LEFT JOIN h60 n ON n.symbol = f.symbol AND n.idx = f.idx + 1)""")
def gap_columns(spark, sf):
    """Where the next bar closes against the gap just formed."""
    nxt = htf60(spark, sf).select("symbol", (c("idx") - 1).alias("idx"), c("close").alias("_p"))
    out = lv.fvg_detect(htf60(spark, sf), 0.5).join(nxt, ["symbol", "idx"], "left")
    return out.select(
        "symbol", "ts", sh.r6((c("top") + c("bottom")) / 2.0, 5).alias("mid"), sh.gap_contains(c("_p"), c("top"), c("bottom")).alias("inside"),
        sh.gap_contains(c("_p"), c("top"), c("bottom"), c("ob_top"), c("ob_bottom")).alias("inside_ob"))


part("fvz", """
    SELECT f.symbol, f.idx AS zone_id, f.direction, f.top, f.bottom, f.ob_top, f.ob_bottom, min(c.idx) AS born_idx
    FROM fvg f JOIN closed60 c ON c.symbol = f.symbol AND c.htf_idx >= f.idx GROUP BY ALL""")
part("fvn", """
    SELECT z.*, min(CASE WHEN (z.direction > 0 AND b.close < least(z.bottom, z.ob_bottom)) OR (z.direction < 0 AND b.close > greatest(z.top, z.ob_top))
                           OR b.close - 8.0 * b.atr > (z.top + z.bottom) / 2.0 OR b.close + 8.0 * b.atr < (z.top + z.bottom) / 2.0 THEN b.idx END) AS nat
    FROM fvz z LEFT JOIN ba b ON b.symbol = z.symbol AND b.idx >= z.born_idx AND b.atr IS NOT NULL GROUP BY ALL""")


part("fvd", "SELECT *, nat AS dead_idx FROM fvn")


def fvg_zones(spark, sf):
    base = enriched(spark, sf)
    events = lv.closed_htf_events(base, htf60(spark, sf), 60).select("symbol", c("htf_idx").alias("zone_id"), "born_idx", "born_session")
    gaps = lv.fvg_detect(htf60(spark, sf), 0.5).withColumnRenamed("idx", "zone_id").drop("session", "ts")
    return lv.zone_lifetime(gaps.join(events, ["symbol", "zone_id"]), base, CFG)


@query("zone_lifetime", "SELECT symbol, zone_id, CAST(direction AS BIGINT) AS direction, top, bottom, born_idx, dead_idx FROM fvd")
def zone_lifetime(spark, sf):
    return tidy(fvg_zones(spark, sf).select("symbol", "zone_id", "direction", "top", "bottom", "born_idx", "dead_idx"))


@query("active_zone_contains", """
    SELECT b.symbol, b.ts, count(z.zone_id) > 0 AS in_zone FROM b LEFT JOIN fvd z ON z.symbol = b.symbol AND z.born_idx <= b.idx AND coalesce(z.dead_idx, 1000000000) > b.idx
       AND z.direction = CASE WHEN b.close > b.open THEN 1 ELSE -1 END
       AND ((b.close >= z.bottom AND b.close <= z.top) OR (b.close >= z.ob_bottom AND b.close <= z.ob_top)) GROUP BY b.symbol, b.ts""")
def active_zone_contains(spark, sf):
    base = enriched(spark, sf)
    zones = cut_lineage(fvg_zones(spark, sf))
    want = F.when(sh.is_up(), 1).otherwise(-1)
    return lv.active_zone_contains(base, zones, base, c("close"), want, "in_zone").select("symbol", "ts", "in_zone")


part("gapz", """
    SELECT symbol, session, first_idx AS zone_id, first_idx AS born_idx, ts, greatest(pc, o) AS top, least(pc, o) AS bottom FROM (
      SELECT *, lag(cl) OVER (PARTITION BY symbol ORDER BY session) AS pc FROM (
        SELECT symbol, session, min(idx) AS first_idx, min(ts) AS ts, first(open ORDER BY idx) AS o, last(close ORDER BY idx) AS cl FROM b GROUP BY symbol, session))
    WHERE pc IS NOT NULL AND greatest(pc, o) - least(pc, o) >= 0.3""")
part("gapn", """
    SELECT z.*, least(CASE WHEN ft IS NOT NULL AND fb IS NOT NULL THEN greatest(ft, fb) END, fs) AS nat FROM (
      SELECT z.*, min(CASE WHEN b.high >= z.top THEN b.idx END) AS ft, min(CASE WHEN b.low <= z.bottom THEN b.idx END) AS fb,
             min(CASE WHEN b.close - 10.0 * b.atr > (z.top + z.bottom) / 2.0 OR b.close + 10.0 * b.atr < (z.top + z.bottom) / 2.0 THEN b.idx END) AS fs
      FROM gapz z LEFT JOIN ba b ON b.symbol = z.symbol AND b.idx >= z.born_idx AND b.atr IS NOT NULL GROUP BY ALL) z""")
part("gapd", "SELECT *, nat AS dead_idx FROM gapn")


@query("gap_detect", "SELECT symbol, session, born_idx, ts, top, bottom FROM gapz")
def gap_detect(spark, sf):
    return lv.gap_detect(views.indexed(spark, sf), 0.3).drop("born_session")


def open_gaps(spark, sf):
    base = enriched(spark, sf)
    return lv.gap_lifetime(lv.gap_detect(base, 0.3), base, CFG)


@query("gap_lifetime", "SELECT symbol, born_idx, top, bottom, dead_idx FROM gapd")
def gap_lifetime(spark, sf):
    return open_gaps(spark, sf).select("symbol", "born_idx", "top", "bottom", "dead_idx")


# --- peers ----------------------------------------------------------------------------------

part("peer", "SELECT CASE symbol " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in PEER.items()) + " END AS symbol, ts, high AS ph, low AS pl FROM bars")
part("bp", "SELECT b.*, p.ph AS peer_high, p.pl AS peer_low, p.ts IS NOT NULL AS has FROM b LEFT JOIN peer p ON p.symbol = b.symbol AND p.ts = b.ts")


def peered(spark, sf):
    back_to = {v: k for k, v in PEER.items()}
    name = F.create_map(*[F.lit(x) for kv in back_to.items() for x in kv])[c("symbol")]
    peer = views.bar_table(spark, sf).select(name.alias("symbol"), "ts", "high", "low")
    return lv.peer_join(views.indexed(spark, sf), peer)


@query("peer_join", """
    SELECT x.symbol, x.ts, x.peer_high, x.peer_low, a.full AS peer_available FROM bp x JOIN (
      SELECT m.symbol, m.n = m.k AND m.n = q.n AS full FROM (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE has) AS k FROM bp GROUP BY symbol) m
      JOIN (SELECT symbol, count(*) AS n FROM peer GROUP BY symbol) q ON q.symbol = m.symbol) a ON a.symbol = x.symbol""")
def peer_join(spark, sf):
    return peered(spark, sf).select("symbol", "ts", "peer_high", "peer_low", "peer_available")


part("pvh", """
    SELECT symbol, idx, high > lag(high) OVER w AND qh < lag(qh) OVER w AS ev FROM (
      SELECT p.symbol, p.idx + 5 AS idx, p.ph AS high, x.peer_high AS qh FROM pivots p JOIN bp x ON x.symbol = p.symbol AND x.idx = p.idx WHERE p.ph IS NOT NULL)
    WINDOW w AS (PARTITION BY symbol ORDER BY idx)""")
part("pvl", """
    SELECT symbol, idx, low < lag(low) OVER w AND ql > lag(ql) OVER w AS ev FROM (
      SELECT p.symbol, p.idx + 5 AS idx, p.pl AS low, x.peer_low AS ql FROM pivots p JOIN bp x ON x.symbol = p.symbol AND x.idx = p.idx WHERE p.pl IS NOT NULL)
    WINDOW w AS (PARTITION BY symbol ORDER BY idx)""")
part("smt", """
    SELECT b.symbol, b.idx, b.ts, coalesce(h.ev, false) AS smt_bear, coalesce(l.ev, false) AS smt_bull FROM b
    LEFT JOIN pvh h ON h.symbol = b.symbol AND h.idx = b.idx LEFT JOIN pvl l ON l.symbol = b.symbol AND l.idx = b.idx""")


@query("smt_divergence", "SELECT symbol, ts, smt_bear, smt_bull FROM smt")
def smt_divergence(spark, sf):
    return lv.smt_divergence(peered(spark, sf), 5).select("symbol", "ts", "smt_bear", "smt_bull")


@query("smt_confirmed", """
    SELECT symbol, ts, coalesce(bool_or(smt_bull) OVER w, false) AS smt_bull_ok, coalesce(bool_or(smt_bear) OVER w, false) AS smt_bear_ok FROM smt
    WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)""")
def smt_confirmed(spark, sf):
    out = lv.smt_confirmed(lv.smt_divergence(peered(spark, sf), 5), 8)
    return out.select("symbol", "ts", "smt_bull_ok", "smt_bear_ok")


# --- rejection blocks -------------------------------------------------------------------------

part("rb", """
    SELECT symbol, idx, ts, session, day_pos, minute, bull, atr, close,
      CASE WHEN bull THEN least(open, close) ELSE high END AS top, CASE WHEN bull THEN low ELSE greatest(open, close) END AS bottom,
      CASE WHEN bull THEN low ELSE high END AS ext, CASE WHEN bull THEN coalesce(dl, open) ELSE coalesce(ul, open) END AS state_level,
      CASE WHEN bull THEN cp >= 0.45 ELSE 1.0 - cp >= 0.45 END AS strong_close, high - low >= atr * 0.8 AS large_range,
      CASE WHEN bull THEN (least(open, close) + low) / 2.0 ELSE (high + greatest(open, close)) / 2.0 END AS ce
    FROM (SELECT *, CASE WHEN ok AND close > open AND low < pl AND pl - low >= atr * 0.08 AND least(open, close) > low AND cp >= 0.45 THEN true
                         WHEN ok AND close < open AND high > ph AND high - ph >= atr * 0.08 AND high > greatest(open, close) AND 1.0 - cp >= 0.45 THEN false END AS bull
          FROM (SELECT a.*, d.lvl AS dl, u.lvl AS ul, min(a.low) OVER w AS pl, max(a.high) OVER w AS ph,
                       a.idx >= 11 AND a.atr IS NOT NULL AND a.high > a.low AND (greatest(a.open, a.close) - least(a.open, a.close)) / nullif(a.high - a.low, 0) >= 0.45 AS ok,
                       CASE WHEN a.high > a.low THEN (a.close - a.low) / (a.high - a.low) ELSE 0.5 END AS cp
                FROM ba a JOIN run_dn d ON d.symbol = a.symbol AND d.idx = a.idx JOIN run_up u ON u.symbol = a.symbol AND u.idx = a.idx
                WINDOW w AS (PARTITION BY a.symbol ORDER BY a.idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)))
    WHERE bull IS NOT NULL""")


def blocks30(spark, sf):
    return dt.rejection_block(enriched(spark, sf), CFG).filter(c("bull").isNotNull())


@query("rejection_block", "SELECT symbol, ts, bull, top, bottom, ext, state_level, strong_close, large_range FROM rb")
def rejection_block(spark, sf):
    return blocks30(spark, sf).select("symbol", "ts", "bull", "top", "bottom", "ext", "state_level", "strong_close", "large_range")


@query("block_atr_asof", f"""
    SELECT c.symbol, c.ts, {R('coalesce(w.atr, a.atr)')} AS block_atr FROM closed60 c JOIN ba a ON a.symbol = c.symbol AND a.idx = c.idx
    LEFT JOIN hatr_walk w ON w.symbol = c.symbol AND w.idx = c.htf_idx""")
def block_atr_asof(spark, sf):
    """ATR of the last closed 60-minute bar, else the base ATR."""
    from tapewright.operators.indicators import atr

    htf = atr(htf60(spark, sf)).withColumn("_a", F.struct(c("atr").alias("v")))
    out = lv.closed_htf_asof(enriched(spark, sf).select("symbol", "ts", "atr"), htf, 60, "_a", span=86_400)
    return tidy(out.select("symbol", "ts", F.coalesce("_a.v", "atr").alias("block_atr")))


part("htr", """
    SELECT *, CASE WHEN idx = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM h60
    WINDOW w AS (PARTITION BY symbol ORDER BY idx)""")
part("hatr_walk", """
    SELECT symbol, CAST(13 AS BIGINT) AS idx, avg(tr) AS atr FROM htr WHERE idx < 14 GROUP BY symbol
    UNION ALL
    SELECT w.symbol, w.idx + 1, t.tr * (1.0::DOUBLE / 14) + (1.0::DOUBLE - 1.0::DOUBLE / 14) * w.atr FROM hatr_walk w JOIN htr t ON t.symbol = w.symbol AND t.idx = w.idx + 1""")
