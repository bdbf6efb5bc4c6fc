"""Queries: grades, gates, targets, block life and model signals, on blocks of every timeframe."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.operators import lifecycle as lc
from tapewright.operators import score as sc
from tapewright.operators import signals as sg
from tapewright.operators import trades as tr
from tapewright.operators import calendar as cal
from tapewright.plans import q_levels as ql
from tapewright.plans import views
from tapewright.plans.q_bars import calendar, tidy
from tapewright.plans.q_signals import enriched, momentum_entries
from tapewright.plans.registry import R, held, part, query
from tapewright.session import cut_lineage

c = F.col
TF = 30
# The test prices jump at random, so the formation and grade gates are opened.
LOOSE = replace(
    ql.CFG, swing_lookback=3, require_min_sweep=False, require_strong_close=False, min_body_fraction=0.1, min_grade_to_track="C",
    min_grade_to_signal="C", disp_atr_mult=0.3, traded_window="0930-1600", use_stack_gate=False, require_bias=False, dol_mode="Tag only (no gate)")

# --- scoring of blocks on the bar that sees them close ------------------------------

part("s30", "SELECT symbol, idx, ts, open, high, low, close, atr, idx + 1 AS place FROM ba")
part("s60", """
    SELECT h.symbol, h.idx, h.ts, h.open, h.high, h.low, h.close, w.atr, s.place FROM h60 h LEFT JOIN hatr_walk w ON w.symbol = h.symbol AND w.idx = h.idx
    LEFT JOIN (SELECT h.symbol, h.idx, min(c.idx) AS place FROM h60 h JOIN closed60 c ON c.symbol = h.symbol AND c.htf_idx >= h.idx GROUP BY h.symbol, h.idx) s ON s.symbol = h.symbol AND s.idx = h.idx""")


def blocks_sql(source: str, timeframe: int) -> str:
    return f"""
    SELECT symbol, {timeframe}::BIGINT AS timeframe, idx AS htf_idx, place, ts AS born_ts, bull, CASE WHEN bull THEN least(open, close) ELSE high END AS top, CASE WHEN bull THEN low ELSE greatest(open, close) END AS bottom,
      CASE WHEN bull THEN low ELSE high END AS ext, CASE WHEN bull THEN cp >= 0.45 ELSE 1.0 - cp >= 0.45 END AS strong_close, high - low >= atr * 0.8 AS large_range,
      CASE WHEN bull THEN (least(open, close) + low) / 2.0 ELSE (high + greatest(open, close)) / 2.0 END AS ce
    FROM (SELECT *, CASE WHEN ok AND close > open AND low < pl AND least(open, close) > low THEN true WHEN ok AND close < open AND high > ph AND high > greatest(open, close) THEN false END AS bull
          FROM (SELECT a.*, min(low) OVER w AS pl, max(high) OVER w AS ph, idx >= 5 AND atr IS NOT NULL AND high > low AND (greatest(open, close) - least(open, close)) / nullif(high - low, 0) >= 0.1 AS ok,
                       CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS cp FROM {source} a
                WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)))
    WHERE bull IS NOT NULL"""


part("rbl", f"{blocks_sql('s30', 30)} UNION ALL {blocks_sql('s60', 60)}")
part("smok", """
    SELECT s.symbol, s.idx, a.full AND bool_or(smt_bull) OVER w AS smt_bull_ok, a.full AND bool_or(smt_bear) OVER w AS smt_bear_ok FROM smt s JOIN (
      SELECT m.symbol, m.n = m.k AND m.n = q.n AS full FROM (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE has) AS k FROM bp GROUP BY symbol) m
      JOIN (SELECT symbol, count(*) AS n FROM peer GROUP BY symbol) q ON q.symbol = m.symbol) a ON a.symbol = s.symbol
    WINDOW w AS (PARTITION BY s.symbol ORDER BY s.idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)""")
part("ctx", """
    SELECT q.symbol, q.session, q.idx, q.ts, q.minute, q.close, q.atr, q.pdh, q.pdl, q.pwh, q.pwl, q.ready, q.sweep_bull, q.sweep_bear, m.manip_bull, m.manip_bear, k.ko_ny_open, k.ko_macro, k.ko_pm,
           v.vwap, r.rvol, t.bias, d.draw_up, d.draw_down, s.smt_bull_ok, s.smt_bear_ok
    FROM swp q JOIN manip m ON m.symbol = q.symbol AND m.idx = q.idx JOIN kos k ON k.symbol = q.symbol AND k.idx = q.idx JOIN vw v ON v.symbol = q.symbol AND v.idx = q.idx
    JOIN rv r ON r.symbol = q.symbol AND r.idx = q.idx JOIN bias_b t ON t.symbol = q.symbol AND t.idx = q.idx JOIN draws_t d ON d.symbol = q.symbol AND d.idx = q.idx
    JOIN smok s ON s.symbol = q.symbol AND s.idx = q.idx""")
_snap = "SELECT symbol, session, first(ts ORDER BY ts) AS as_of, first(open ORDER BY ts) AS spot, last(close ORDER BY ts) AS flip, max(high) * 0.8 AS cw, min(low) * 1.2 AS pw FROM bars GROUP BY symbol, session"
part("snap", _snap)


def facts_sql(blocks: str, amdx: str, more: str = "") -> str:
    """Facts and gamma points of blocks (with their bar as `place`) on the context of that bar."""
    return f"""
    SELECT *, NOT (in_fvg OR near_open OR fav OR in_gap OR amdx) AS loose, CASE WHEN abs(ext - wall) > atr * 0.6 THEN 0.0::DOUBLE WHEN spot > flip THEN CASE WHEN aligned AND setup = 2 THEN 10.0 WHEN aligned THEN 6.0 ELSE -5.0 END
                   WHEN setup = 1 THEN 10.0 WHEN aligned THEN -4.0 ELSE 0.0 END AS gamma
    FROM (SELECT *, CASE WHEN is_call THEN cw ELSE pw END AS wall, CASE WHEN is_call THEN NOT bull ELSE bull END AS aligned,
            CASE WHEN bull AND ext <= draw_down + atr * 0.5 THEN 2 WHEN NOT bull AND ext >= draw_up - atr * 0.5 THEN 2 WHEN (bias > 0) = bull AND fav THEN 1 ELSE 0 END AS setup
    FROM (SELECT x.*, p.spot, p.flip, p.cw, p.pw, abs(x.ext - p.cw) <= abs(x.ext - p.pw) AS is_call
    FROM (SELECT r.timeframe, r.htf_idx, r.bull, r.top, r.bottom, r.ext, r.ce, r.strong_close, r.large_range, r.born_ts, {more} c.*,
            coalesce(least(abs(r.ce - c.ko_ny_open), abs(r.ce - c.ko_macro), abs(r.ce - c.ko_pm)) <= c.atr * 0.15, false) AS near_open,
            (c.minute >= 570 AND c.minute < 660) OR (c.minute >= 120 AND c.minute < 300) AS in_amd, {amdx} AS amdx,
            CASE WHEN r.bull THEN c.sweep_bull ELSE c.sweep_bear END AS swept, CASE WHEN r.bull THEN c.smt_bull_ok ELSE c.smt_bear_ok END AS smt_ok, c.minute >= 720 AND c.minute < 810 AS in_lull,
            c.ready AND coalesce(CASE WHEN r.bull THEN r.ce < (pdh + pdl) / 2.0 - (pdh - pdl) * 0.1 ELSE r.ce > (pdh + pdl) / 2.0 + (pdh - pdl) * 0.1 END, false) AS fav,
            EXISTS (SELECT 1 FROM fvd z WHERE z.symbol = c.symbol AND z.born_idx <= c.idx AND coalesce(z.dead_idx, 1000000000) > c.idx AND z.direction = CASE WHEN r.bull THEN 1 ELSE -1 END
                    AND ((r.ce >= z.bottom AND r.ce <= z.top) OR (r.ce >= z.ob_bottom AND r.ce <= z.ob_top))) AS in_fvg,
            EXISTS (SELECT 1 FROM gapd g WHERE g.symbol = c.symbol AND g.born_idx <= c.idx AND coalesce(g.dead_idx, 1000000000) > c.idx AND r.ce >= g.bottom AND r.ce <= g.top) AS in_gap
          FROM {blocks} r JOIN ctx c ON c.symbol = r.symbol AND c.idx = r.place WHERE c.atr IS NOT NULL) x ASOF JOIN snap p ON p.symbol = x.symbol AND x.ts >= p.as_of))"""


def agreement_sql(rows: str) -> str:
    """Timeframes with an anchored block of the row's direction within one ATR that lives at its bar, its own included."""
    return f"""
    SELECT r.*, a.agreement FROM {rows} r JOIN (
      SELECT r.symbol, r.timeframe, r.htf_idx, count(DISTINCT z.timeframe) + CASE WHEN count(*) FILTER (WHERE z.timeframe = r.timeframe) = 0 THEN 1 ELSE 0 END AS agreement
      FROM {rows} r LEFT JOIN stg z ON NOT z.loose AND z.symbol = r.symbol AND z.bull = r.bull AND z.ce >= r.ce - r.atr AND z.ce <= r.ce + r.atr AND z.formed <= r.idx AND coalesce(z.gone, 1000000000) > r.idx
      GROUP BY r.symbol, r.timeframe, r.htf_idx) a ON a.symbol = r.symbol AND a.timeframe = r.timeframe AND a.htf_idx = r.htf_idx"""


_dep = ql._depth.replace("close", "ce")
_TERMS = {
    "base": "18.0::DOUBLE", "premium_discount": f"greatest({_dep}, 0.0) * 22.0", "liquidity_sweep": "CASE WHEN swept THEN 16.0 ELSE 0.0 END", "htf_fvg": "CASE WHEN in_fvg THEN 14.0 ELSE 0.0 END",
    "opening_gap": "CASE WHEN in_gap THEN 12.0 ELSE 0.0 END", "smt": "CASE WHEN smt_ok THEN 12.0 ELSE 0.0 END", "key_open": "CASE WHEN near_open THEN 10.0 ELSE 0.0 END",
    "amd_window": "CASE WHEN in_amd THEN 8.0 ELSE 0.0 END", "manipulation": "CASE WHEN amdx THEN 18.0 ELSE 0.0 END", "draw": "CASE setup WHEN 2 THEN 14.0 WHEN 1 THEN 8.0 ELSE 0.0 END",
    "bias_aligned": "CASE WHEN (bias > 0) = bull THEN 8.0 ELSE 0.0 END", "displacement": "CASE WHEN strong_close THEN 8.0 ELSE 0.0 END", "large_range": "CASE WHEN large_range THEN 4.0 ELSE 0.0 END",
    "timeframe": "CASE WHEN timeframe >= 60 THEN 5.0 ELSE 3.0 END",
    "relative_volume": "CASE WHEN rvol >= 1.2 THEN 8.0 * greatest(least((rvol - 1.2) / (3.0 - 1.2), 1.0), 0.25) ELSE -4.0 END", "vwap": "CASE WHEN abs(ce - vwap) <= atr * 0.35 THEN 8.0 ELSE 0.0 END",
    "dealer_gamma": "gamma", "midday_lull": "CASE WHEN in_lull THEN -6.0 ELSE 0.0 END", "tf_agreement": "CASE WHEN agreement > 1 THEN least((agreement - 1) / 2.0, 1.0) * 6.0 ELSE 0.0 END"}
_stack = """CAST(swept AS BIGINT) + CAST(fav AS BIGINT) + CAST(in_fvg AS BIGINT) + CAST(in_gap AS BIGINT) + CAST(near_open AS BIGINT) + CAST(in_amd AS BIGINT)
      + CAST(coalesce((bias > 0) = bull, false) AS BIGINT) + CAST(smt_ok AS BIGINT) + CAST(setup <> 0 AS BIGINT) + CAST(rvol >= 1.2 AS BIGINT) + CAST(coalesce(abs(ce - vwap) <= atr * 0.35, false) AS BIGINT)"""
part("cnd", facts_sql("rbl", "CASE WHEN r.bull THEN c.manip_bull ELSE c.manip_bear END"))
part("agr", agreement_sql("cnd"))
_points = f"least(greatest({' + '.join(f'({x})' for x in _TERMS.values())}, 0.0), 100.0)"
part("scored", f"SELECT *, {_points} AS score FROM agr")


def context(spark, sf):
    """Bar contexts under the opened settings, once per query."""
    def make():
        bars = views.bar_table(spark, sf)
        back_to = {v: k for k, v in ql.PEER.items()}
        name = F.create_map(*[F.lit(x) for kv in back_to.items() for x in kv])[c("symbol")]
        peer = bars.select(name.alias("symbol"), "ts", "high", "low")
        return lc.base_context(bars, LOOSE, peer)
    return held("context", spark, sf, make)


def zones(spark, sf):
    return held("zones", spark, sf, lambda: lc.live_zones(context(spark, sf), views.bar_table(spark, sf), LOOSE))


def snapshots(spark, sf):
    """Positioning snapshots: one per session, at its first bar."""
    return views.bar_table(spark, sf).groupBy("symbol", "session").agg(
        F.min("ts").alias("as_of"), F.min_by("open", "ts").alias("spot"), F.max_by("close", "ts").alias("gamma_flip"),
        (F.max("high") * 0.8).alias("call_wall"), (F.min("low") * 1.2).alias("put_wall"))


def candidates(spark, sf):
    """Blocks of every timeframe with their facts, stages and agreement."""
    return held("candidates", spark, sf, lambda: cut_lineage(lc.block_candidates(
        context(spark, sf), zones(spark, sf), views.bar_table(spark, sf), LOOSE, TF, snapshots(spark, sf))))


def graded(spark, sf):
    return sc.grade_score(candidates(spark, sf), LOOSE, sc.gamma_points(LOOSE))


_KEYS = "symbol, timeframe, born_ts, ts, bull"
KEYS = _KEYS.split(", ")


@query("tf_agreement", f"SELECT {_KEYS}, agreement FROM agr")
def tf_agreement(spark, sf):
    """Timeframes that hold a live block of the same direction near each block when it forms."""
    return tidy(candidates(spark, sf).select(*KEYS, "agreement"))


@query("grade_score", f"SELECT {_KEYS}, {R('score')} AS score FROM scored")
def grade_score(spark, sf):
    return tidy(graded(spark, sf).select(*KEYS, "score"))


_grade = "CASE WHEN score >= 80 THEN 'A+' WHEN score >= 66 THEN 'A' WHEN score >= 52 THEN 'B' ELSE 'C' END"


@query("grade_of", f"SELECT {_KEYS}, {_grade} AS grade, CAST(CASE WHEN score >= 80 THEN 4 WHEN score >= 66 THEN 3 WHEN score >= 52 THEN 2 ELSE 1 END AS BIGINT) AS grade_rank FROM scored")
def grade_of(spark, sf):
    grade = sc.grade_of(c("score"))
    return tidy(graded(spark, sf).select(*KEYS, grade.alias("grade"), sc.grade_rank(grade).alias("grade_rank")))


@query("reason_ranking", f"""
    SELECT {_KEYS}, string_agg(k, ',' ORDER BY abs(v) DESC, k) AS reasons, count(*) AS factors FROM (
      SELECT {_KEYS}, htf_idx, unnest([{', '.join(f"'{k}'" for k in _TERMS)}]) AS k, unnest([{', '.join(f'round({x}, 2)' for x in _TERMS.values())}]) AS v FROM agr)
    WHERE v <> 0 GROUP BY {_KEYS}, htf_idx""")
def reason_ranking(spark, sf):
    """Every component that counts, largest first."""
    rows = graded(spark, sf)
    names = F.array_join(F.transform(sc.reason_ranking(c("reasons")), lambda e: e["key"]), ",")
    return rows.select(*KEYS, names.alias("reasons"), F.size("reasons").cast("long").alias("factors"))


@query("setup_type", f"SELECT {_KEYS}, CAST(setup AS BIGINT) AS setup FROM cnd")
def setup_type(spark, sf):
    return tidy(candidates(spark, sf).select(*KEYS, "setup"))


@query("stack_count", f"SELECT {_KEYS}, {_stack} AS stack FROM cnd")
def stack_count(spark, sf):
    return tidy(candidates(spark, sf).select(*KEYS, sc.stack_count(LOOSE).alias("stack")))


@query("anchor_gate", f"SELECT {_KEYS}, CASE WHEN loose THEN 'not_anchored' END AS gate FROM cnd")
def anchor_gate(spark, sf):
    return candidates(spark, sf).select(*KEYS, "gate")


STRICT = replace(LOOSE, min_grade_to_signal="A", require_bias=True, use_stack_gate=True, dol_mode="Both")


def gates_sql(targets: str) -> str:
    """First emission gate under STRICT; targets: condition for having one."""
    return f"""CASE
      WHEN score < 66 AND NOT (score >= 60 AND ({ql._half('pdh', 'pdl', 'ce')}) > 0.45 AND ({ql._half('pwh', 'pwl', 'ce')}) > 0.45 AND {_dep} >= 0.55) THEN 'below_signal_grade'
      WHEN bias IS NULL AND NOT (fav AND {_dep} >= 0.55) THEN 'bias_neutral'
      WHEN (bias > 0) <> bull AND NOT (fav AND {_dep} >= 0.55) THEN 'bias_opposed'
      WHEN {_stack} < 3 THEN 'stack_too_thin'
      WHEN setup = 0 THEN 'no_draw' WHEN rvol < 1.2 THEN 'thin_volume' WHEN NOT {targets} THEN 'no_valid_target' END"""


# Targets lie ahead of the entry for some multiple of the leg if they do for the largest.
def ahead_sql(edge: str) -> str:
    leg = f"(CASE WHEN bull THEN {edge} - ext ELSE ext - {edge} END)"
    return f"({leg} > 0 AND len(list_filter([2.0::DOUBLE, 2.5, 4.0], lambda m: CASE WHEN bull THEN (ext + 1.0 * m * {leg} - close) * 1.0 > 0 ELSE (ext + -1.0 * m * {leg} - close) * -1.0 > 0 END)) > 0)"


_edge = "(CASE WHEN bull THEN top ELSE bottom END)"
part("emt", f"SELECT *, {gates_sql(ahead_sql(_edge))} AS rejection FROM scored")


@query("emit_gates", f"SELECT {_KEYS}, rejection FROM emt")
def emit_gates(spark, sf):
    """The strict emission gates applied to every block, displaced to its zone edge."""
    edge = F.when(c("bull"), c("top")).otherwise(c("bottom"))
    rows = candidates(spark, sf).withColumns({"disp_extreme": edge, "entry": c("close"), "stop": c("ext")})
    return lc.refusals(rows, STRICT).select(*KEYS, "rejection")


@query("gamma_score", f"SELECT {_KEYS}, {R('gamma')} AS points FROM cnd")
def gamma_score(spark, sf):
    return tidy(candidates(spark, sf).select(*KEYS, sc.gamma_points(LOOSE).alias("points")))


@query("regime_columns", "SELECT symbol, as_of, spot > flip AS positive, 'dealer gamma ' || CASE WHEN spot > flip THEN 'positive' ELSE 'negative' END || printf(' (spot %.2f vs flip %.2f)', spot, flip) AS note FROM snap")
def regime_columns(spark, sf):
    return snapshots(spark, sf).select("symbol", "as_of", sc.positive_regime().alias("positive"), sc.regime_note().alias("note"))


@query("score_ceiling", """
    SELECT symbol, max(score) <= 18.0 + 22.0 + 16.0 + 14.0 + 12.0 + 12.0 + 10.0 + 8.0 + 18.0 + 14.0 + 8.0 + 8.0 + 4.0 + 5.0 + 6.0 + 8.0 + 8.0 + 10.0 AS below,
           (18.0 + 22.0 + 16.0 + 14.0 + 12.0 + 12.0 + 10.0 + 8.0 + 18.0 + 14.0 + 8.0 + 8.0 + 4.0 + 5.0 + 6.0 + 8.0 + 8.0 + 10.0)::DOUBLE AS ceiling FROM scored GROUP BY symbol""")
def score_ceiling(spark, sf):
    """Every score against the sum of the enabled weights."""
    top = sc.score_ceiling(LOOSE)
    return graded(spark, sf).groupBy("symbol").agg((F.max("score") <= top).alias("below"), F.lit(top).alias("ceiling"))


part("tgts", """
    SELECT r.symbol, r.timeframe, r.born_ts, c.ts, r.bull, m.m AS leg_multiple, ext + s * m.m * leg AS price, CASE WHEN abs(close - ext) > 0 THEN (ext + s * m.m * leg - close) * s / abs(close - ext) ELSE 0.0 END AS r_multiple, close, s
    FROM (SELECT *, CASE WHEN bull THEN top - ext ELSE ext - bottom END AS leg, CASE WHEN bull THEN 1.0 ELSE -1.0 END AS s FROM rbl) r
    JOIN ctx c ON c.symbol = r.symbol AND c.idx = r.place CROSS JOIN (SELECT unnest([2.0, 2.5, 4.0])::DOUBLE AS m) m WHERE c.atr IS NOT NULL AND leg > 0 AND (ext + s * m.m * leg - close) * s > 0""")


@query("build_targets", f"SELECT {_KEYS}, leg_multiple, {R('price')} AS price, {R('r_multiple', 5)} AS r_multiple FROM tgts")
def build_targets(spark, sf):
    """Targets of every block, displaced to its zone edge."""
    edge = F.when(c("bull"), c("top")).otherwise(c("bottom"))
    rows = candidates(spark, sf).withColumns({"disp_extreme": edge, "entry": c("close"), "stop": c("ext")})
    out = rows.select(*KEYS, F.inline(sc.build_targets(LOOSE)))
    return out.select(*KEYS, "leg_multiple", sh.r6("price").alias("price"), sh.r6("r_multiple", 5).alias("r_multiple"))


part("pg", """
    SELECT e.symbol, e.session, e.ts, e.minute, CASE WHEN x.name IS NOT NULL THEN 'event_blackout:' || x.name WHEN NOT (e.minute >= 570 AND e.minute < 720) THEN 'outside_traded_window'
             WHEN e.minute < 600 THEN 'opening_noise' END AS rejection
    FROM mom_entries e LEFT JOIN (SELECT e.symbol, e.ts, first(k.name ORDER BY k.event_ts, k.name) AS name FROM mom_entries e JOIN cal k ON e.ts >= k.event_ts - 900 AND e.ts <= k.event_ts + 900 GROUP BY ALL) x
    ON x.symbol = e.symbol AND x.ts = e.ts""")
NOISY = replace(LOOSE, traded_window="0930-1200", skip_first_minutes=30)


def gated(spark, sf):
    e = momentum_entries(spark, sf).filter("direction <> 0 AND atr > 0")
    return cal.event_blackout(e, calendar(spark, sf)).withColumn("rejection", sc.post_gates(NOISY))


@query("post_gates", "SELECT symbol, ts, rejection FROM pg")
def post_gates(spark, sf):
    return gated(spark, sf).select("symbol", "ts", "rejection")


@query("session_quota", """
    SELECT symbol, ts, CASE WHEN rejection IS NULL AND n > 2 THEN 'session_quota' ELSE rejection END AS rejection FROM (
      SELECT *, count(*) FILTER (WHERE rejection IS NULL) OVER (PARTITION BY symbol, session ORDER BY ts) AS n FROM pg)""")
def session_quota(spark, sf):
    return sc.session_quota(gated(spark, sf), ["symbol"], 2).select("symbol", "ts", "rejection")


part("cl8", "SELECT * FROM cand_long WHERE direction <> 0")


@query("best_signal_per_bar", """
    SELECT symbol, session, ts, signal_name FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY length(signal_name) DESC, signal_name) AS rn FROM (
      SELECT l.signal_name, l.symbol, l.session, b.ts FROM cl8 l JOIN b ON b.symbol = l.symbol AND b.session = l.session AND b.day_pos = l.day_pos)) WHERE rn = 1""")
def best_signal_per_bar(spark, sf):
    """One candidate per bar: the longest name plays the highest score."""
    df, names = sg.candidate_signals(enriched(spark, sf), 120)
    rows = sg.stack_signals(df, names, ["symbol", "session", "ts"]).withColumns({"score": F.length("signal_name"), "block_seq": c("signal_name")})
    return sc.best_signal_per_bar(rows, ["symbol"]).select("symbol", "session", "ts", "signal_name")


# --- stages of blocks ------------------------------------------------------------------


def stages_sql(move: float, buffer: float) -> str:
    """Stages of each block by plain first-bar searches; hour blocks need no displacement."""
    return f"""
    WITH f AS (SELECT d.symbol, d.idx, coalesce(d.len >= 2 AND d.close > d.lvl AND d.pclose <= d.lvl, false) AS up, coalesce(u.len >= 2 AND u.close < u.lvl AND u.pclose >= u.lvl, false) AS down
               FROM run_dn d JOIN run_up u ON u.symbol = d.symbol AND u.idx = d.idx),
    k AS (SELECT ba.*, f.up, f.down FROM ba JOIN f ON f.symbol = ba.symbol AND f.idx = ba.idx WHERE ba.atr IS NOT NULL),
    s0 AS (SELECT symbol, timeframe, htf_idx, born_ts, loose, ts, idx AS formed, bull, top, bottom, ext, ce, atr FROM cnd),
    s1 AS (SELECT s0.*, CASE WHEN bool_or(timeframe <> 30) THEN min(formed) ELSE min(CASE WHEN k.idx >= formed AND CASE WHEN bull THEN k.high >= ce + s0.atr * {move} ELSE k.low <= ce - s0.atr * {move} END THEN k.idx END) END AS confirmed,
                  min(CASE WHEN k.idx > formed AND CASE WHEN bull THEN k.low < ext - {buffer} ELSE k.high > ext + {buffer} END THEN k.idx END) AS gone
           FROM s0 LEFT JOIN k ON k.symbol = s0.symbol AND k.idx >= formed GROUP BY ALL),
    s2 AS (SELECT s1.*, min(CASE WHEN bull THEN CASE WHEN k.low > top THEN k.idx END WHEN k.high < bottom THEN k.idx END) AS gone_out FROM s1 LEFT JOIN k ON k.symbol = s1.symbol AND k.idx >= confirmed GROUP BY ALL),
    s3 AS (SELECT s2.*, min(CASE WHEN bull THEN CASE WHEN k.low <= top THEN k.idx END WHEN k.high >= bottom THEN k.idx END) AS armed FROM s2 LEFT JOIN k ON k.symbol = s2.symbol AND k.idx > gone_out GROUP BY ALL),
    s4 AS (SELECT s3.*, min(CASE WHEN CASE WHEN bull THEN k.up ELSE k.down END THEN k.idx END) AS triggered FROM s3 LEFT JOIN k ON k.symbol = s3.symbol AND k.idx >= armed GROUP BY ALL)
    SELECT symbol, timeframe, htf_idx, born_ts, loose, ts, bull, ce, formed, CASE WHEN gone IS NULL OR confirmed < gone THEN confirmed END AS confirmed, CASE WHEN gone IS NULL OR gone_out < gone THEN gone_out END AS "left",
           CASE WHEN gone IS NULL OR armed < gone THEN armed END AS armed, CASE WHEN gone IS NULL OR triggered < gone THEN triggered END AS triggered, gone FROM s4"""


part("stg", stages_sql(0.3, 0.0))
part("stg_far", stages_sql(1.0, 0.0))
part("stg_wide", stages_sql(0.3, 0.5))
_FUNNEL = 'count(formed) AS formed, count(confirmed) AS confirmed, count("left") AS "left", count(armed) AS armed, count(triggered) AS triggered'


@query("block_lifecycle", f'SELECT {_KEYS}, formed, confirmed, "left", armed, triggered, gone FROM stg')
def block_lifecycle(spark, sf):
    """First bar of each stage of every block's own life."""
    return candidates(spark, sf).select(*KEYS, "formed", "confirmed", "left", "armed", "triggered", "gone")


@query("funnel_counts", f"SELECT symbol, timeframe, {_FUNNEL} FROM stg GROUP BY symbol, timeframe")
def funnel_counts(spark, sf):
    return tr.funnel_counts(candidates(spark, sf), ["symbol", "timeframe"])


@query("top_rejections", """
    SELECT symbol, reason, n, CAST(row_number() OVER (PARTITION BY symbol ORDER BY n DESC, reason) AS BIGINT) AS rank FROM (
      SELECT symbol, reason, count(*) AS n FROM (
        SELECT symbol, CASE WHEN loose THEN 'not_anchored' END AS reason FROM cnd UNION ALL SELECT symbol, CASE WHEN score < 52 THEN 'below_track_grade' END FROM scored
        UNION ALL SELECT symbol, rejection FROM emt) WHERE reason IS NOT NULL GROUP BY ALL)
    QUALIFY rank <= 5""")
def top_rejections(spark, sf):
    """The five most frequent refusals of a symbol's blocks: by the anchor gate, by grade B and by the strict emission gates."""
    rows = graded(spark, sf)
    low = rows.select("symbol", F.when(sc.grade_rank(sc.grade_of(c("score"))) < 2, "below_track_grade").alias("reason"))
    refused = rows.select("symbol", c("gate").alias("reason")).unionByName(low).unionByName(emit_gates(spark, sf).select("symbol", c("rejection").alias("reason")))
    return tidy(tr.top_rejections(refused.filter(c("reason").isNotNull()), ["symbol"]))


SWEEP = {"base": {}, "far": {"disp_atr_mult": 1.0}, "wide": {"invalidation_buffer": 0.5}}


@query("config_sweep", " UNION ALL ".join(f"SELECT '{n}' AS config, {_FUNNEL} FROM {p}" for n, p in (("base", "stg"), ("far", "stg_far"), ("wide", "stg_wide"))))
def config_sweep(spark, sf):
    """Stages reached under single-setting changes."""
    return tr.funnel_counts(lc.config_sweep(candidates(spark, sf), context(spark, sf), LOOSE, TF, SWEEP), ["config"])


# --- signals of triggers ---------------------------------------------------------------

MODEL = replace(STRICT, min_grade_to_track="B", traded_window="0930-1500", skip_first_minutes=30, max_signals_per_session=1)
part("trg", """
    SELECT *, CASE WHEN bull THEN hi ELSE lo END AS disp_extreme FROM (
      SELECT r.symbol, r.timeframe, r.htf_idx, r.born_ts, r.bull, r.top, r.bottom, r.ext, r.ce, r.strong_close, r.large_range, r.amdx, s.formed, s.triggered AS place, max(k.high) AS hi, min(k.low) AS lo
      FROM scored r JOIN stg s ON s.symbol = r.symbol AND s.timeframe = r.timeframe AND s.htf_idx = r.htf_idx JOIN b k ON k.symbol = r.symbol AND k.idx BETWEEN s.formed AND s.triggered
      WHERE NOT r.loose AND r.score >= 52 AND s.triggered IS NOT NULL GROUP BY ALL)""")
part("trf", facts_sql("trg", "r.amdx", "r.formed, r.disp_extreme,"))
part("tra", agreement_sql("trf"))
part("trs1", f"SELECT *, {_points} AS score FROM tra")
part("tre", f"SELECT *, {gates_sql(ahead_sql('disp_extreme'))} AS refusal FROM trs1")
part("trb", """
    SELECT t.*, CASE WHEN x.name IS NOT NULL THEN 'event_blackout:' || x.name WHEN NOT (minute >= 570 AND minute < 900) THEN 'outside_traded_window' WHEN minute < 600 THEN 'opening_noise' END AS late
    FROM (SELECT * FROM tre WHERE refusal IS NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY score DESC, formed, timeframe, htf_idx) = 1) t
    LEFT JOIN (SELECT t.symbol, t.ts, first(k.name ORDER BY k.event_ts, k.name) AS name FROM (SELECT DISTINCT symbol, ts FROM tre) t JOIN cal k ON t.ts >= k.event_ts - 900 AND t.ts <= k.event_ts + 900 GROUP BY ALL) x
    ON x.symbol = t.symbol AND x.ts = t.ts""")
part("trq", """
    SELECT symbol, timeframe, htf_idx, CASE WHEN late IS NULL AND count(*) FILTER (WHERE late IS NULL) OVER (PARTITION BY symbol, session ORDER BY ts) > 1 THEN 'session_quota' ELSE late END AS late FROM trb""")


@query("signal_pipeline", f"""
    SELECT t.symbol, t.timeframe, t.born_ts, t.ts, t.bull, {_grade.replace('score', 't.score')} AS grade, {R('t.score')} AS score, t.agreement, t.close AS entry, t.ext AS stop,
           coalesce(t.refusal, CASE WHEN q.symbol IS NULL THEN 'not_best_of_bar' END, q.late) AS rejection
    FROM tre t LEFT JOIN trq q ON q.symbol = t.symbol AND q.timeframe = t.timeframe AND q.htf_idx = t.htf_idx""")
def signal_pipeline(spark, sf):
    """Every trigger of an admitted block, graded on its own bar, with the gate that refuses it; NULL is a signal."""
    out = lc.model_signals(candidates(spark, sf), context(spark, sf), zones(spark, sf), MODEL, TF, calendar(spark, sf), snapshots(spark, sf))
    return tidy(out.select(*KEYS, "grade", "score", "agreement", "entry", "stop", "rejection"))
