"""Blocks on their bars' context, and the stages of each block's own life.

All of it is columns: contexts, candidates with their gates, for each block the
first bar of every stage, found by session searches, and the signals of its
trigger. No block's life depends on another block.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import timecols as tc
from tapewright.operators import bars as ob
from tapewright.operators import calendar as cal
from tapewright.operators import detect as dt
from tapewright.operators import indicators as ind
from tapewright.operators import levels as lv
from tapewright.operators import order
from tapewright.operators import score as sc
from tapewright.operators.alive import in_interval, kinds_near, last_sessions
from tapewright.operators.config import ModelConfig
from tapewright.operators.search import first_hit, range_extremes, search_index
from tapewright.session import cut_lineage

c = F.col
CLOSED_SPAN = 86_400 * 4


def timeframes(cfg: ModelConfig, chart_tf: int) -> list[int]:
    """Detection timeframes; the base one is never finer than the chart."""
    extra = (max(cfg.base_timeframe, chart_tf),) if cfg.base_timeframe else ()
    return sorted({t for t in (*cfg.rb_timeframes, *extra) if t > 0})


def base_context(bars: DataFrame, cfg: ModelConfig, peer: DataFrame | None = None) -> DataFrame:
    """Indexed bars with every bar-level fact the model reads."""
    df = cut_lineage(ind.atr(order.with_index(bars), cfg.atr_length))
    df = ind.relative_volume(ind.session_vwap(ind.key_opens(df, cfg.key_opens)), cfg.rvol_lookback_sessions)
    df = df.join(F.broadcast(ob.missing_volume_flag(bars)), "symbol").join(ob.period_ranges(bars, cfg.prev_period_lag), ["symbol", "session"])
    if cfg.use_smt and peer is not None:
        df = lv.smt_confirmed(lv.smt_divergence(lv.peer_join(df, peer), cfg.smt_pivot_strength), cfg.smt_max_age_bars)
        df = df.withColumns({n: c(n) & c("peer_available") for n in ("smt_bull_ok", "smt_bear_ok")}).drop(
            "peer_high", "peer_low", "smt_bull", "smt_bear")
    else:
        df = df.withColumns({n: F.lit(False) for n in ("smt_bull_ok", "smt_bear_ok", "peer_available")})
    df = cut_lineage(lv.with_liquidity(cut_lineage(df), cfg))
    df = lv.draw_targets(lv.manipulation_latch(lv.rolling_sweep(df, cfg), cfg), cfg)
    df = dt.change_of_state(df, True, cfg.state_lookback, cfg, "fired_bull")
    df = cut_lineage(dt.change_of_state(df, False, cfg.state_lookback, cfg, "fired_bear"))
    wide = cut_lineage(order.with_index(ob.resample_bars(bars, cfg.bias_timeframe)))
    state = cut_lineage(dt.bias_state(wide, cfg).select("symbol", "ts", "idx", F.struct("bias").alias("_b")))
    df = lv.closed_htf_asof(df, state, cfg.bias_timeframe, "_b", CLOSED_SPAN).withColumn("bias", c("_b.bias")).drop("_b")
    return cut_lineage(df)


def live_zones(ctx: DataFrame, bars: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Price intervals with a life: fair value gaps and their order blocks (side 1 or -1), opening gaps (side 0)."""
    wide = cut_lineage(order.with_index(ob.resample_bars(bars, cfg.htf_fvg_timeframe)))
    seen = lv.closed_htf_events(ctx, wide, cfg.htf_fvg_timeframe).select("symbol", c("htf_idx").alias("zone_id"), "born_idx", "born_session")
    fvgs = lv.fvg_detect(wide, cfg.fvg_min_points).withColumnRenamed("idx", "zone_id").drop("session", "ts").join(seen, ["symbol", "zone_id"])
    out = lv.gap_intervals(lv.zone_lifetime(cut_lineage(fvgs), ctx, cfg), cfg.include_order_block)
    if cfg.track_gaps:
        gaps = lv.gap_lifetime(cut_lineage(lv.gap_detect(ctx, cfg.gap_min_points)), ctx, cfg)
        out = out.unionByName(gaps.select("symbol", F.lit(0).alias("side"), "born_idx", "born_session", "dead_idx", "dead_session", c("bottom").alias("lo"), c("top").alias("hi")))
    return cut_lineage(out)


#: What identifies a block: a bar of its timeframe makes one at most.
BLOCK = ["symbol", "timeframe", "htf_idx"]


def situate(blocks: DataFrame, ctx: DataFrame, zones: DataFrame, cfg: ModelConfig, at: str = "idx") -> DataFrame:
    """Blocks with the facts that the grade reads, at the bar `at`, and that bar's context; blocks on bars without an ATR go.

    Only block rows meet the zones. A column amdx of the blocks is kept.
    """
    spare = [n for n in blocks.columns if n in ctx.columns and n != "symbol" and n != at]
    out = blocks.drop(*spare).withColumnRenamed(at, "idx").join(ctx, ["symbol", "idx"]).filter(c("atr").isNotNull())
    if "amdx" not in blocks.columns:
        out = out.withColumn("amdx", F.when(c("bull"), c("manip_bull")).otherwise(c("manip_bear")))
    out = cut_lineage(out)
    want = F.when(c("bull"), 1).otherwise(-1)
    asked = out.select(*BLOCK, "idx", "session_no", "ce", F.explode(F.array(want, F.lit(0))).alias("side"))
    hits = in_interval(asked, BLOCK, zones, last_sessions(ctx), "ce").groupBy(*BLOCK).agg(
        F.max(c("side") != 0).alias("in_fvg"), F.max(c("side") == 0).alias("in_gap"))
    by_side = lambda up, down: F.when(c("bull"), c(up)).otherwise(c(down))
    out = out.join(hits, BLOCK, "left").withColumns({
        "in_fvg": F.coalesce("in_fvg", F.lit(False)), "in_gap": F.coalesce("in_gap", F.lit(False)),
        "near_open": ind.near_key_open(c("ce"), c("atr") * cfg.prox_atr_mult, cfg.key_opens),
        "in_amd": tc.in_any(c("minute"), cfg.amd_windows) if cfg.amd_mode != "Off" else F.lit(False),
        "in_lull": tc.in_session(c("minute"), cfg.lull_window),
        "swept": by_side("sweep_bull", "sweep_bear"),
        "smt_ok": by_side("smt_bull_ok", "smt_bear_ok"),
    })
    return out.withColumn("setup", sc.setup_type(cfg))


def with_gamma(rows: DataFrame, snapshots: DataFrame | None, span: int = 86_400) -> tuple[DataFrame, bool]:
    """Rows with the last positioning snapshot (symbol, as_of, spot, gamma_flip, call_wall, put_wall) before their bar, if there are snapshots."""
    if snapshots is None:
        return rows, False
    ref = snapshots.select("symbol", "as_of", F.struct("spot", "gamma_flip", "call_wall", "put_wall").alias("_g"))
    return order.asof_join(rows, ref, "symbol", "ts", "as_of", "_g", span).select("*", "_g.*").drop("_g"), True


def found_blocks(ctx: DataFrame, bars: DataFrame, cfg: ModelConfig, chart_tf: int) -> DataFrame:
    """Blocks of every timeframe: BLOCK, idx (the base bar that saw it close), born_ts and its shape."""
    parts = []
    for tf in timeframes(cfg, chart_tf):
        series = bars if tf == chart_tf else ob.resample_bars(bars, tf)
        wide = cut_lineage(ind.atr(order.with_index(series), cfg.atr_length))
        found = dt.rejection_block(wide, cfg).filter(c("bull").isNotNull()).select(
            "symbol", c("idx").alias("htf_idx"), c("ts").alias("born_ts"), "bull", "top", "bottom", "ce", "ext", "strong_close", "large_range")
        seen = lv.closed_htf_events(ctx, wide, tf).select("symbol", "htf_idx", c("born_idx").alias("idx"))
        parts.append(cut_lineage(found.join(seen, ["symbol", "htf_idx"])).withColumn("timeframe", F.lit(tf).cast("long")))
    return reduce(DataFrame.unionByName, parts)


def block_candidates(ctx: DataFrame, zones: DataFrame, bars: DataFrame, cfg: ModelConfig, chart_tf: int, snapshots: DataFrame | None = None) -> DataFrame:
    """Blocks of every timeframe on the context of the bar that saw them close.

    Each carries its first gate refusal (`gate`), its stages (see
    `block_events`) and `agreement`.
    """
    rows = situate(found_blocks(ctx, bars, cfg, chart_tf), ctx, zones, cfg)
    rows, _ = with_gamma(rows.withColumn("gate", sc.anchor_gate(cfg)), snapshots)
    rows = cut_lineage(block_events(cut_lineage(rows), ctx, cfg, chart_tf))
    return tf_agreement(rows, rows, ctx, timeframes(cfg, chart_tf))


def tf_agreement(rows: DataFrame, blocks: DataFrame, ctx: DataFrame, kinds: list[int]) -> DataFrame:
    """Add agreement: timeframes, the row's own included, that hold a block of its direction within one ATR of it at its bar.

    rows: BLOCK, bull, ce and idx, session_no and atr of the bar. blocks:
    anchored ones count, from the bar that saw them close until they are gone,
    whatever became of them in between and whatever their grade.
    """
    side = F.when(c("bull"), 1).otherwise(-1).alias("side")
    lives = blocks.filter(c("gate").isNull()).select(
        "symbol", side, c("timeframe").alias("kind"), c("ce").alias("level"), c("formed").alias("born_idx"), c("formed_session").alias("born_session"),
        c("gone").alias("dead_idx"), c("gone_session").alias("dead_session"))
    asked = rows.select(*BLOCK, side, "idx", "session_no", (c("ce") - c("atr")).alias("_low"), (c("ce") + c("atr")).alias("_high"))
    near = kinds_near(asked, BLOCK, lives, last_sessions(ctx), "_low", "_high", kinds)
    own = F.array(c("timeframe").cast("int"))
    return rows.join(near, BLOCK, "left").withColumn("agreement", F.size(F.array_union(own, F.coalesce("kinds", own)))).drop("kinds")


STAGES = ("formed", "confirmed", "left", "armed", "triggered")


def block_events(blocks: DataFrame, ctx: DataFrame, cfg: ModelConfig, chart_tf: int) -> DataFrame:
    """Add the bar and session of each stage of a block's own life, and of its end (all NULL if never).

    formed: the bar that saw it close. confirmed: price has moved
    disp_atr_mult ATR of that bar away from ce, or at once where no
    displacement is asked for. left: a bar wholly beyond the zone, armed: a
    later bar that touches it again, triggered: a change of state at or after
    that. gone: a bar after the first beyond ext and the buffer. Stages from
    the end on don't count. The searches carry a block's shape alone, and each
    is cut off from the next: the tables that a task holds are those of one.
    """
    index = tuple(cut_lineage(t) for t in search_index(ctx, 0.0, c("fired_bull"), c("fired_bear")))
    up, down = lambda x: F.when(c("bull"), x), lambda x: F.when(~c("bull"), x)
    move = c("atr") * cfg.disp_atr_mult
    # The way out of the zone and the end are two searches from one place: two rows of one search.
    shape = blocks.select(*BLOCK, "bull", "top", "bottom", "ce", "ext", "atr", "idx", "session_no")
    kinds = shape.select(*BLOCK, "bull", "ce", "ext", "atr", "idx", "session_no", F.explode(F.array(F.lit("confirmed"), F.lit("gone"))).alias("_kind"))
    only = lambda kind, level: F.when(c("_kind") == kind, level)
    found = first_hit(kinds.withColumn("_from", c("idx") + only("gone", 1).isNotNull().cast("int")), index, {
        "high_to": only("confirmed", up(c("ce") + move)), "low_to": only("confirmed", down(c("ce") - move)),
        "low_under": only("gone", up(c("ext") - cfg.invalidation_buffer)), "high_over": only("gone", down(c("ext") + cfg.invalidation_buffer))}, "_from", "session_no", "_at")
    both = found.groupBy(*BLOCK).agg(*[F.max(only(kind, c(n))).alias(name) for kind in ("confirmed", "gone") for n, name in (("_at", kind), ("_at_session", f"{kind}_session"))])
    out = cut_lineage(shape.join(both, BLOCK)).withColumns({"formed": c("idx"), "formed_session": c("session_no")})
    at_once = F.lit(not cfg.require_displacement) | (F.lit(cfg.htf_blocks_skip_displacement) & (c("timeframe") != chart_tf))
    out = out.withColumns({"confirmed": F.when(at_once, c("formed")).otherwise(c("confirmed")), "confirmed_session": F.when(at_once, c("formed_session")).otherwise(c("confirmed_session"))})
    out = cut_lineage(first_hit(out, index, {"wholly_over": up(c("top")), "wholly_under": down(c("bottom"))}, "confirmed", "confirmed_session", "left"))
    out = out.withColumn("_again", c("left") + 1)
    out = cut_lineage(first_hit(out, index, {"low_to": up(c("top")), "high_to": down(c("bottom"))}, "_again", "left_session", "armed"))
    if cfg.use_state_trigger:
        out = first_hit(out, index, {"mark_up": up(F.lit(1)), "mark_down": down(F.lit(1))}, "armed", "armed_session", "triggered")
    else:
        out = out.withColumns({"triggered": c("armed"), "triggered_session": c("armed_session")})
    alive = {n: F.when(c("gone").isNull() | (c(f"{s}") < c("gone")), c(n)) for s in STAGES[1:] for n in (f"{s}_session", s)}
    stages = out.withColumns(alive).select(*BLOCK, *[f"{n}{x}" for n in (*STAGES, "gone") for x in ("", "_session")])
    return blocks.join(cut_lineage(stages), BLOCK)


def refusals(rows: DataFrame, cfg: ModelConfig, name: str = "rejection") -> DataFrame:
    """Rows with agreement (and snapshots): add score, reasons, grade, stack, targets and the first emission gate that refuses.

    rows carry disp_extreme, entry and stop of the signal to be.
    """
    gamma = sc.gamma_points(cfg) if "gamma_flip" in rows.columns else None
    out = sc.grade_score(rows, cfg, gamma)
    out = out.withColumns({"grade": sc.grade_of(c("score")), "stack": sc.stack_count(cfg), "targets": sc.build_targets(cfg)})
    return out.withColumn(name, sc.emit_gates(cfg))


def model_signals(candidates: DataFrame, ctx: DataFrame, zones: DataFrame, cfg: ModelConfig, chart_tf: int, calendar: DataFrame | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """Every trigger of an anchored, tracked block with what became of it: `rejection`, NULL for a signal.

    Two points in time: a block is admitted by its grade on the bar that saw it
    close, and graded again on the context of the bar that triggers it. Refused
    there by a gate, else `not_best_of_bar` (a higher score on the same bar;
    the older block wins a tie), by the calendar, the traded window, opening
    noise or the session's quota, in this order. A signal needs no other
    block's fate; only the best of a bar and the quota look at other triggers.
    """
    gamma = sc.gamma_points(cfg) if "gamma_flip" in candidates.columns else None
    born = sc.grade_score(candidates.filter(c("gate").isNull()), cfg, gamma)
    kept = born.filter(sc.grade_rank(sc.grade_of(c("score"))) >= sc.GRADE_RANK[cfg.min_grade_to_track]).filter(c("triggered").isNotNull())
    index = tuple(cut_lineage(t) for t in search_index(ctx))
    kept = range_extremes(kept, index, "formed", "formed_session", "triggered", "triggered_session")
    shape = [*BLOCK, "born_ts", "bull", "top", "bottom", "ce", "ext", "strong_close", "large_range", "amdx", "formed", "triggered"]
    kept = cut_lineage(kept.select(*shape, F.when(c("bull"), c("high_between")).otherwise(c("low_between")).alias("disp_extreme"), c("score").alias("born_score")))
    rows = situate(kept, ctx, zones, cfg, "triggered")
    rows, _ = with_gamma(rows, snapshots)
    rows = tf_agreement(cut_lineage(rows), candidates, ctx, timeframes(cfg, chart_tf))
    sign = F.when(c("bull"), 1).otherwise(-1)
    rows = refusals(rows.withColumns({"entry": c("close"), "stop": c("ext") - sign * cfg.invalidation_buffer}), cfg)
    rows = cut_lineage(rows.withColumn("block_seq", F.struct("formed", "timeframe", "htf_idx")))
    passed = sc.best_signal_per_bar(rows.filter(c("rejection").isNull()), ["symbol"])
    if calendar is not None:
        passed = cal.event_blackout(passed, calendar, cfg.event_block_before_min, cfg.event_block_after_min)
    else:
        passed = passed.withColumn("blocked_by", F.lit(None).cast("string"))
    passed = sc.session_quota(passed.withColumn("rejection", sc.post_gates(cfg)), ["symbol"], cfg.max_signals_per_session)
    later = passed.select(*BLOCK, F.lit(True).alias("_best"), c("rejection").alias("_late"))
    out = rows.join(later, BLOCK, "left")
    return out.withColumn("rejection", F.coalesce("rejection", F.when(c("_best").isNull(), "not_best_of_bar"), "_late")).drop("_best", "_late", "block_seq")


def build_context(bars: DataFrame, cfg: ModelConfig, chart_tf: int, peer: DataFrame | None = None, snapshots: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bar contexts, zones with their lives, and the block candidates."""
    ctx = base_context(bars, cfg, peer)
    zones = live_zones(ctx, bars, cfg)
    return ctx, zones, cut_lineage(block_candidates(ctx, zones, bars, cfg, chart_tf, snapshots))


def config_sweep(blocks: DataFrame, ctx: DataFrame, base: ModelConfig, chart_tf: int, changes: dict[str, dict]) -> DataFrame:
    """Stages of the same blocks under several settings of the stages, with a column `config`."""
    stages = [f"{n}{x}" for n in (*STAGES, "gone") for x in ("", "_session")]
    bare = cut_lineage(blocks.drop(*stages))
    return reduce(DataFrame.unionByName, [block_events(bare, ctx, replace(base, **change), chart_tf).withColumn("config", F.lit(name)) for name, change in changes.items()])
