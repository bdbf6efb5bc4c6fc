"""Grades, gates and signal records as column expressions.

A scored row carries: bull, ce, ext, timeframe, strong_close, large_range,
rvol, near_open, in_amd, amdx, setup, bias, smt_ok, agreement, in_lull, atr,
vwap, has_volume, swept, in_fvg, in_gap and pdh/pdl/pwh/pwl.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.functions import timecols as tc
from tapewright.operators.config import GRADES, GRADE_RANK, LOWEST_GRADE, ModelConfig

c = F.col


def setup_type(cfg: ModelConfig, price: str = "close") -> Column:
    """2 when the extreme sits at its draw, 1 when aligned and favourable.

    Draws are measured from the price, reversal is tested first and an
    unknown bias only rules out a continuation.
    """
    if not cfg.use_dol:
        return F.lit(0)
    band = c("atr") * cfg.dol_band_atr
    at_draw = F.when(c("bull"), c("ext") <= c("draw_down") + band).otherwise(c("ext") >= c("draw_up") - band)
    aligned = sh.truthy((c("bias") > 0) == c("bull")) & sh.favourable(c("ce"), c("bull"), cfg.eq_band_pct)
    kind = F.when(sh.truthy(at_draw), 2).when(aligned, 1).otherwise(0)
    return F.when(c("atr").isNull(), 0).otherwise(kind)


def gamma_points(cfg: ModelConfig) -> Column:
    """Points near a dealer wall by regime; the call wall wins a tie.

    Needs spot, gamma_flip, call_wall and put_wall of the snapshot in force.
    """
    w = F.lit(cfg.w_gamma_wall)
    call_gap, put_gap = F.abs(c("ext") - c("call_wall")), F.abs(c("ext") - c("put_wall"))
    call = F.coalesce(call_gap <= put_gap, call_gap.isNotNull())
    near = F.least(call_gap, put_gap) <= c("atr") * cfg.gamma_wall_band_atr
    aligned = F.when(call, ~c("bull")).otherwise(c("bull"))
    damped = F.when(aligned & (c("setup") == 2), w).when(aligned, w * 0.6).otherwise(-w * 0.5)
    amplified = F.when(c("setup") == 1, w).when(aligned, -w * 0.4).otherwise(0.0)
    return F.when(sh.truthy(near), F.when(positive_regime(), damped).otherwise(amplified)).otherwise(0.0)


def positive_regime() -> Column:
    return sh.truthy(c("spot") > c("gamma_flip"))


def regime_note() -> Column:
    side = F.when(positive_regime(), "positive").otherwise("negative")
    return F.format_string("dealer gamma %s (spot %.2f vs flip %.2f)", side, c("spot"), c("gamma_flip"))


def grade_terms(cfg: ModelConfig, gamma: Column | None = None) -> dict[str, Column]:
    """Every scoring term by name; a term that does not apply is 0."""
    flag = lambda name, points: F.when(sh.truthy(c(name)), points).otherwise(0.0)
    depth = sh.dealing_depth(c("ce"), c("bull"))
    miss = cfg.w_sweep * 0.4 if cfg.free_sweep_credit else 0.0
    terms = {
        "base": F.lit(cfg.base_score),
        "premium_discount": F.greatest(depth, F.lit(0.0)) * cfg.w_pd,
        "liquidity_sweep": F.when(c("swept"), cfg.w_sweep).otherwise(miss),
        "htf_fvg": flag("in_fvg", cfg.w_fvg),
        "opening_gap": flag("in_gap", cfg.w_gap),
        "smt": flag("smt_ok", cfg.w_smt),
        "key_open": flag("near_open", cfg.w_open),
        "amd_window": flag("in_amd", cfg.w_amd),
        "manipulation": flag("amdx", cfg.amdx_boost),
        "draw": F.when(c("setup") == 2, cfg.w_dol_reversal).when(c("setup") == 1, cfg.w_dol_continuation).otherwise(0.0),
        "bias_aligned": F.when(sh.truthy((c("bias") > 0) == c("bull")), cfg.w_bias).otherwise(0.0),
        "displacement": flag("strong_close", cfg.w_displacement),
        "large_range": flag("large_range", 4.0),
        "timeframe": F.when(c("timeframe") >= 60, 5.0).when(c("timeframe") >= 15, 3.0).otherwise(0.0),
    }
    if cfg.use_volume:
        share = F.least((c("rvol") - cfg.min_rvol) / (3.0 - cfg.min_rvol), F.lit(1.0))
        rich = cfg.w_rvol * F.greatest(share, F.lit(0.25))
        terms["relative_volume"] = F.when(
            sh.truthy(c("has_volume")), F.when(c("rvol") >= cfg.min_rvol, rich).otherwise(-cfg.w_rvol * 0.5)).otherwise(0.0)
    if cfg.use_vwap:
        terms["vwap"] = F.when(sh.truthy(F.abs(c("ce") - c("vwap")) <= c("atr") * cfg.vwap_band_atr), cfg.w_vwap).otherwise(0.0)
    if cfg.use_gamma and gamma is not None:
        terms["dealer_gamma"] = gamma
    if cfg.lull_penalty:
        terms["midday_lull"] = flag("in_lull", -cfg.lull_penalty)
    return terms


def agreement_points(cfg: ModelConfig) -> Column:
    extra = F.least((c("agreement") - 1) / F.lit(2.0), F.lit(1.0)) * cfg.w_tf_agreement
    return F.when(c("agreement") > 1, extra).otherwise(0.0)


def clamp_score(points: Column) -> Column:
    return F.least(F.greatest(points, F.lit(0.0)), F.lit(100.0))


def grade_score(df: DataFrame, cfg: ModelConfig, gamma: Column | None = None) -> DataFrame:
    """Add score and reasons (non-zero terms by name, two decimals)."""
    terms = grade_terms(cfg, gamma) | {"tf_agreement": agreement_points(cfg)}
    total = reduce(lambda a, b: a + b, terms.values())
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.round(v, 2).alias("value")) for k, v in terms.items()])
    reasons = F.map_from_entries(F.filter(entries, lambda e: e["value"] != 0))
    return df.withColumns({"score": clamp_score(total), "reasons": reasons})


def grade_of(score: Column) -> Column:
    out = F.when(score >= GRADES[0][1], GRADES[0][0])
    for name, least, _ in GRADES[1:]:
        out = out.when(score >= least, name)
    return out.otherwise(LOWEST_GRADE[0])


def grade_rank(grade: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in GRADE_RANK.items() for x in kv])[grade], F.lit(0))


def stack_count(cfg: ModelConfig) -> Column:
    """How many independent confluences hold."""
    facts = [c("swept"), sh.favourable(c("ce"), c("bull"), cfg.eq_band_pct), c("in_fvg"), c("in_gap"), c("near_open"), c("in_amd"),
             (c("bias") > 0) == c("bull"), c("smt_ok"), c("setup") != 0]
    if cfg.use_volume:
        facts.append(c("has_volume") & (c("rvol") >= cfg.min_rvol))
    if cfg.use_vwap:
        facts.append(F.abs(c("ce") - c("vwap")) <= c("atr") * cfg.vwap_band_atr)
    return reduce(lambda a, b: a + b, [sh.truthy(f).cast("int") for f in facts])


def score_ceiling(cfg: ModelConfig) -> float:
    """Largest sum of the enabled weights, before the clamp."""
    total = (cfg.base_score + cfg.w_pd + cfg.w_sweep + cfg.w_fvg + cfg.w_gap + cfg.w_smt + cfg.w_open + cfg.w_amd + cfg.amdx_boost
             + max(cfg.w_dol_reversal, cfg.w_dol_continuation) + cfg.w_bias + cfg.w_displacement + 4.0 + 5.0 + cfg.w_tf_agreement)
    return total + cfg.use_volume * cfg.w_rvol + cfg.use_vwap * cfg.w_vwap + cfg.use_gamma * cfg.w_gamma_wall


def anchor_gate(cfg: ModelConfig) -> Column:
    """Refusal of an unanchored block, else NULL."""
    fav = sh.favourable(c("ce"), c("bull"), cfg.eq_band_pct)
    held = sh.truthy(c("in_gap")) | sh.truthy(c("amdx")) | F.lit(cfg.gate_intrinsic_any_sweep)
    for switch, fact in ((cfg.gate_fvg, c("in_fvg")), (cfg.gate_key_open, c("near_open")), (cfg.gate_pd, fav)):
        if switch:
            held = held | sh.truthy(fact)
    reason = F.when(~held, "not_anchored")
    return reason.when(~c("in_amd"), "amd_hard_block") if cfg.amd_mode == "Hard" else reason


def emit_gates(cfg: ModelConfig) -> Column:
    """First failing gate of a trigger, NULL when it may become a signal."""
    depth = sh.dealing_depth(c("ce"), c("bull"))
    low = grade_rank(c("grade")) < GRADE_RANK[cfg.min_grade_to_signal]
    if cfg.allow_b_grade_deep_pd:
        deep = sh.truthy(sh.deep_on_both(c("ce"), c("bull"))) & sh.truthy(depth >= cfg.pd_strong)
        low = low & ~((c("score") >= 60) & deep)
    gates = [F.when(low, "below_signal_grade")]
    if cfg.require_bias:
        strong = sh.favourable(c("ce"), c("bull"), cfg.eq_band_pct) & sh.truthy(depth >= cfg.pd_strong)
        gates.append(F.when(c("bias").isNull() & ~strong, "bias_neutral"))
        gates.append(F.when(sh.truthy((c("bias") > 0) != c("bull")) & ~strong, "bias_opposed"))
    if cfg.use_stack_gate:
        gates.append(F.when(c("stack") < cfg.min_stack, "stack_too_thin"))
    if cfg.smt_required:
        gates.append(F.when(~sh.truthy(c("smt_ok")), "smt_required"))
    if cfg.use_dol and cfg.dol_mode in ("Both", "Continuation only", "Reversal only"):
        wanted = {"Both": (c("setup") == 0, "no_draw"), "Continuation only": (c("setup") != 1, "not_continuation"),
                  "Reversal only": (c("setup") != 2, "not_reversal")}[cfg.dol_mode]
        gates.append(F.when(*wanted))
    if cfg.use_volume:
        gates.append(F.when(sh.truthy(c("has_volume")) & (c("rvol") < cfg.min_rvol), "thin_volume"))
    gates.append(F.when(F.size("targets") == 0, "no_valid_target"))
    return F.coalesce(*gates)


def post_gates(cfg: ModelConfig) -> Column:
    """Blackout, traded window and opening noise, in this order."""
    return F.coalesce(
        F.when(c("blocked_by").isNotNull(), F.concat(F.lit("event_blackout:"), c("blocked_by"))),
        F.when(~tc.in_session(c("minute"), cfg.traded_window), "outside_traded_window"),
        F.when(c("minute") < tc.RTH_OPEN + cfg.skip_first_minutes, "opening_noise"),
    )


def session_quota(df: DataFrame, keys: list[str], quota: int) -> DataFrame:
    """Rows past the quota of their session get the reason session_quota."""
    w = Window.partitionBy(*keys, "session").orderBy("ts")
    nth = F.count(F.when(c("rejection").isNull(), 1)).over(w)
    return df.withColumn("rejection", F.when(c("rejection").isNull() & (nth > quota), "session_quota").otherwise(c("rejection")))


def best_signal_per_bar(df: DataFrame, keys: list[str]) -> DataFrame:
    """The highest score of a bar; the older block wins a tie."""
    w = Window.partitionBy(*keys, "ts").orderBy(c("score").desc(), c("block_seq"))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def build_targets(cfg: ModelConfig) -> Column:
    """Targets from the extreme by leg multiples; those behind the entry drop out."""
    sign = F.when(c("bull"), 1.0).otherwise(-1.0)
    leg = (c("disp_extreme") - c("ext")) * sign
    risk = F.abs(c("entry") - c("stop"))
    rows = F.transform(F.array(*[F.lit(m) for m in cfg.sigma_levels]), lambda m: F.struct(
        m.alias("leg_multiple"), (c("ext") + sign * m * leg).alias("price"),
        F.when(risk > 0, (c("ext") + sign * m * leg - c("entry")) * sign / risk).otherwise(0.0).alias("r_multiple")))
    ahead = F.filter(rows, lambda t: (t["price"] - c("entry")) * sign > 0)
    return F.when(leg > 0, ahead).otherwise(F.filter(rows, lambda t: F.lit(False)))


def reason_ranking(reasons: Column) -> Column:
    """Components by absolute size, largest first, names breaking ties."""
    def smaller(a, b):
        d = F.abs(b["value"]) - F.abs(a["value"])
        return F.when(d > 0, 1).when(d < 0, -1).when(a["key"] > b["key"], 1).when(a["key"] < b["key"], -1).otherwise(0)
    return F.array_sort(F.map_entries(reasons), smaller)
