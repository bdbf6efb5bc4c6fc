"""Opposing runs, changes of state and rejection blocks on indexed bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.operators.config import ModelConfig
from tapewright.operators.order import back, carry_last, over_history

c = F.col


def _run_columns(w: WindowSpec, look: int, want_down: bool) -> dict[str, Column]:
    """First contiguous run of opposing bars within `look` bars back.

    near/far are distances (in bars) of its newest and oldest bar; leading
    bars of the other kind are skipped.
    """
    match = sh.truthy(sh.is_down() if want_down else sh.is_up())
    hits = {k: sh.truthy(F.lag(match, k).over(w)) for k in range(1, look + 1)}
    near = F.coalesce(*[F.when(hits[k], F.lit(k)) for k in hits])
    ends = [F.when((near < k) & ~hits[k], F.lit(k - 1)) for k in range(2, look + 1)]
    far = F.when(near.isNotNull(), F.coalesce(*ends, F.lit(look)))
    return {"near": near, "far": far}


def _pick_lag(name: str, w: WindowSpec, far: Column, look: int) -> Column:
    return F.coalesce(*[F.when(far == k, F.lag(name, k).over(w)) for k in range(1, look + 1)])


def opposing_run(df: DataFrame, look: int, want_down: bool, prefix: str = "run") -> DataFrame:
    """Add {prefix}_level (open of the run's oldest bar), _len and _start."""

    def add(part, w):
        part = part.withColumns({f"_{k}": v for k, v in _run_columns(w, look, want_down).items()})
        return part.withColumns({
            f"{prefix}_level": _pick_lag("open", w, c("_far"), look),
            f"{prefix}_len": F.coalesce(c("_far") - c("_near") + 1, F.lit(0)),
            f"{prefix}_start": c("idx") - c("_far"),
        }).drop("_near", "_far")

    return over_history(df, look, add)


def run_holds_extreme(df: DataFrame, look: int, bull: bool, prefix: str = "run", name: str = "holds_extreme") -> DataFrame:
    """Is the look-back's extreme bar (the earliest on ties) inside the run?"""

    def add(part, w):
        frame = back(w, look, 1)
        best = F.min_by("idx", F.struct("low", "idx")) if bull else F.min_by("idx", F.struct(-c("high"), c("idx")))
        return part.withColumn("_at", best.over(frame))

    out = over_history(df, look, add)
    first, length = c(f"{prefix}_start"), c(f"{prefix}_len")
    inside = (c("_at") >= first) & (c("_at") <= first + length - 1)
    return out.withColumn(name, sh.truthy(inside)).drop("_at")


def change_of_state(df: DataFrame, bull: bool, look: int, cfg: ModelConfig, name: str = "fired") -> DataFrame:
    """Close through the open at which the opposing run began."""
    out = opposing_run(df, look, bull, "_r")
    if cfg.state_mode == "swing_anchored":
        out = run_holds_extreme(out, look, bull, "_r", "_ext")
    else:
        out = out.withColumn("_ext", F.lit(True))
    out = over_history(out, 1, lambda d, w: d.withColumn("_prev", F.lag("close").over(w)))
    level = c("_r_level")
    crossed = c("close") > level if bull else c("close") < level
    if cfg.state_first_close:
        other_side = c("_prev") <= level if bull else c("_prev") >= level
        crossed = crossed & F.when(c("_prev").isNull(), True).otherwise(other_side)
    fired = (c("_r_len") >= cfg.state_min_run) & c("_ext") & crossed
    return out.withColumn(name, sh.truthy(fired)).drop("_r_level", "_r_len", "_r_start", "_ext", "_prev")


def change_direction(df: DataFrame, cfg: ModelConfig, look: int | None = None, name: str = "direction") -> DataFrame:
    """+1, -1 or 0 for the change of state on this bar; bull is tested first."""
    look = look or cfg.bias_state_lookback
    out = change_of_state(change_of_state(df, True, look, cfg, "_up"), False, look, cfg, "_down")
    return out.withColumn(name, F.when(c("_up"), 1).when(c("_down"), -1).otherwise(0)).drop("_up", "_down")


def bias_state(df: DataFrame, cfg: ModelConfig, name: str = "bias") -> DataFrame:
    """Last direction on the bias timeframe, NULL when unset or too old."""
    out = change_direction(df, cfg, name="_d")
    mark = F.when(c("_d") != 0, F.struct(c("_d").alias("d"), c("idx").alias("at")))
    out = carry_last(out, {"_last": mark})
    fresh = F.lit(True) if not cfg.bias_expires else (c("idx") - c("_last.at")) <= cfg.bias_max_age_bars
    return out.withColumn(name, F.when(fresh, c("_last.d"))).drop("_d", "_last")


def rejection_block(df: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Add block columns to indexed bars with ATR; `bull` is NULL for no block.

    Real body, a sweep of the prior extreme by a share of ATR, a wick on the
    swept side and a strong close away from it.
    """
    out = opposing_run(opposing_run(df, cfg.state_lookback, True, "_dn"), cfg.state_lookback, False, "_up")

    def add(part, w):
        frame = back(w, cfg.swing_lookback, 1)
        return part.withColumns({"_pl": F.min("low").over(frame), "_ph": F.max("high").over(frame)})

    out = over_history(out, cfg.swing_lookback, add)
    need = max(cfg.swing_lookback, cfg.state_lookback) + 1
    depth = c("atr") * cfg.sweep_atr_mult if cfg.require_min_sweep else F.lit(0.0)
    body = (c("idx") >= need) & c("atr").isNotNull() & (sh.bar_range() > 0) & (sh.body_fraction() >= cfg.min_body_fraction)
    strong_up = sh.close_position() >= cfg.strong_close_pct
    strong_down = (1.0 - sh.close_position()) >= cfg.strong_close_pct
    swept_low = (c("low") < c("_pl")) & ((c("_pl") - c("low")) >= depth) & (sh.body_bottom() > c("low"))
    swept_high = (c("high") > c("_ph")) & ((c("high") - c("_ph")) >= depth) & (c("high") > sh.body_top())
    if cfg.require_reclaim:
        swept_low = swept_low & (c("close") > c("_pl"))
        swept_high = swept_high & (c("close") < c("_ph"))
    if cfg.require_strong_close:
        swept_low, swept_high = swept_low & strong_up, swept_high & strong_down
    bull = F.when(body & sh.is_up() & swept_low, True).when(body & sh.is_down() & swept_high, False)
    out = out.withColumn("bull", bull)
    by_side = lambda up, down: F.when(c("bull"), up).when(~c("bull"), down)
    return out.withColumns({
        "top": by_side(sh.body_bottom(), c("high")),
        "bottom": by_side(c("low"), sh.body_top()),
        "ext": by_side(c("low"), c("high")),
        "state_level": by_side(F.coalesce("_dn_level", "open"), F.coalesce("_up_level", "open")),
        "strong_close": by_side(strong_up, strong_down),
        "large_range": F.when(c("bull").isNotNull(), sh.bar_range() >= c("atr") * 0.8),
        "ce": by_side((sh.body_bottom() + c("low")) / 2.0, (c("high") + sh.body_top()) / 2.0),
    }).drop("_dn_level", "_dn_len", "_dn_start", "_up_level", "_up_len", "_up_start", "_pl", "_ph")
