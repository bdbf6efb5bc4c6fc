"""Settings of the block model, as one immutable record.

The defaults are fixed values; change single fields with `replace`.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ModelConfig:
    # Fixed values throughout.
    # timeframes, minutes
    rb_timeframes: tuple[int, ...] = (5, 15)
    base_timeframe: int = 1
    bias_timeframe: int = 60
    htf_fvg_timeframe: int = 60
    # grade, quota, bias
    min_grade_to_track: str = "A"
    min_grade_to_signal: str = "A"
    max_signals_per_session: int = 6
    bias_state_lookback: int = 6
    require_bias: bool = True
    bias_expires: bool = True
    bias_max_age_bars: int = 24
    # premium and discount
    prev_period_lag: int = 1
    eq_band_pct: float = 0.10
    w_pd: float = 22.0
    pd_strong: float = 0.55
    allow_b_grade_deep_pd: bool = True
    # anchors
    gate_fvg: bool = True
    gate_key_open: bool = True
    gate_pd: bool = True
    gate_intrinsic_any_sweep: bool = False
    prox_atr_mult: float = 0.15
    key_opens: tuple[str, ...] = ("ny_open", "macro", "pm")
    # manipulation
    amd_mode: str = "Soft"
    amd_windows: tuple[str, ...] = ("0930-1100", "0200-0500")
    hunt_manipulation: bool = True
    killzones: tuple[str, ...] = ("0700-1100",)
    hunt_pd_pools: bool = True
    hunt_hod_lod: bool = True
    amdx_boost: float = 18.0
    # formation
    require_min_sweep: bool = True
    sweep_atr_mult: float = 0.08
    min_body_fraction: float = 0.45
    require_reclaim: bool = False
    require_displacement: bool = True
    disp_atr_mult: float = 0.9
    htf_blocks_skip_displacement: bool = True
    swing_lookback: int = 10
    require_strong_close: bool = True
    strong_close_pct: float = 0.45
    atr_length: int = 14
    invalidation_buffer: float = 0.0
    # gaps
    fvg_min_points: float = 0.5
    fvg_stale_atr: float = 8.0
    include_order_block: bool = True
    track_gaps: bool = True
    gap_min_points: float = 0.3
    gap_stale_atr: float = 10.0
    # liquidity
    score_pd_sweeps: bool = True
    sweep_recency_bars: int = 12
    use_session_sweeps: bool = True
    sweep_sessions: tuple[tuple[str, str], ...] = (("london", "0300-1100"), ("ny", "0930-1600"))
    use_px_levels: bool = True
    px_sessions: tuple[tuple[str, str], ...] = (("ny", "0930-1600"),)
    # divergence
    use_smt: bool = True
    smt_pivot_strength: int = 5
    smt_required: bool = False
    smt_max_age_bars: int = 8
    # stack and draw
    use_stack_gate: bool = True
    min_stack: int = 3
    use_dol: bool = True
    dol_mode: str = "Both"
    dol_band_atr: float = 0.5
    w_dol_continuation: float = 8.0
    w_dol_reversal: float = 14.0
    sigma_levels: tuple[float, ...] = (2.0, 2.5, 4.0)
    # trigger
    use_state_trigger: bool = True
    state_lookback: int = 4
    state_min_run: int = 2
    state_mode: str = "original"
    state_first_close: bool = True
    # weights
    w_sweep: float = 16.0
    w_fvg: float = 14.0
    w_gap: float = 12.0
    w_smt: float = 12.0
    w_open: float = 10.0
    w_amd: float = 8.0
    w_bias: float = 8.0
    w_displacement: float = 8.0
    base_score: float = 18.0
    free_sweep_credit: bool = False
    use_volume: bool = True
    min_rvol: float = 1.2
    w_rvol: float = 8.0
    rvol_lookback_sessions: int = 20
    use_vwap: bool = True
    vwap_band_atr: float = 0.35
    w_vwap: float = 8.0
    use_gamma: bool = True
    w_gamma_wall: float = 10.0
    gamma_wall_band_atr: float = 0.6
    w_tf_agreement: float = 6.0
    # time of day and events
    traded_window: str = "0930-1200"
    skip_first_minutes: int = 5
    lull_window: str = "1200-1330"
    lull_penalty: float = 6.0
    event_block_before_min: int = 15
    event_block_after_min: int = 15


# Grade thresholds, best first, and their ranks.
GRADES = (("A+", 80.0, 4), ("A", 66.0, 3), ("B", 52.0, 2))
LOWEST_GRADE = ("C", 1)
GRADE_RANK = {name: rank for name, _, rank in GRADES} | dict([LOWEST_GRADE])
