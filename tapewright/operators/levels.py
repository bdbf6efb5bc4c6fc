"""Session ranges, sweeps, manipulation, gaps, divergences and draws.

All operators take indexed bars (idx, day_pos, session_no). Windows are bound
to a session, to a chunk with a halo, or carry one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.functions import timecols as tc
from tapewright.operators import indicators as ind
from tapewright.operators.alive import in_interval, last_sessions
from tapewright.operators.config import ModelConfig
from tapewright.operators.order import (
    CHUNK, asof_join, back, carry_last, over_history, session_so_far, session_w)
from tapewright.operators.search import first_hit, search_index

c = F.col


# --- ranges of named sessions -------------------------------------------------

def session_ranges(df: DataFrame, specs: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """Add {p}_inside, _enter, _exit and the running _high/_low per window.

    A range restarts when price enters the window from outside, judged on
    consecutive bars of the symbol and not on dates. Ranges run inside chunks;
    a chunk that opens in the middle of a visit takes over the extremes of the
    chunks before it, one summary row each. All windows share one join.
    """
    out = df.withColumns({f"{p}_inside": tc.in_session(c("minute"), spec) for p, spec in specs.items()})

    def add(part, w):
        was = {p: F.coalesce(F.lag(f"{p}_inside").over(w), F.lit(False)) for p in specs}
        return part.withColumns({f"{p}_enter": c(f"{p}_inside") & ~was[p] for p in specs} |
                                {f"{p}_exit": ~c(f"{p}_inside") & was[p] for p in specs})

    out = over_history(out, 1, add).withColumn("chunk", F.floor(c("idx") / F.lit(chunk)).cast("long"))
    so_far = Window.partitionBy("symbol", "chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"_{p}_from": F.max(F.when(c(f"{p}_enter"), c("idx"))).over(so_far) for p in specs})
    for p in specs:
        visit = Window.partitionBy("symbol", "chunk", f"_{p}_from").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({
            f"_{p}_h": F.max(F.when(c(f"{p}_inside"), c("high"))).over(visit),
            f"_{p}_l": F.min(F.when(c(f"{p}_inside"), c("low"))).over(visit)})
    tails = out.groupBy("symbol", "chunk").agg(*[
        x for p in specs for x in (
            F.max(f"_{p}_from").alias(f"{p}_r"), F.max_by(f"_{p}_h", "idx").alias(f"{p}_h"), F.max_by(f"_{p}_l", "idx").alias(f"{p}_l"))])
    by_chunk = Window.partitionBy("symbol").orderBy("chunk")
    tails = tails.withColumns({
        f"{p}_g": F.count(f"{p}_r").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)) for p in specs})
    for p in specs:
        group = Window.partitionBy("symbol", f"{p}_g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
        tails = tails.withColumns({f"{p}_h": F.max(f"{p}_h").over(group), f"{p}_l": F.min(f"{p}_l").over(group)})
    carried = tails.select("symbol", "chunk", *[
        F.lag(f"{p}_{side}").over(by_chunk).alias(f"_{p}_c{side}") for p in specs for side in ("h", "l")])
    out = out.join(carried, ["symbol", "chunk"])
    opened = lambda p: c(f"_{p}_from").isNotNull()
    out = out.withColumns(
        {f"{p}_high": F.when(opened(p), c(f"_{p}_h")).otherwise(F.greatest(f"_{p}_h", f"_{p}_ch")) for p in specs} |
        {f"{p}_low": F.when(opened(p), c(f"_{p}_l")).otherwise(F.least(f"_{p}_l", f"_{p}_cl")) for p in specs})
    return out.drop("chunk", *[f"_{p}_{x}" for p in specs for x in ("from", "h", "l", "ch", "cl")])


def session_running_range(df: DataFrame, spec: str, prefix: str) -> DataFrame:
    """Running range of one named window."""
    return session_ranges(df, {prefix: spec})


def _hold_ranges(df: DataFrame, finals: dict[str, str], live: dict[str, str]) -> DataFrame:
    """Frozen ranges for `finals`, live ones with complete/done for `live`."""
    out = session_ranges(df, finals | live)
    today = {f"{p}_done": F.max(c(f"{p}_exit").cast("int")).over(session_so_far()) == 1 for p in live}
    if today:
        out = out.withColumns(today)
    frozen = {f"_{p}_f": F.when(c(f"{p}_exit"), F.struct(c(f"{p}_high").alias("h"), c(f"{p}_low").alias("l"))) for p in finals}
    turns = {f"{p}_complete": F.when(c(f"{p}_exit"), True).when(c(f"{p}_enter"), False) for p in live}
    out = carry_last(out, frozen | turns)
    out = out.withColumns(
        {f"{p}_final_high": c(f"_{p}_f.h") for p in finals} | {f"{p}_final_low": c(f"_{p}_f.l") for p in finals} |
        {f"{p}_complete": F.coalesce(f"{p}_complete", F.lit(False)) for p in live})
    spare = [f"{p}_{x}" for p in finals for x in ("high", "low") if p not in live]
    flags = [f"{p}_{x}" for p in finals | live for x in ("inside", "enter", "exit")]
    return out.drop(*[f"_{p}_f" for p in finals], *spare, *flags)


def finalised_session_range(df: DataFrame, spec: str, prefix: str) -> DataFrame:
    """Range frozen at the first bar outside, held until the next one freezes."""
    return _hold_ranges(df, {prefix: spec}, {})


def px_session_range(df: DataFrame, spec: str, prefix: str) -> DataFrame:
    """Live range that outlives its session, with `complete` and `done`.

    complete: left and not entered again; done: left on this New York date.
    """
    return _hold_ranges(df, {}, {prefix: spec})


def with_liquidity(df: DataFrame, cfg: ModelConfig) -> DataFrame:
    """All session ranges the model reads (needs pdh.. from with_period_ranges)."""
    finals = {f"ss_{name}": spec for name, spec in cfg.sweep_sessions}
    return _hold_ranges(df, finals, {f"px_{name}": spec for name, spec in cfg.px_sessions})


def liquidity_levels(cfg: ModelConfig, high_side: bool) -> Column:
    """Levels that count as engineered liquidity, missing ones left out."""
    side = "high" if high_side else "low"
    levels = []
    if cfg.score_pd_sweeps:
        levels.append(F.when(sh.range_ready(), c("pdh" if high_side else "pdl")))
    if cfg.use_session_sweeps:
        levels += [c(f"ss_{n}_final_{side}") for n, _ in cfg.sweep_sessions]
    if cfg.use_px_levels:
        levels += [c(f"px_{n}_{side}") for n, _ in cfg.px_sessions]
    return F.array_compact(F.array(*levels)) if levels else F.array().cast("array<double>")


def rolling_sweep(df: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Add sweep_bull/sweep_bear: pierced within the window, closed back now."""
    span = max(1, cfg.sweep_recency_bars)

    def add(part, w):
        frame = back(w, span - 1)
        return part.withColumns({"_ll": F.min("low").over(frame), "_hh": F.max("high").over(frame)})

    out = over_history(df, span, add)
    bull = F.exists(liquidity_levels(cfg, False), lambda v: (c("_ll") < v) & (c("close") > v))
    bear = F.exists(liquidity_levels(cfg, True), lambda v: (c("_hh") > v) & (c("close") < v))
    return out.withColumns({"sweep_bull": bull, "sweep_bear": bear}).drop("_ll", "_hh")


# --- manipulation --------------------------------------------------------------

def day_extreme_raid(df: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Add raid_bear/raid_bull: a new day extreme closed back inside.

    Each new extreme opens an island holding the extreme it took out; the
    first killzone bar of the island that closes back inside consumes it.
    """
    w, so_far = session_w(), session_so_far()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({"_hod": F.max("high").over(before), "_lod": F.min("low").over(before)})
    out = out.withColumns({
        "_hi_no": F.sum(sh.truthy(c("high") > c("_hod")).cast("int")).over(so_far),
        "_lo_no": F.sum(sh.truthy(c("low") < c("_lod")).cast("int")).over(so_far)})
    hi_w = Window.partitionBy("symbol", "session", "_hi_no").orderBy("ts")
    lo_w = Window.partitionBy("symbol", "session", "_lo_no").orderBy("ts")
    up = lambda x: x.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({
        "_hi_lvl": F.when(c("_hi_no") > 0, F.first("_hod").over(up(hi_w))),
        "_lo_lvl": F.when(c("_lo_no") > 0, F.first("_lod").over(up(lo_w)))})
    kz = tc.in_any(c("minute"), cfg.killzones)
    out = out.withColumns({
        "_hq": sh.truthy(kz & (c("close") < c("_hi_lvl"))).cast("int"),
        "_lq": sh.truthy(kz & (c("close") > c("_lo_lvl"))).cast("int")})
    first = lambda flag, x: (c(flag) == 1) & (F.sum(flag).over(up(x)) == 1)
    return out.withColumns({"raid_bear": first("_hq", hi_w), "raid_bull": first("_lq", lo_w)}).drop(
        "_hod", "_lod", "_hi_no", "_lo_no", "_hi_lvl", "_lo_lvl", "_hq", "_lq")


def manipulation_latch(df: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Add manip_bull/manip_bear: an event in the last bars, this one included.

    Needs the columns of with_liquidity and with_period_ranges.
    """
    if not cfg.hunt_manipulation:
        return df.withColumns({"manip_bull": F.lit(False), "manip_bear": F.lit(False)})
    out = day_extreme_raid(df, cfg)
    kz = tc.in_any(c("minute"), cfg.killzones)
    bear, bull = F.lit(False), F.lit(False)
    if cfg.hunt_pd_pools:
        bear = bear | (sh.range_ready() & sh.truthy((c("high") > c("pdh")) & (c("close") < c("pdh"))))
        bull = bull | (sh.range_ready() & sh.truthy((c("low") < c("pdl")) & (c("close") > c("pdl"))))
    if cfg.hunt_hod_lod:
        bear, bull = bear | c("raid_bear"), bull | c("raid_bull")
    for n, _ in cfg.px_sessions:
        hi, lo = c(f"px_{n}_high"), c(f"px_{n}_low")
        bear = bear | sh.truthy(c(f"px_{n}_done") & (c("high") > hi) & (c("close") < hi))
        bull = bull | sh.truthy(c(f"px_{n}_done") & (c("low") < lo) & (c("close") > lo))
    out = out.withColumns({"_bear": kz & bear, "_bull": kz & bull}).drop("raid_bear", "raid_bull")

    def add(part, w):
        frame = back(w, cfg.sweep_recency_bars)
        return part.withColumns({"manip_bull": F.max("_bull").over(frame), "manip_bear": F.max("_bear").over(frame)})

    return over_history(out, cfg.sweep_recency_bars + 1, add).drop("_bear", "_bull")


# --- gaps and their lives --------------------------------------------------------

def fvg_detect(df: DataFrame, min_points: float) -> DataFrame:
    """Three-bar gaps: one row per gap with its order block (the bar two back)."""

    def add(part, w):
        return part.withColumns({"_ah": F.lag("high", 2).over(w), "_al": F.lag("low", 2).over(w)})

    out = over_history(df, 2, add)
    up = (c("low") > c("_ah")) & ((c("low") - c("_ah")) >= min_points)
    down = (c("high") < c("_al")) & ((c("_al") - c("high")) >= min_points)
    out = out.withColumn("direction", F.when(up, 1).when(down, -1)).filter(c("direction").isNotNull())
    return out.select(
        "symbol", "session", "ts", "idx", "direction",
        F.when(c("direction") > 0, c("low")).otherwise(c("_al")).alias("top"),
        F.when(c("direction") > 0, c("_ah")).otherwise(c("high")).alias("bottom"),
        c("_ah").alias("ob_top"), c("_al").alias("ob_bottom"))


def gap_detect(df: DataFrame, min_points: float) -> DataFrame:
    """Band between the last close and a new day's open, when wide enough."""
    days = df.groupBy("symbol", "session", "session_no").agg(
        F.min_by("open", "idx").alias("_o"), F.min("idx").alias("born_idx"), F.min("ts").alias("ts"),
        F.max_by("close", "idx").alias("_c"))
    paired = days.withColumn("_pc", F.lag("_c").over(Window.partitionBy("symbol").orderBy("session_no")))
    top, bottom = F.greatest("_pc", "_o"), F.least("_pc", "_o")
    return paired.filter(c("_pc").isNotNull() & ((top - bottom) >= min_points)).select(
        "symbol", "session", c("session_no").alias("born_session"), "born_idx", "ts", top.alias("top"), bottom.alias("bottom"))


def zone_lifetime(zones: DataFrame, bars: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Fair value gaps with [born_idx, dead_idx): closed through, or further from the price than the stale distance.

    zones: symbol, zone_id, direction, top, bottom, ob_top, ob_bottom,
    born_idx, born_session. dead_idx and dead_session are NULL for a zone still
    alive. Zones live side by side without limit.
    """
    ob = cfg.include_order_block
    lo = F.least("bottom", "ob_bottom") if ob else c("bottom")
    hi = F.greatest("top", "ob_top") if ob else c("top")
    mid = (c("top") + c("bottom")) / 2.0
    levels = {"close_under": F.when(c("direction") > 0, lo), "close_over": F.when(c("direction") < 0, hi), "far_over": mid, "far_under": mid}
    out = first_hit(zones, search_index(bars, cfg.fvg_stale_atr), levels, "born_idx", "born_session", "dead_idx")
    return out.withColumnRenamed("dead_idx_session", "dead_session")


def gap_lifetime(gaps: DataFrame, bars: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Opening gaps with [born_idx, dead_idx): both edges touched, or stale.

    The three searches of a gap are three rows of one search.
    """
    mid = (c("top") + c("bottom")) / 2.0
    kinds = gaps.withColumn("_kind", F.explode(F.array(F.lit("top"), F.lit("bottom"), F.lit("stale"))))
    only = lambda kind, level: F.when(c("_kind") == kind, level)
    levels = {"high_to": only("top", c("top")), "low_to": only("bottom", c("bottom")), "far_over": only("stale", mid), "far_under": only("stale", mid)}
    found = first_hit(kinds, search_index(bars, cfg.gap_stale_atr), levels, "born_idx", "born_session", "_at")
    of = lambda kind: F.max(F.when(c("_kind") == kind, F.struct(c("_at").alias("idx"), c("_at_session").alias("session"))))
    both = found.groupBy(*gaps.columns).agg(of("top").alias("_t"), of("bottom").alias("_b"), of("stale").alias("_s"))
    hit = lambda n: F.when(c(f"{n}.idx").isNotNull(), c(n))
    touched = F.when(c("_t.idx").isNotNull() & c("_b.idx").isNotNull(), F.greatest("_t", "_b"))
    dead = both.withColumn("_d", F.least(touched, hit("_s")))
    return dead.select(*gaps.columns, c("_d.idx").alias("dead_idx"), c("_d.session").alias("dead_session"))


def gap_intervals(zones: DataFrame, include_ob: bool = True) -> DataFrame:
    """Fair value gaps as intervals with a life and a side: the gap itself and its order block."""
    own = F.struct(c("bottom").alias("lo"), c("top").alias("hi"))
    block = F.struct(c("ob_bottom").alias("lo"), c("ob_top").alias("hi"))
    return zones.select("symbol", c("direction").alias("side"), "born_idx", "born_session", "dead_idx", "dead_session", F.inline(F.array(own, block) if include_ob else F.array(own)))


def active_zone_contains(rows: DataFrame, zones: DataFrame, bars: DataFrame, price: Column, want: Column, name: str, include_ob: bool = True) -> DataFrame:
    """Add `name`: does the row's price lie in a zone of the wanted direction that is alive at its bar?

    rows: symbol, idx (one row each), session_no.
    """
    asked = rows.select("symbol", "idx", "session_no", want.alias("side"), price.alias("_p"))
    hits = in_interval(asked, ["symbol", "idx"], gap_intervals(zones, include_ob), last_sessions(bars), "_p").select("symbol", "idx", F.lit(True).alias(name))
    return rows.join(hits, ["symbol", "idx"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


# --- higher timeframes -------------------------------------------------------------

def closed_htf_asof(base: DataFrame, htf: DataFrame, width: int, value: str, span: int = 86_400 * 8) -> DataFrame:
    """Last higher-timeframe row whose bar has closed by each base bar.

    htf: symbol, ts, idx and a struct column `value`.
    """
    ref = htf.select("symbol", (c("ts") + width * 60).alias("_closed"), "idx", value)
    return asof_join(base, ref, "symbol", "ts", "_closed", value, span, seq="idx")


def closed_htf_events(base: DataFrame, htf: DataFrame, width: int) -> DataFrame:
    """One row per closed higher-timeframe bar: htf_idx and the base bar that saw it close."""
    marked = htf.withColumn("_h", F.struct(c("idx").alias("htf_idx")))
    placed = closed_htf_asof(base.select("symbol", "ts", "idx", "session_no"), marked, width, "_h")
    placed = placed.withColumn("_now", F.coalesce(c("_h.htf_idx"), F.lit(-1)))
    stepped = over_history(placed, 1, lambda d, w: d.withColumn("_was", F.coalesce(F.lag("_now").over(w), F.lit(-1))))
    fresh = stepped.filter(c("_now") > c("_was"))
    return fresh.select("symbol", F.explode(F.sequence(c("_was") + 1, c("_now"))).alias("htf_idx"),
                        c("idx").alias("born_idx"), c("session_no").alias("born_session"), c("ts").alias("seen_ts"))


# --- divergence -----------------------------------------------------------------------

def peer_join(bars: DataFrame, peer: DataFrame) -> DataFrame:
    """Peer high/low at the same time, and whether the feeds line up fully.

    peer: symbol (of the bars it accompanies), ts, high, low.
    """
    other = peer.select("symbol", "ts", c("high").alias("peer_high"), c("low").alias("peer_low"), F.lit(1).alias("_has"))
    joined = bars.join(other, ["symbol", "ts"], "left")
    mine = joined.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.count("_has").alias("_m"))
    theirs = peer.groupBy("symbol").agg(F.count(F.lit(1)).alias("_p"))
    flags = mine.join(theirs, "symbol", "left").select(
        "symbol", sh.truthy((c("_n") == c("_m")) & (c("_n") == c("_p"))).alias("peer_available"))
    # One row per symbol: a join by symbol would leave the bars, and the windows after it, in one task per symbol.
    return joined.drop("_has").join(F.broadcast(flags), "symbol")


def smt_divergence(df: DataFrame, strength: int) -> DataFrame:
    """Add smt_bear/smt_bull at pivots where the peer does not follow.

    A pivot is compared with the symbol's previous pivot of the same kind.
    """
    out = ind.pivot_low(ind.pivot_high(df, strength, strength, "_ph"), strength, strength, "_pl")

    def peers(part, w):
        return part.withColumns({"_qh": F.lag("peer_high", strength).over(w), "_ql": F.lag("peer_low", strength).over(w)})

    out = over_history(out, strength, peers)
    pair = lambda mine, theirs: F.when(c(mine).isNotNull(), F.struct(c(mine).alias("a"), c(theirs).alias("b")))
    out = carry_last(out, {"_hs": pair("_ph", "_qh"), "_ls": pair("_pl", "_ql")})
    out = over_history(out, 1, lambda d, w: d.withColumns({"_h0": F.lag("_hs").over(w), "_l0": F.lag("_ls").over(w)}))
    bear = (c("_ph") > c("_h0.a")) & (c("_qh") < c("_h0.b"))
    bull = (c("_pl") < c("_l0.a")) & (c("_ql") > c("_l0.b"))
    return out.withColumns({"smt_bear": sh.truthy(bear), "smt_bull": sh.truthy(bull)}).drop(
        "_ph", "_pl", "_qh", "_ql", "_hs", "_ls", "_h0", "_l0")


def smt_confirmed(df: DataFrame, max_age: int) -> DataFrame:
    """Add smt_bull_ok/smt_bear_ok: the last divergence is recent enough."""
    at = lambda flag: F.when(c(flag), c("idx"))
    out = carry_last(df, {"_b": at("smt_bull"), "_s": at("smt_bear")})
    ok = lambda n: sh.truthy((c("idx") - c(n)) <= max_age)
    return out.withColumns({"smt_bull_ok": ok("_b"), "smt_bear_ok": ok("_s")}).drop("_b", "_s")


# --- draws -------------------------------------------------------------------------------

def draw_targets(df: DataFrame, cfg: ModelConfig, price: str = "close") -> DataFrame:
    """Add draw_up/draw_down: nearest level beyond the price on each side."""
    above, below = [c("pdh"), c("pwh")], [c("pdl"), c("pwl")]
    for n, _ in cfg.px_sessions:
        above.append(F.when(c(f"px_{n}_complete"), c(f"px_{n}_high")))
        below.append(F.when(c(f"px_{n}_complete"), c(f"px_{n}_low")))
    up = F.array_min(F.filter(F.array(*above), lambda v: v > c(price)))
    down = F.array_max(F.filter(F.array(*below), lambda v: v < c(price)))
    return df.withColumns({"draw_up": up, "draw_down": down})
