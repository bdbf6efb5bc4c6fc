"""Random-entry nulls drawn by hashing, identical on any partitioning.

A draw picks a position in the session's list of entry bars from a hash of
(seed, symbol, session), so the number of rows is seeds x sessions and never
seeds x bars; draws and their outcomes are computed inside the session's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.medians import exact_medians
from tapewright.functions import timecols as tc
from tapewright.operators import resolve as rs

c = F.col
MODES = ("random", "long", "short")


def hash_int(text: Column, at: int = 1, width: int = 8) -> Column:
    """A stable non-negative number from the md5 digest of a text."""
    return F.conv(F.substring(F.md5(text), at, width), 16, 10).cast("long")


def draw_text(seed: Column) -> Column:
    return F.concat_ws("|", seed.cast("string"), c("symbol"), c("session"))


def random_null_entries(bars: DataFrame, window: str, seeds: list[int], modes: tuple[str, ...] = MODES) -> DataFrame:
    """One entry bar per (seed, session), the same bar in every mode.

    bars carry atr. The result has everything resolve_entry wants except the
    stop and target widths.
    """
    paths = _entry_paths(bars, window)
    return _draws(paths, seeds, modes).select(
        "symbol", "session", F.inline("draws")).select(
        "symbol", "session", "seed", "mode", "day_pos", "direction", "entry", "atr")


def _entry_paths(bars: DataFrame, window: str) -> DataFrame:
    inside = tc.in_session(c("minute"), window)
    paths = rs.session_paths(bars.withColumn("_in", inside), ("atr", "_in"))
    spots = F.filter(F.sequence(F.lit(1), F.size("path")), lambda i: F.get("path", i - 1)["_in"])
    return paths.withColumn("_spots", spots).filter(F.size("_spots") > 0)


def _draws(paths: DataFrame, seeds: list[int], modes: tuple[str, ...]) -> DataFrame:
    """Add `draws`: one struct per (seed, mode)."""
    picks = F.transform(F.array(*[F.lit(s) for s in seeds]), lambda s: F.struct(
        s.alias("seed"),
        F.get("_spots", F.pmod(hash_int(draw_text(s)), F.size("_spots")).cast("int")).alias("day_pos"),
        F.when(hash_int(draw_text(s), 9, 1) < 8, 1).otherwise(-1).alias("coin"),
    ))
    side = lambda p, m: F.when(m == "long", 1).when(m == "short", -1).otherwise(p.coin)
    draws = F.flatten(F.transform("_picks", lambda p: F.transform(F.array(*[F.lit(m) for m in modes]), lambda m: F.struct(
        p.seed.alias("seed"), m.alias("mode"), p.day_pos.cast("long").alias("day_pos"), side(p, m).alias("direction"),
        F.get("path", p.day_pos - 1)["close"].alias("entry"), F.get("path", p.day_pos - 1)["atr"].alias("atr")))))
    return paths.withColumn("_picks", picks).withColumn("draws", draws).drop("_picks", "_spots")


def random_null_trades(bars: DataFrame, window: str, seeds: list[int], structures: list[tuple[float, float]],
                       hold: int, modes: tuple[str, ...] = MODES, cost_atr: float = rs.COST_ATR) -> DataFrame:
    """Draws crossed with (stop, target) structures and resolved in place."""
    base = _draws(_entry_paths(bars, window), seeds, modes)
    grid = F.array(*[F.struct(F.lit(float(s)).alias("stop_atr"), F.lit(float(t)).alias("target_atr")) for s, t in structures])
    alive = F.filter("draws", lambda d: d.atr > 0)
    levels = F.flatten(F.transform(alive, lambda d: F.transform(grid, lambda g: F.struct(
        d.seed.alias("seed"), d.mode.alias("mode"), d.day_pos.alias("day_pos"), d.direction.alias("direction"),
        d.entry.alias("entry"), d.atr.alias("atr"), g.stop_atr.alias("stop_atr"), g.target_atr.alias("target_atr"),
        (d.entry - d.direction * g.stop_atr * d.atr).alias("stop"),
        (d.entry + d.direction * g.target_atr * d.atr).alias("target")))))
    keep = ["seed", "mode", "day_pos", "direction", "entry", "atr", "stop_atr", "target_atr", "stop", "target"]
    rows = base.withColumn("_l", levels).select("symbol", "session", F.inline(F.transform("_l", lambda x: rs.resolved(x, keep, hold)))).filter("_n > 0")
    stopped = (c("_stop_at") > 0) & ((c("_target_at") == 0) | (c("_stop_at") <= c("_target_at")))
    won = ~stopped & (c("_target_at") > 0)
    gross = (F.when(stopped, -1.0).when(won, c("target_atr") / c("stop_atr"))
             .otherwise((c("_last") - c("entry")) * c("direction") / (c("stop_atr") * c("atr"))))
    return rows.select(
        "symbol", "session", "seed", "mode", "day_pos", "direction", "stop_atr", "target_atr",
        F.when(stopped, "stop").when(won, "target").otherwise("time").alias("outcome"),
        (gross - F.lit(cost_atr) / c("stop_atr")).alias("r"))


def bootstrap_average(trades: DataFrame, by: list[str]) -> DataFrame:
    """Mean of per-seed means, error across seeds, mean win share and count."""
    per_seed = trades.groupBy(*by, "seed").agg(
        F.avg("r").alias("m"), F.avg((c("r") > 0).cast("double")).alias("w"), F.count(F.lit(1)).alias("k"))
    return per_seed.groupBy(*by).agg(
        F.avg("m").alias("mean_r"),
        F.when(F.count("m") > 1, F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("se"),
        F.avg("w").alias("win"),
        F.floor(F.avg("k")).cast("long").alias("n"),
    )


def null_grid(trades: DataFrame, seeds: int, by: list[str]) -> DataFrame:
    """Pooled mean and spread per structure, and the spread of seed means."""
    per_seed = trades.groupBy(*by, "seed").agg(
        F.sum("r").alias("s1"), F.sum(c("r") * c("r")).alias("s2"), F.count(F.lit(1)).alias("k"),
        F.count_if(c("r") > 0).alias("wins"))
    mean = F.sum("s1") / F.sum("k")
    return per_seed.groupBy(*by).agg(
        (F.sum("k") / F.lit(float(seeds))).alias("n_per_seed"),
        mean.alias("mean_r_net"),
        F.sqrt(F.greatest(F.sum("s2") / F.sum("k") - mean * mean, F.lit(0.0))).alias("sd_r"),
        F.stddev_pop(c("s1") / c("k")).alias("seed_spread"),
        (F.sum("wins") / F.sum("k")).alias("win"),
    )


def drift_table(base_rates: DataFrame) -> DataFrame:
    """Long minus short mean per structure."""
    side = lambda m: F.max(F.when(c("mode") == m, c("mean_r")))
    return base_rates.groupBy("stop_atr", "target_atr").agg(
        side("random").alias("random_r"), side("long").alias("long_r"), side("short").alias("short_r"),
        (side("long") - side("short")).alias("drift"))


def null_structure_match(trades: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """Nearest grid row to the median stop and target, in log distance.

    The grid holds a handful of structures by construction, so it travels as
    one array next to each group's medians.
    """
    mid = exact_medians(trades, by, ["stop_atr", "target_r"]).withColumnsRenamed({"stop_atr": "med_stop", "target_r": "med_target"})
    packed = grid.agg(F.sort_array(F.collect_list(F.struct(*grid.columns))).alias("_grid"))
    dist = lambda g: F.abs(F.log(g.stop_atr / c("med_stop"))) + F.abs(F.log(g.target_r / c("med_target")))
    near = F.array_min(F.transform("_grid", lambda g: F.struct(dist(g).alias("d"), g.alias("g"))))
    out = mid.join(F.broadcast(packed)).withColumn("_near", near)
    return out.select(*by, "med_stop", "med_target", c("_near.d").alias("distance"), "_near.g.*")
