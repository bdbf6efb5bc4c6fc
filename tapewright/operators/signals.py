"""Signals: DataFrame transforms that add an int column in {-1, 0, +1}.

Input is indexed bars (idx, day_pos, session_no). A user-defined signal is any
function with the same shape; `python_signal` wraps arbitrary pandas code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions import shape as sh
from tapewright.operators import bars as ob
from tapewright.operators import indicators as ind
from tapewright.operators.order import back, over_history, session_so_far, session_w

c = F.col
Signal = Callable[[DataFrame], DataFrame]


def _put(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, F.coalesce(value, F.lit(0)).cast("int"))


def negate(df: DataFrame, source: str, name: str) -> DataFrame:
    return df.withColumn(name, -c(source))


def with_session_edges(df: DataFrame) -> DataFrame:
    """Add day_open and prev_close (last close of the previous held session)."""
    days = df.groupBy("symbol", "session").agg(
        F.min_by("open", "ts").alias("day_open"), F.max_by("close", "ts").alias("_last"))
    w = Window.partitionBy("symbol").orderBy("session")
    days = days.select("symbol", "session", "day_open", F.lag("_last").over(w).alias("prev_close"))
    return df.join(days, ["symbol", "session"])


def with_prev_day(df: DataFrame) -> DataFrame:
    """Add prev_high and prev_low of the previous held session."""
    r = ob.period_ranges(df).select("symbol", "session", c("pdh").alias("prev_high"), c("pdl").alias("prev_low"))
    return df.join(r, ["symbol", "session"])


def opening_range_break(df: DataFrame, minutes: int = 30, name: str = "signal") -> DataFrame:
    """Close beyond the completed opening range."""
    out = ind.opening_range(df, minutes)
    usable = c("or_complete") & (c("or_high") > c("or_low"))
    side = F.when(c("close") > c("or_high"), 1).when(c("close") < c("or_low"), -1)
    return _put(out, name, F.when(usable, side)).drop("or_high", "or_low", "or_complete")


def gap_fade(df: DataFrame, min_frac: float = 0.001, name: str = "signal") -> DataFrame:
    """Against an opening gap, on the session's first three bars.

    Needs day_open and prev_close.
    """
    gap = (c("day_open") - c("prev_close")) / c("prev_close")
    side = F.when(gap > 0, -1).otherwise(1)
    return _put(df, name, F.when((c("day_pos") <= 3) & (F.abs(gap) >= min_frac), side))


def prev_day_sweep_reclaim(df: DataFrame, name: str = "signal") -> DataFrame:
    """Pierce yesterday's extreme and close back inside; the high goes first."""
    top = (c("high") > c("prev_high")) & (c("close") < c("prev_high"))
    bottom = (c("low") < c("prev_low")) & (c("close") > c("prev_low"))
    return _put(df, name, F.when(top, -1).when(bottom, 1))


def prev_day_break(df: DataFrame, name: str = "signal") -> DataFrame:
    return _put(df, name, F.when(c("close") > c("prev_high"), 1).when(c("close") < c("prev_low"), -1))


def momentum(df: DataFrame, look_back: int = 6, name: str = "signal") -> DataFrame:
    """Sign of the move over the last bars of the same session."""
    return _put(df, name, sh.sign_of(c("close") - F.lag("close", look_back).over(session_w())))


def range_expansion(df: DataFrame, mult: float = 2.0, look_back: int = 20, name: str = "signal") -> DataFrame:
    """A bar much wider than the mean of those before it, in its own direction."""
    frame = back(session_w(), look_back, 1)
    wide = df.withColumn("_rng", sh.bar_range())
    out = wide.withColumns({"_mean": F.avg("_rng").over(frame), "_n": F.count("_rng").over(frame)})
    big = (c("_n") == look_back) & (c("_mean") > 0) & (c("_rng") >= mult * c("_mean"))
    return _put(out, name, F.when(big, sh.sign_of(c("close") - c("open")))).drop("_rng", "_mean", "_n")


def first_bar_continuation(df: DataFrame, name: str = "signal") -> DataFrame:
    first = F.first(sh.sign_of(c("close") - c("open"))).over(session_so_far())
    out = df.withColumn("_first", first)
    return _put(out, name, F.when(c("day_pos").between(4, 6), c("_first"))).drop("_first")


def inside_bar_break(df: DataFrame, name: str = "signal") -> DataFrame:
    """Break of a bar that its predecessor contains, inside one session."""
    w = session_w()
    out = df.withColumns({
        "_h1": F.lag("high", 1).over(w), "_l1": F.lag("low", 1).over(w),
        "_h2": F.lag("high", 2).over(w), "_l2": F.lag("low", 2).over(w),
    })
    inside = (c("_h1") <= c("_h2")) & (c("_l1") >= c("_l2"))
    side = F.when(c("close") > c("_h1"), 1).when(c("close") < c("_l1"), -1)
    return _put(out, name, F.when(inside, side)).drop("_h1", "_l1", "_h2", "_l2")


def ema_cross(df: DataFrame, fast: str, slow: str, slow_length: int, name: str = "signal") -> DataFrame:
    """The fast average crosses the slow one on this bar of the session."""
    w = session_w()
    out = df.withColumns({"_f0": F.lag(fast).over(w), "_s0": F.lag(slow).over(w)})
    up = (c("_f0") <= c("_s0")) & (c(fast) > c(slow))
    down = (c("_f0") >= c("_s0")) & (c(fast) < c(slow))
    side = F.when(up, 1).when(down, -1)
    return _put(out, name, F.when(c("idx") >= slow_length + 2, side)).drop("_f0", "_s0")


def ema_trend(df: DataFrame, ema: str, name: str = "signal") -> DataFrame:
    return _put(df, name, sh.sign_of(c("close") - c(ema)))


def ema_pullback(df: DataFrame, fast: str, slow: str, slow_length: int, name: str = "signal") -> DataFrame:
    """In trend, touches the fast average and closes with the trend."""
    up = (c(fast) > c(slow)) & (c("low") <= c(fast)) & (c("close") > c(fast))
    down = (c(fast) < c(slow)) & (c("high") >= c(fast)) & (c("close") < c(fast))
    usable = (c("idx") >= slow_length + 2) & (c("day_pos") >= 2)
    return _put(df, name, F.when(usable, F.when(up, 1).when(down, -1)))


def ema_slope(df: DataFrame, ema: str, length: int, look_back: int = 5, name: str = "signal") -> DataFrame:
    out = over_history(df, look_back, lambda d, w: d.withColumn("_then", F.lag(ema, look_back).over(w)))
    usable = c("idx") >= length + look_back + 1
    return _put(out, name, F.when(usable, sh.sign_of(c(ema) - c("_then")))).drop("_then")


def candidate_signals(df: DataFrame, minutes: int = 30) -> tuple[DataFrame, list[str]]:
    """The twelve bar-shape candidates as columns of one frame."""
    out = with_prev_day(with_session_edges(df))
    steps = [
        ("opening_range_break", lambda d, n: opening_range_break(d, minutes, name=n)),
        ("gap_fade", lambda d, n: gap_fade(d, name=n)),
        ("prev_day_sweep_reclaim", lambda d, n: prev_day_sweep_reclaim(d, name=n)),
        ("prev_day_break", lambda d, n: prev_day_break(d, name=n)),
        ("momentum_6", lambda d, n: momentum(d, 6, name=n)),
        ("range_expansion", lambda d, n: range_expansion(d, name=n)),
        ("first_bar_continuation", lambda d, n: first_bar_continuation(d, name=n)),
        ("inside_bar_break", lambda d, n: inside_bar_break(d, name=n)),
    ]
    for name, add in steps:
        out = add(out, name)
    opposite = {
        "opening_range_fade": "opening_range_break",
        "gap_continue": "gap_fade",
        "mean_reversion_6": "momentum_6",
        "range_expansion_fade": "range_expansion",
    }
    for name, source in opposite.items():
        out = negate(out, source, name)
    return out, [n for n, _ in steps] + list(opposite)


def ema_candidates(df: DataFrame, pairs=((9, 21), (8, 21), (12, 26), (20, 50)),
                   lengths=(21, 50)) -> tuple[DataFrame, list[str]]:
    """Moving-average candidates; every length is folded once."""
    out = df
    for n in sorted({n for p in pairs for n in p} | set(lengths)):
        out = ind.bounded_ema(out, n, f"_e{n}")
    names = []
    for f, s in pairs:
        out = ema_cross(out, f"_e{f}", f"_e{s}", s, name=f"ema_cross_{f}_{s}")
        out = ema_pullback(out, f"_e{f}", f"_e{s}", s, name=f"ema_pullback_{f}_{s}")
        names += [f"ema_cross_{f}_{s}", f"ema_pullback_{f}_{s}"]
    for n in lengths:
        out = ema_trend(out, f"_e{n}", name=f"ema_trend_{n}")
        out = ema_slope(out, f"_e{n}", n, name=f"ema_slope_{n}")
        names += [f"ema_trend_{n}", f"ema_slope_{n}"]
    return out, names


def stack_signals(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Wide signal columns to (keep..., signal_name, direction), zeros dropped."""
    pairs = F.array(*[F.struct(F.lit(n).alias("signal_name"), c(n).alias("direction")) for n in names])
    fired = F.filter(pairs, lambda p: p.direction != 0)
    return df.select(*keep, F.explode(fired).alias("_s")).select(
        *keep, "_s.signal_name", c("_s.direction").alias("direction"))


def python_signal(df: DataFrame, fn, look_back: int, columns: list[str], name: str = "signal",
                  chunk: int = 4096) -> DataFrame:
    """Run pandas code `fn(frame) -> series of -1/0/+1` over ordered bars.

    The code sees one chunk of bars at a time plus `look_back` bars before it,
    so memory stays bounded whatever the length of a symbol's history.
    """
    home = F.floor(c("idx") / F.lit(chunk)).cast("long")
    parts = F.when(F.pmod(c("idx"), F.lit(chunk)) >= chunk - look_back, F.array(home, home + 1)).otherwise(F.array(home))
    cols = ["symbol", "session", "ts", "idx", *[x for x in columns if x not in ("symbol", "session", "ts", "idx")]]
    rows = df.select(*cols, F.explode(parts).alias("_chunk"))
    schema = T.StructType([*df.select("symbol", "ts", "idx").schema.fields, T.StructField(name, T.IntegerType())])

    def run(frame):
        frame = frame.sort_values("idx").reset_index(drop=True)
        frame[name] = fn(frame).astype("int32")
        own = frame["idx"] // chunk == frame["_chunk"]
        return frame.loc[own, ["symbol", "ts", "idx", name]]

    return rows.groupBy("symbol", "_chunk").applyInPandas(run, schema)
