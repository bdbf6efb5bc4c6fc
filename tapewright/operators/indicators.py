"""Series indicators on indexed bars (see order.with_index)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.functions import timecols as tc
from tapewright.operators.order import back, over_history, session_so_far, session_w

c = F.col


def true_range(df: DataFrame, name: str = "tr") -> DataFrame:
    """Widest of the bar's range and its two legs from the previous close."""

    def add(part, w):
        prev = F.lag("close").over(w)
        legs = F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev))
        return part.withColumn(name, F.when(prev.isNull(), c("high") - c("low")).otherwise(legs))

    return over_history(df, 1, add)


def exp_sum(df: DataFrame, value: str, decay: float, name: str, key: str = "symbol", pos: str = "idx") -> DataFrame:
    """Add the sum of decay**k times the value k rows back, over all rows before.

    y = a*y' + x composes, so it runs in blocks: inside a block a scaled
    running sum, between blocks a short weighted sum of block ends. Blocks are
    short enough for a**-block to stay harmless, and the carry reaches back
    until its weight is below double precision.
    """
    block = max(8, int(math.log(1e3) / -math.log(decay)))
    reach = max(1, math.ceil(math.log(1e20) / (-math.log(decay) * block)))
    fed = df.withColumns({"_blk": F.floor(c(pos) / F.lit(block)).cast("long"), "_off": F.pmod(c(pos), F.lit(block)).cast("double")})
    w = Window.partitionBy(key, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(c(value) * F.pow(F.lit(decay), -c("_off"))).over(w)
    local = fed.withColumn("_local", scaled * F.pow(F.lit(decay), c("_off")))
    ends = local.groupBy(key, "_blk").agg(F.max_by("_local", pos).alias("_end"))
    step = decay**block
    by_blk = Window.partitionBy(key).orderBy("_blk")
    carry = sum((F.coalesce(F.lag("_end", d + 1).over(by_blk), F.lit(0.0)) * step**d for d in range(reach)), F.lit(0.0))
    out = local.join(ends.select(key, "_blk", carry.alias("_carry")), [key, "_blk"])
    return out.withColumn(name, c("_local") + c("_carry") * F.pow(F.lit(decay), c("_off") + 1.0)).drop("_blk", "_off", "_local", "_carry")


def rma(df: DataFrame, value: str, length: int, name: str, key: str = "symbol", pos: str = "idx") -> DataFrame:
    """Wilder smoothing seeded with the mean of the first `length` values, NULL before them and for shorter series.

    The first rows lie in one bounded window, so the seed needs no join.
    """
    if length <= 0:
        raise ValueError(f"length must be positive: {length}")
    decay = 1.0 - 1.0 / length
    if decay == 0.0:
        return df.withColumn(name, c(value))
    head = Window.partitionBy(key, F.floor(c(pos) / F.lit(length)))
    seed = F.when(F.count(value).over(head) == length, F.avg(value).over(head))
    fed = df.withColumn("_seed", seed).withColumn("_in", F.when(c(pos) < length - 1, 0.0).when(c(pos) == length - 1, c("_seed")).otherwise(c(value) * (1.0 - decay)))
    return exp_sum(fed, "_in", decay, "_sum", key, pos).withColumn(name, F.when(c(pos) >= length - 1, c("_sum"))).drop("_seed", "_in", "_sum")


def atr(df: DataFrame, length: int = 14, name: str = "atr") -> DataFrame:
    return rma(true_range(df, "_tr"), "_tr", length, name).drop("_tr")


def _pivot(df: DataFrame, col: str, left: int, right: int, name: str, high: bool) -> DataFrame:
    def add(part, w):
        at = F.lag(col, right).over(w)
        side = F.max if high else F.min
        before = side(col).over(back(w, left + right, right + 1)) if left else F.lit(None)
        after = side(col).over(back(w, right - 1, 0)) if right else F.lit(None)
        ok = c("idx") >= left + right
        if left:
            ok = ok & ((before < at) if high else (before > at))
        if right:
            ok = ok & ((after <= at) if high else (after >= at))
        return part.withColumn(name, F.when(ok, at))

    return over_history(df, left + right, add)


def pivot_high(df: DataFrame, left: int, right: int, name: str = "pivot_high") -> DataFrame:
    """High of the bar `right` back when it tops its neighbours.

    Left neighbours must be lower, right neighbours may be equal.
    """
    return _pivot(df, "high", left, right, name, True)


def pivot_low(df: DataFrame, left: int, right: int, name: str = "pivot_low") -> DataFrame:
    return _pivot(df, "low", left, right, name, False)


def rolling_extremes(df: DataFrame, length: int) -> DataFrame:
    """Highest high and lowest low of the last `length` bars, this one included."""

    def add(part, w):
        frame = back(w, length - 1)
        return part.withColumns({"highest": F.max("high").over(frame), "lowest": F.min("low").over(frame)})

    return over_history(df, length, add)


def session_vwap(df: DataFrame) -> DataFrame:
    """Volume-weighted hlc3 and its deviation, restarted every session."""
    tp = sh.typical_price()
    pv = F.sum(tp * c("volume")).over(session_so_far())
    v = F.sum("volume").over(session_so_far())
    ppv = F.sum(tp * tp * c("volume")).over(session_so_far())
    out = df.withColumns({"_pv": pv, "_v": v, "_ppv": ppv})
    mean = c("_pv") / c("_v")
    spread = F.greatest(c("_ppv") / c("_v") - mean * mean, F.lit(0.0))
    return out.withColumns({
        "vwap": F.when(c("_v") > 0, mean).otherwise(tp),
        "vwap_sd": F.when(c("_v") > 0, F.sqrt(spread)).otherwise(0.0),
    }).drop("_pv", "_v", "_ppv")


def relative_volume(df: DataFrame, look_back: int = 20, least: int = 3, name: str = "rvol") -> DataFrame:
    """Volume over the mean of the same minute in earlier sessions."""
    w = Window.partitionBy("symbol", "minute").orderBy("ts").rowsBetween(-look_back, -1)
    held = F.count("volume").over(w)
    mean = F.avg("volume").over(w)
    usable = (held >= least) & (mean > 0)
    return df.withColumn(name, F.when(usable, c("volume") / mean).otherwise(1.0))


def key_opens(df: DataFrame, names: tuple[str, ...] = ("ny_open", "macro", "pm")) -> DataFrame:
    """Open of the session's first bar at or after each key minute, as ko_*."""
    unknown = set(names) - set(tc.KEY_OPENS)
    if unknown:
        raise ValueError(f"unknown key opens: {sorted(unknown)}")
    first = lambda m: F.first(F.when(c("minute") >= m, c("open")), ignorenulls=True)
    return df.withColumns({f"ko_{n}": first(tc.KEY_OPENS[n]).over(session_so_far()) for n in names})


def key_open_distance(price: Column, names: tuple[str, ...] = ("ny_open", "macro", "pm")) -> Column:
    gaps = [F.abs(price - c(f"ko_{n}")) for n in names]
    return F.least(*gaps) if len(gaps) > 1 else gaps[0]


def near_key_open(price: Column, tolerance: Column, names: tuple[str, ...] = ("ny_open", "macro", "pm")) -> Column:
    return sh.truthy(key_open_distance(price, names) <= tolerance)


def bounded_ema(df: DataFrame, length: int, name: str, value: str = "close", spread: int = 10) -> DataFrame:
    """EMA over at most spread*length bars, seeded by the mean of the first ones.

    With m bars in reach it is a mean `length` bars long, m - length bars ago,
    that has decayed since, plus the exponential sum of the bars after it: a
    running sum less what left the window.
    """
    span, k = spread * length, 2.0 / (length + 1.0)
    decay, gap = 1.0 - k, spread * length - length

    def add(part, w):
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        part = part.withColumn("_mean", F.avg(value).over(back(w, length - 1)))
        # Until the window is full its mean is the series' first, at row length - 1 of the first chunk.
        full = c("idx") >= span - 1
        first = lambda n: F.max(F.when(c("idx") == length - 1, c(n))).over(whole)
        then = {n: F.when(full, F.lag(n, gap).over(w)).otherwise(first(n)) for n in ("_mean", "_sum")}
        faded = F.pow(F.lit(decay), F.when(full, float(gap)).otherwise(c("idx") - (length - 1)))
        ema = faded * then["_mean"] + k * (c("_sum") - faded * then["_sum"])
        return part.withColumn(name, F.when(c("idx") >= length, ema)).drop("_mean", "_sum")

    return over_history(exp_sum(df, value, decay, "_sum"), span, add)


def session_bar_index(df: DataFrame) -> DataFrame:
    return df.withColumn("day_pos", F.row_number().over(session_w()))


def opening_range(df: DataFrame, minutes: int = 30) -> DataFrame:
    """High/low of the session's first minutes, counted from its first bar."""
    start = F.first("minute").over(session_so_far())
    out = df.withColumn("_open_min", start)
    early = c("minute") < c("_open_min") + minutes
    return out.withColumns({
        "or_high": F.max(F.when(early, c("high"))).over(session_so_far()),
        "or_low": F.min(F.when(early, c("low"))).over(session_so_far()),
        "or_complete": c("minute") >= c("_open_min") + minutes,
    }).drop("_open_min")


def max_drawdown(df: DataFrame, key: str, order: str, equity: str, start: float) -> DataFrame:
    """Worst fall from the running peak, the starting capital included."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max(equity).over(w), F.lit(start))
    falls = df.select(key, (1.0 - c(equity) / peak).alias("fall"))
    return falls.groupBy(key).agg(F.greatest(F.max("fall"), F.lit(0.0)).alias("max_drawdown"))
