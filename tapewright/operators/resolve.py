"""From entries to outcomes: which level does price touch first?

Every session's bars are folded once into a path array (at most one element
per bar of a day) with the extremes of its blocks, and a session's entries into
another. Entries are resolved inside the session's row: a search looks at the
rest of its own block, then for the first block that reaches the level, then
into that one. No pair of entry and later bar is ever a row, and no path is
copied to an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import stats as st

c = F.col
COST_ATR = 0.02


#: Bars in a block of a path.
BLOCK = 16


def session_paths(bars: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, session, path, blocks): the session's bars in order, and the extremes of every BLOCK of them."""
    row = F.struct("ts", "high", "low", "close", *extra)
    paths = bars.groupBy("symbol", "session").agg(F.sort_array(F.collect_list(row)).alias("path"))
    part = lambda i: F.slice("path", i * BLOCK + 1, F.lit(BLOCK))
    return paths.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.floor((F.size("path") - 1) / BLOCK).cast("int")), lambda i: F.struct(
        F.array_max(F.transform(part(i), lambda b: b["high"])).alias("high"), F.array_min(F.transform(part(i), lambda b: b["low"])).alias("low"))))


def _reach(start: Column, end: Column, level: Column, up: bool) -> Column:
    """1-based distance from `start` of the first bar before `end` whose high (or low) reaches the level, 0 when none does."""
    hit = (lambda b: b["high"] >= level) if up else (lambda b: b["low"] <= level)
    first = lambda array, lo, n: F.array_position(F.transform(F.slice(array, lo + 1, F.greatest(n, F.lit(0))), hit), True).cast("int")
    own = F.floor(start / BLOCK).cast("int")
    head = first("path", start, F.least(end, (own + 1) * BLOCK) - start)
    # The number of blocks on, and then the bar in that block.
    ahead = first("blocks", own + 1, F.size("blocks") - own - 1)
    there = (own + ahead) * BLOCK
    tail = first("path", there, F.least(end, there + BLOCK) - there)
    return F.when(head > 0, head).when((ahead > 0) & (there < end), F.when(tail > 0, there + tail - start).otherwise(0)).otherwise(0)


def resolved(e: Column, names: list[str], hold: int | None = None) -> Column:
    """An entry (struct with day_pos, direction, stop, target and more) on the path and blocks of its row.

    Its fields `names`, then the distances _stop_at and _target_at (0: never),
    the bars seen _n and the close of the last of them, _last.
    """
    start = e["day_pos"].cast("int")
    end = F.least(start + hold, F.size("path")) if hold is not None else F.size("path")
    long = e["direction"] > 0
    # A long is stopped by a fall and won by a rise, a short the other way round.
    down = _reach(start, end, F.when(long, e["stop"]).otherwise(e["target"]), False)
    up = _reach(start, end, F.when(long, e["target"]).otherwise(e["stop"]), True)
    return F.struct(*[e[n].alias(n) for n in names], F.when(long, down).otherwise(up).alias("_stop_at"), F.when(long, up).otherwise(down).alias("_target_at"),
                    (end - start).alias("_n"), F.get("path", end - 1)["close"].alias("_last"))


def first_touch(entries: DataFrame, paths: DataFrame, hold: int | None = None) -> DataFrame:
    """Add outcome, exit_price and bars_held to entries.

    entries: symbol, session, day_pos, direction, entry, stop, target. A bar
    that reaches both levels counts as the stop. Entries without a later bar
    in their session are dropped.
    """
    names = [n for n in entries.columns if n not in ("symbol", "session")]
    per_day = entries.groupBy("symbol", "session").agg(F.collect_list(F.struct(*names)).alias("_e"))
    hit = per_day.join(paths.select("symbol", "session", "path", "blocks"), ["symbol", "session"]).select(
        "symbol", "session", F.inline(F.transform("_e", lambda e: resolved(e, names, hold)))).filter("_n > 0")
    stopped = (c("_stop_at") > 0) & ((c("_target_at") == 0) | (c("_stop_at") <= c("_target_at")))
    won = ~stopped & (c("_target_at") > 0)
    return hit.withColumns({
        "outcome": F.when(stopped, "stop").when(won, "target").otherwise("time"),
        "exit_price": F.when(stopped, c("stop")).when(won, c("target")).otherwise(c("_last")),
        "bars_held": F.when(stopped, c("_stop_at")).when(won, c("_target_at")).otherwise(c("_n")).cast("long"),
    }).drop("_stop_at", "_target_at", "_n", "_last")


def move_in_r() -> Column:
    risk = F.abs(c("entry") - c("stop"))
    return F.when(risk > 0, (c("exit_price") - c("entry")) * c("direction") / risk).otherwise(0.0)


def resolve_entry(entries: DataFrame, paths: DataFrame, hold: int = 60, cost_atr: float = COST_ATR) -> DataFrame:
    """Signal bars with stop/target in ATRs to trades net of cost.

    entries: symbol, session, day_pos, direction, entry, atr, stop_atr, target_atr.
    """
    usable = entries.filter((c("direction") != 0) & (c("atr") > 0) & (c("stop_atr") > 0))
    levels = usable.withColumns({
        "stop": c("entry") - c("direction") * c("stop_atr") * c("atr"),
        "target": c("entry") + c("direction") * c("target_atr") * c("atr"),
    })
    out = first_touch(levels, paths, hold)
    cost = F.lit(cost_atr) / c("stop_atr")
    gross = (F.when(c("outcome") == "stop", -1.0).when(c("outcome") == "target", c("target_atr") / c("stop_atr"))
             .otherwise((c("exit_price") - c("entry")) * c("direction") / (c("stop_atr") * c("atr"))))
    return out.withColumn("r", gross - cost)


def resolve_signal(signals: DataFrame, paths: DataFrame) -> DataFrame:
    """Signals with their own stop, target and target_r; no hold cap, no cost."""
    usable = signals.filter((F.abs(c("entry") - c("stop")) > 0) & c("target").isNotNull())
    out = first_touch(usable, paths)
    r = F.when(c("outcome") == "stop", -1.0).when(c("outcome") == "target", c("target_r")).otherwise(move_in_r())
    return out.withColumn("r", r)


def resolve_at_r(signals: DataFrame, paths: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """Each signal once per R multiple of its own risk."""
    grown = signals.drop("target", "target_r").withColumn("target_r", F.explode(F.array(*[F.lit(g) for g in grid])))
    risk = F.abs(c("entry") - c("stop"))
    grown = grown.withColumn("target", c("entry") + c("direction") * c("target_r") * risk)
    return resolve_signal(grown, paths)


def exit_sweep(resolved: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per target multiple: wins, mean, error, total and exits by kind."""
    return resolved.groupBy(*(by or []), "target_r").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(c("outcome") == "target").alias("wins"),
        F.avg("r").alias("mean_r"),
        st.std_error(c("r")).alias("se"),
        F.sum("r").alias("total_r"),
        F.count_if(c("outcome") == "stop").alias("stops"),
        F.count_if(c("outcome") == "time").alias("times"),
    )


def first_n_per_session(trades: DataFrame, by: list[str], n: int = 1) -> DataFrame:
    """First resolved trades of each session; unresolved entries use nothing up."""
    w = Window.partitionBy("symbol", "session", *by).orderBy("day_pos")
    return trades.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") <= n).drop("_rn")


def group_outcomes(trades: DataFrame, by: list[str]) -> DataFrame:
    return trades.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("n"))


def outcome_summary(trades: DataFrame, by: list[str]) -> DataFrame:
    """Hit rate counts targets over resolved trades, not positive results."""
    out = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("resolved"),
        F.count_if(c("outcome") == "target").alias("targets"),
        F.count_if(c("outcome") == "stop").alias("stops"),
        F.count_if(c("outcome") == "time").alias("times"),
        F.sum("r").alias("total_r"),
        F.avg("r").alias("mean_r"),
        st.std_error(c("r")).alias("se"),
    )
    return out.withColumn("hit_rate", c("targets") / c("resolved"))


def backtest_trades(signals: DataFrame, paths: DataFrame, cost_atr: float = COST_ATR) -> DataFrame:
    """Resolved signals with cost in R, stop in ATR and the net result.

    signals carry the ATR at entry.
    """
    out = resolve_signal(signals, paths)
    risk = F.abs(c("entry") - c("stop"))
    cost = F.when(c("atr").isNotNull(), cost_atr * c("atr") / risk).otherwise(0.0)
    return out.withColumns({"r_net": c("r") - cost, "stop_atr": F.when(c("atr") > 0, risk / c("atr"))})
