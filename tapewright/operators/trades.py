"""Reports on trade lists, rejection logs and monthly security records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.medians import exact_medians
from tapewright.functions import stats as st

c = F.col


def era_buckets(trades: DataFrame, width: int = 5) -> DataFrame:
    """Multi-year buckets that start at the first trade's year."""
    year = F.year("entry_time")
    first = trades.agg(F.min(year).alias("_y0"))
    rows = trades.join(F.broadcast(first)).withColumn("era", c("_y0") + F.floor((year - c("_y0")) / width) * width)
    return rows.groupBy(c("era").cast("long").alias("era")).agg(
        F.count(F.lit(1)).alias("n"), st.win_share(c("pnl")).alias("win"), F.sum("pnl").alias("total"))


def trade_breakdowns(trades: DataFrame, stop_reasons: list[str]) -> DataFrame:
    """Totals overall, per exit reason and per side in one pass.

    The overall row also carries t without the worst trade and the median
    risk of stopped-out losers.
    """
    stopped = c("exit_reason").isin(*stop_reasons) & (c("pnl") < 0)
    risk = F.when(stopped, F.abs(c("pnl") + c("commission")) / 100.0)
    rows = trades.withColumns({"_risk": risk, "_risk_pct": 100.0 * risk / c("entry_price")})
    n, s1, s2 = F.count("pnl"), F.sum("pnl"), F.sum(c("pnl") * c("pnl"))
    low = F.min("pnl")
    m = n - 1
    mean_rest = (s1 - low) / m
    var_rest = (s2 - low * low - m * mean_rest * mean_rest) / (m - 1)
    grouped = rows.groupingSets([[c("exit_reason")], [c("side")], []], "exit_reason", "side").agg(
        n.alias("n"), s1.alias("total"), F.avg("pnl").alias("mean"), st.std_error(c("pnl")).alias("se"), st.t_stat(c("pnl")).alias("t"),
        F.when(n > 2, mean_rest / F.sqrt(var_rest / m)).alias("t_without_worst"))
    none = F.lit(None).cast("string")
    sets = F.array(*[F.struct(a.alias("m_reason"), b.alias("m_side")) for a, b in ((c("exit_reason"), none), (none, c("side")), (none, none))])
    middle = exact_medians(rows.filter(c("_risk").isNotNull()).select("_risk", "_risk_pct", F.inline(sets)), ["m_reason", "m_side"], ["_risk", "_risk_pct"])
    return grouped.join(middle, c("exit_reason").eqNullSafe(c("m_reason")) & c("side").eqNullSafe(c("m_side")), "left").drop("m_reason", "m_side").withColumnsRenamed(
        {"_risk": "median_risk", "_risk_pct": "median_risk_pct"})


def funnel_counts(blocks: DataFrame, by: list[str]) -> DataFrame:
    """How many blocks reached each stage."""
    return blocks.groupBy(*by).agg(*[F.count(n).alias(n) for n in ("formed", "confirmed", "left", "armed", "triggered")])


def top_rejections(events: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    counts = events.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(c("n").desc(), c("reason"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= k)


def direction_year_split(trades: DataFrame, value: str = "r") -> DataFrame:
    """Per build, one pass: rows by year and rows by direction."""
    return trades.groupingSets([[c("build"), c("year")], [c("build"), c("direction")]], "build", "year", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def shared_signal_bars(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Size of pairwise overlaps of signal bars between builds.

    Builds are few by construction: each bar's builds become one sorted array
    and pairs are formed inside it.
    """
    per_bar = signals.select("build", *keys).distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("build")).alias("b"))
    pairs = F.flatten(F.transform("b", lambda x, i: F.transform(
        F.slice("b", i + 2, F.size("b")), lambda y: F.struct(x.alias("build_a"), y.alias("build_b")))))
    return per_bar.select(F.inline(pairs)).groupBy("build_a", "build_b").agg(F.count(F.lit(1)).alias("shared"))


def security_master_join(monthly: DataFrame, names: DataFrame, delistings: DataFrame, shrcd=(10, 11), exchcd=(1, 2, 3)) -> DataFrame:
    """Monthly rows with the name record valid then and a same-month delisting.

    A name record stays valid to the end of its last month.
    """
    valid = names.filter(c("shrcd").isin(*shrcd) & c("exchcd").isin(*exchcd))
    b = valid.select(c("permno").alias("_p"), "namedt", "nameendt", "shrcd", "exchcd", "ticker")
    on = (c("permno") == c("_p")) & (c("namedt") <= c("date")) & (c("date") <= F.last_day("nameendt"))
    d = delistings.select("permno", F.trunc("dlstdt", "month").alias("_m"), "dlret", "dlstcd")
    joined = monthly.join(b, on).drop("_p").withColumn("_m", F.trunc("date", "month"))
    return joined.join(d, ["permno", "_m"], "left").drop("_m")


def delisting_adjusted_return(rows: DataFrame) -> DataFrame:
    """Compound both returns, else whichever is known; size from |price|."""
    both = (1.0 + c("ret")) * (1.0 + c("dlret")) - 1.0
    return rows.withColumns({"ret_adj": F.coalesce(both, c("dlret"), c("ret")), "mktcap": F.abs("prc") * c("shrout")})
