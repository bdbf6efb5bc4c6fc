"""Monthly price panels: formation ranks, portfolios and random portfolios.

Input is a long table (symbol, month 'yyyy-MM', close). Month numbers are
dense over the months any symbol holds, and offsets are value-based frames, so
a missing month never shifts a neighbour into its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.functions import stats as st
from tapewright.operators.nulls import hash_int
from tapewright.session import cut_lineage

c = F.col
FORMATIONS = ((6, 1), (12, 1), (12, 2))
HELD = 10
SPREAD = 64  # buckets for numbering eligible names inside a month


def month_ends(dates: DataFrame, date: str = "day") -> DataFrame:
    """Last held date of every calendar month."""
    month = F.substring(c(date).cast("string"), 1, 7)
    return dates.groupBy(month.alias("month")).agg(F.max(date).alias("month_end"))


def with_month_no(panel: DataFrame) -> DataFrame:
    """Add a dense month number; the month list is bounded by the calendar."""
    months = panel.select("month").distinct().agg(F.sort_array(F.collect_set("month")).alias("m"))
    numbered = months.select(F.posexplode("m").alias("month_no", "month"))
    return panel.join(F.broadcast(numbered), "month")


def price_at(offset: int) -> Column:
    """Price exactly `offset` months away, NULL when that month is missing."""
    w = Window.partitionBy("symbol").orderBy("month_no").rangeBetween(offset, offset)
    return F.max("close").over(w)


def monthly_returns(panel: DataFrame) -> DataFrame:
    """Simple return from each month to the next held month."""
    df = with_month_no(panel).withColumn("_next", price_at(1))
    return df.withColumn("fwd", sh.simple_return(c("close"), c("_next"))).drop("_next")


def formation(panel: DataFrame, formations=FORMATIONS) -> DataFrame:
    """Formation return, forward price and return, one row per (label, name, month).

    Every formation reads the same windows, so the panel is sorted once.
    """
    offsets = sorted({-x for pair in formations for x in pair} | {1})
    df = with_month_no(panel)
    df = df.withColumns({f"_p{o}": price_at(o) for o in offsets})
    rows = F.array(*[
        F.struct(F.lit(f"{form}-{skip}").alias("label"), F.lit(form).alias("form"),
                 sh.simple_return(c(f"_p{-form}"), c(f"_p{-skip}")).alias("form_ret"))
        for form, skip in formations])
    out = df.select("symbol", "month", "month_no", "close", c("_p1").alias("next_close"),
                    sh.simple_return(c("close"), c("_p1")).alias("fwd"), F.inline(rows))
    return out.filter((c("month_no") >= c("form")) & c("form_ret").isNotNull()).drop("form")


def top_names(ranked: DataFrame, held: int) -> DataFrame:
    """Best names of each month; the name breaks ties, later names first.

    row_number() <= k is a group limit, so only k rows per task and month
    reach the shuffle.
    """
    w = Window.partitionBy("label", "month").orderBy(c("form_ret").desc(), c("symbol").desc())
    return ranked.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= held)


def momentum_rank(panel: DataFrame, form: int = 12, skip: int = 2, held: int = HELD) -> DataFrame:
    """Production ranking: needs a price now, not next month."""
    return top_names(formation(panel, ((form, skip),)), held)


def _bucket() -> Column:
    return F.pmod(hash_int(c("symbol")), F.lit(SPREAD))


def _sizes(rows: DataFrame) -> DataFrame:
    return cut_lineage(rows.groupBy("label", "month", _bucket().alias("_b")).agg(F.count(F.lit(1)).alias("_n")))


def eligible_sizes(panel: DataFrame, formations=FORMATIONS, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(eligible rows, names per (label, month, bucket) of the months with enough names).

    The sizes are a few rows a month. They are counted once and kept, so that
    the rows need no shuffle to learn n_eligible, and a draw no look at them.
    """
    rows = formation(panel, formations).filter(c("next_close").isNotNull())
    sizes = _sizes(rows)
    counts = sizes.groupBy("label", "month").agg(F.sum("_n").alias("n_eligible")).filter(c("n_eligible") >= 3 * held)
    return rows.join(F.broadcast(counts), ["label", "month"]), sizes.join(counts, ["label", "month"])


def eligible(panel: DataFrame, formations=FORMATIONS, held: int = HELD) -> DataFrame:
    """Research eligibility: priced now and next month, in months with enough names."""
    return eligible_sizes(panel, formations, held)[0]


def random_picks(elig: DataFrame, seeds: int, held: int, first_seed: int = 1000, sizes: DataFrame | None = None) -> DataFrame:
    """`held` distinct eligible names per (seed, month), every set equally likely.

    sizes are those of `eligible_sizes`, counted here if not given. Names are numbered inside
    the month in two steps (bucket, then row). The draws pick numbers by hash
    and are turned into buckets and rows before they meet the names, so only
    seeds x months x held rows move.
    """
    if sizes is None:
        sizes = _sizes(elig).withColumn("n_eligible", F.sum("_n").over(Window.partitionBy("label", "month")))
    before = Window.partitionBy("label", "month").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("label", "month", "_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    draws = _draw(sizes, seeds, held, first_seed).join(starts, ["label", "month"]).filter(
        (c("pick") >= c("_start")) & (c("pick") < c("_start") + c("_n")))
    draws = draws.select("label", "seed", "month", "pick", "_b", (c("pick") - c("_start") + 1).alias("_r"))
    inside = Window.partitionBy("label", "month", "_b").orderBy("symbol")
    numbered = elig.withColumn("_b", _bucket()).select("label", "month", "_b", "symbol", "fwd", F.row_number().over(inside).cast("long").alias("_r"))
    return numbered.join(F.broadcast(draws), ["label", "month", "_b", "_r"]).select("label", "month", "pick", "seed", "symbol", "fwd")


def _draw(sizes: DataFrame, seeds: int, held: int, first_seed: int) -> DataFrame:
    """Rows (label, seed, month, pick): a uniform sample of numbers below n_eligible.

    Slot j of the last `held` draws from 0..j and takes j itself when the
    number is already taken.
    """
    months = sizes.select("label", "month", "n_eligible").distinct()
    runs = months.withColumn("seed", F.explode(F.sequence(F.lit(first_seed), F.lit(first_seed + seeds - 1))))
    slot = lambda j: F.pmod(hash_int(F.concat_ws("|", c("seed").cast("string"), c("month"), j.cast("string"))), j + 1)
    empty = F.array().cast("array<bigint>")
    picks = F.aggregate(
        F.sequence(c("n_eligible") - held, c("n_eligible") - 1), empty,
        lambda acc, j: F.concat(acc, F.array(F.when(F.array_contains(acc, slot(j)), j).otherwise(slot(j)))))
    return runs.select("label", "seed", "month", F.explode(picks).alias("pick"))


def turnover_share(picks: DataFrame, by: list[str]) -> DataFrame:
    """Share of names new against the previous HELD month (all, at first)."""
    months = picks.select(*by, "month").distinct()
    w = Window.partitionBy(*by).orderBy("month")
    seq = months.withColumn("_seq", F.row_number().over(w))
    placed = picks.join(seq, [*by, "month"]).select(*by, "month", "symbol", "_seq")
    before = placed.select(*by, "symbol", (c("_seq") + 1).alias("_seq"), F.lit(True).alias("_kept"))
    marked = placed.join(before, [*by, "symbol", "_seq"], "left")
    return marked.groupBy(*by, "month").agg(
        (F.count_if(c("_kept").isNull()) / F.count(F.lit(1))).alias("changed"))


def turnover_cost(changed: Column, cost_bp: float) -> Column:
    return 2.0 * changed * (cost_bp / 1e4)


def portfolio_returns(picks: DataFrame, by: list[str], cost_bp: float = 5.0) -> DataFrame:
    """Equal-weight forward return per month, minus turnover cost."""
    gross = picks.groupBy(*by, "month").agg(F.avg("fwd").alias("gross")).filter(c("gross").isNotNull())
    out = gross.join(turnover_share(picks, by), [*by, "month"])
    return out.select(*by, "month", (c("gross") - turnover_cost(c("changed"), cost_bp)).alias("ret"))


def strategy_returns(elig: DataFrame, held: int = HELD, cost_bp: float = 5.0) -> DataFrame:
    """Monthly series of the best eligible names; the picks, `held` rows a month, are found once."""
    picks = cut_lineage(top_names(elig, held).select("label", "month", "symbol", "fwd"))
    return portfolio_returns(picks, ["label"], cost_bp)


def random_returns(elig: DataFrame, sizes: DataFrame, held: int = HELD, seeds: int = 200, cost_bp: float = 5.0) -> DataFrame:
    """Monthly series of random eligible names; the picks, seeds x `held` rows a month, are found once."""
    return portfolio_returns(cut_lineage(random_picks(elig, seeds, held, sizes=sizes)), ["label", "seed"], cost_bp)


def momentum_portfolio(panel: DataFrame, formations=FORMATIONS, held: int = HELD, cost_bp: float = 5.0) -> DataFrame:
    """Research-path monthly series per formation: label, month, ret."""
    return strategy_returns(eligible(panel, formations, held), held, cost_bp)


def random_portfolio(panel: DataFrame, formations=FORMATIONS, held: int = HELD, seeds: int = 200,
                     cost_bp: float = 5.0) -> DataFrame:
    """Random portfolios from the same eligible names: label, seed, month, ret."""
    return random_returns(*eligible_sizes(panel, formations, held), held, seeds, cost_bp)


def paired_null(strategy: DataFrame, null: DataFrame) -> DataFrame:
    """Strategy minus the month's mean over draws."""
    mean = null.groupBy("label", "month").agg(F.avg("ret").alias("null_ret"))
    return strategy.join(mean, ["label", "month"]).select(
        "label", "month", "ret", "null_ret", (c("ret") - c("null_ret")).alias("diff"))


def benchmark_returns(panel: DataFrame, index: DataFrame, warmup: int = 12) -> DataFrame:
    """Equal-weight universe and index return per month, index gaps as zero.

    index: month, level.
    """
    rows = monthly_returns(panel).filter((c("month_no") >= warmup) & c("fwd").isNotNull())
    universe = rows.groupBy("month", "month_no").agg(F.avg("fwd").alias("universe_ret"))
    months = with_month_no(panel).select("month", "month_no").distinct()
    placed = months.join(index, "month", "left")
    nxt = placed.select((c("month_no") - 1).alias("month_no"), c("level").alias("_next"))
    idx = placed.join(nxt, "month_no").select("month_no", sh.simple_return(c("level"), c("_next")).alias("_r"))
    return universe.join(idx, "month_no", "left").select(
        "month", "universe_ret", c("_r").alias("index_ret"), F.coalesce("_r", F.lit(0.0)).alias("paired_index_ret"))


def series_summary(series: DataFrame, by: list[str], value: str = "ret") -> DataFrame:
    return series.groupBy(*by).agg(
        F.count(value).alias("months"), st.annualise(c(value)).alias("ann_pct"), st.sharpe(c(value)).alias("sharpe"))


def split_halves(series: DataFrame, by: list[str], order: str, share: float = 0.5) -> DataFrame:
    """Add half = 1 for the first floor(share*n) rows of a series, else 2."""
    w = Window.partitionBy(*by)
    ranked = series.withColumns({"_rn": F.row_number().over(w.orderBy(order)), "_n": F.count(F.lit(1)).over(w)})
    cut = F.floor(c("_n") * F.lit(share))
    return ranked.withColumn("half", F.when(c("_rn") <= cut, 1).otherwise(2)).drop("_rn", "_n")


def split_half(series: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Mean and t of both halves and whether their signs agree."""
    halves = split_halves(series, by, order)
    a, b = F.when(c("half") == 1, c(value)), F.when(c("half") == 2, c(value))
    out = halves.groupBy(*by).agg(
        F.avg(a).alias("first_mean"), st.t_stat(a).alias("first_t"), F.avg(b).alias("second_mean"), st.t_stat(b).alias("second_t"),
        F.min(F.when(c("half") == 2, c(order))).alias("boundary"))
    return out.withColumn("same_sign", (c("first_mean") > 0) == (c("second_mean") > 0))


def drop_best_count(n: Column, frac: float = 0.01) -> Column:
    """max(1, round(frac*n)), halves to even."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(frac), 0).cast("long"))


def drop_best(df: DataFrame, by: list[str], value: str, tie: str, frac: float = 0.01) -> DataFrame:
    """Remove the best rows of each group, by the rounding rule."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"_rn": F.row_number().over(w.orderBy(c(value).desc(), c(tie).desc())),
                             "_n": F.count(F.lit(1)).over(w)})
    return ranked.filter(c("_rn") > drop_best_count(c("_n"), frac)).drop("_rn", "_n")


def drop_best_floor(df: DataFrame, by: list[str], value: str, tie: str, worst: bool = False) -> DataFrame:
    """Remove the best (or worst) max(1, n // 100) rows of each group."""
    w = Window.partitionBy(*by)
    order = [c(value), c(tie)] if worst else [c(value).desc(), c(tie).desc()]
    ranked = df.withColumns({"_rn": F.row_number().over(w.orderBy(*order)), "_n": F.count(F.lit(1)).over(w)})
    k = F.greatest(F.lit(1), F.floor(c("_n") / 100))
    return ranked.filter(c("_rn") > k).drop("_rn", "_n")


def concentration(df: DataFrame, by: list[str], value: str, tie: str, frac: float = 0.01) -> DataFrame:
    """t before and after removing the best rows, and whether its sign flips."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"_rn": F.row_number().over(w.orderBy(c(value).desc(), c(tie).desc())),
                             "_n": F.count(F.lit(1)).over(w)})
    rest = F.when(c("_rn") > drop_best_count(c("_n"), frac), c(value))
    out = ranked.groupBy(*by).agg(F.count(value).alias("n"), st.t_stat(c(value)).alias("t_all"), st.t_stat(rest).alias("t_cut"))
    flips = F.coalesce((c("t_all") > 0) != (c("t_cut") > 0), F.lit(True))
    return out.withColumn("flips", flips)


def validation_record(pairs: DataFrame, by: str = "label") -> DataFrame:
    """One row of evidence per candidate from its paired differences."""
    w = Window.partitionBy(by)
    ranked = pairs.withColumns({
        "_rn": F.row_number().over(w.orderBy("month")),
        "_best": F.row_number().over(w.orderBy(c("diff").desc(), c("month").desc())),
        "_n": F.count(F.lit(1)).over(w),
    })
    hold = F.when(c("_rn") > F.floor(c("_n") * F.lit(0.7)), c("diff"))
    rest = F.when(c("_best") > drop_best_count(c("_n")), c("diff"))
    survives = sh.truthy((st.t_stat(c("diff")) > 0) & (st.t_stat(rest) > 0))
    return ranked.groupBy(c(by).alias("signal")).agg(
        F.count("diff").alias("n_trades"), F.avg("diff").alias("mean_r"), st.t_stat(c("diff")).alias("t_vs_null"),
        st.t_stat(hold).alias("holdout_t"), survives.alias("survives_concentration"),
        F.concat_ws("..", F.min("month"), F.max("month")).alias("tested_on"))


def monthly_replication(own: DataFrame, published: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Own months against a published table: mean difference and correlation."""
    joined = own.join(published.select("month", c("ret_pct").alias("_p")), "month")
    return joined.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("months"), F.avg("ret_pct").alias("own_mean"), F.avg("_p").alias("published_mean"),
        F.avg(c("ret_pct") - c("_p")).alias("mean_diff"), F.corr("ret_pct", "_p").alias("correlation"))
