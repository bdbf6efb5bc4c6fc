"""First bar after a start that crosses a level, and extremes between two bars.

Sessions carry the extremes of their bars, buckets of sessions those of their
sessions. A search looks at the rest of its own session, then at the later
sessions of its bucket, then for the first later bucket, and opens only the
bucket and the session found. Every join has one row per (symbol, session) or
(symbol, bucket) on one side, so nothing multiplies; the list of a symbol's
buckets is the only thing kept per symbol, a few rows a year.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
BUCKET = 64
#: Levels of a search row: the bar value each is held against, and how.
LEVELS = {
    "close_under": ("close_min", "<"), "close_over": ("close_max", ">"), "low_to": ("low", "<="), "high_to": ("high", ">="),
    "low_under": ("low", "<"), "high_over": ("high", ">"), "wholly_over": ("low_max", ">"), "wholly_under": ("high_min", "<"),
    "far_over": ("above", ">"), "far_under": ("below", "<"), "mark_up": ("up", ">="), "mark_down": ("down", ">=")}
#: Values by whether a session keeps their least or their greatest.
LEAST, GREATEST = ("close_min", "low", "high_min", "below"), ("close_max", "high", "low_max", "above", "up", "down")
VALUES = LEAST + GREATEST


def _meets(v: Column, levels: tuple[str, ...]) -> Column:
    """Does a bar, session or bucket with these extremes cross one of the row's levels? A NULL level is never crossed."""
    tests = []
    for level in levels:
        value, op = LEVELS[level]
        x, t = v[value], c(f"_{level}")
        tests.append(F.coalesce({"<": x < t, ">": x > t, "<=": x <= t, ">=": x >= t}[op], F.lit(False)))
    return reduce(lambda a, b: a | b, tests)


def _extremes() -> list[Column]:
    return [(F.min if n in LEAST else F.max)(n).alias(n) for n in VALUES]


def _pick(array: str, keep) -> Column:
    """First element of a sorted array that satisfies keep."""
    return F.get(F.filter(c(array), keep), F.lit(0))


def search_index(bars: DataFrame, far: float = 0.0, up: Column | None = None, down: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars with a known ATR by session, sessions by bucket, buckets by symbol; what `first_hit` looks in.

    far: distance in ATR of far_over and far_under, held against the close
    less or more that distance. up, down: 0/1 columns for the two marks.
    """
    flag = lambda x: (x if x is not None else F.lit(0)).cast("int")
    reach = c("atr") * far
    known = bars.filter(c("atr").isNotNull()).select(
        "symbol", "session_no", "idx", c("close").alias("close_min"), c("close").alias("close_max"), "low", c("low").alias("low_max"), "high",
        c("high").alias("high_min"), (c("close") - reach).alias("above"), (c("close") + reach).alias("below"), flag(up).alias("up"), flag(down).alias("down"))
    days = known.groupBy(c("symbol").alias("_ds"), c("session_no").alias("_dn")).agg(
        F.array_sort(F.collect_list(F.struct("idx", *VALUES))).alias("_bars"))
    sums = known.groupBy("symbol", "session_no").agg(*_extremes())
    buckets = sums.groupBy(c("symbol").alias("_bs"), F.floor(c("session_no") / BUCKET).alias("_bn")).agg(
        F.array_sort(F.collect_list(F.struct("session_no", *VALUES))).alias("_days"), *_extremes())
    history = buckets.groupBy(c("_bs").alias("_hs")).agg(F.array_sort(F.collect_list(F.struct("_bn", *VALUES))).alias("_buckets"))
    return days, buckets.select("_bs", "_bn", "_days"), history


def first_hit(rows: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], levels: dict[str, Column], start: str, start_session: str,
              name: str = "hit_idx") -> DataFrame:
    """Add `name` and `name`_session: the first bar at or after `start` that crosses one of the levels.

    rows: symbol, `start` (bar index) and `start_session`. levels: names of
    LEVELS to columns of rows. Rows with a NULL start find nothing.
    """
    days, buckets, history = index
    named = {f"_{n}": level for n, level in levels.items()}
    meets = lambda v: _meets(v, tuple(levels))
    out = rows.withColumns(named | {"_own": F.floor(c(start_session) / BUCKET)})

    def opened(df: DataFrame, session: str) -> DataFrame:
        return df.join(days, (c("symbol") == c("_ds")) & (c(session) == c("_dn")), "left").drop("_ds", "_dn")

    def of_bucket(df: DataFrame, bucket: str) -> DataFrame:
        return df.join(buckets, (c("symbol") == c("_bs")) & (c(bucket) == c("_bn")), "left").drop("_bs", "_bn")

    out = opened(out, start_session).withColumn("_now", _pick("_bars", lambda v: (v["idx"] >= c(start)) & meets(v))["idx"]).drop("_bars")
    out = of_bucket(out, "_own").withColumn("_near", _pick("_days", lambda v: (v["session_no"] > c(start_session)) & meets(v))["session_no"]).drop("_days")
    out = out.join(history, c("symbol") == c("_hs"), "left").withColumn("_later", F.when(
        c("_now").isNull() & c("_near").isNull(), _pick("_buckets", lambda v: (v["_bn"] > c("_own")) & meets(v))["_bn"])).drop("_hs", "_buckets")
    out = of_bucket(out, "_later").withColumn("_then", F.when(c("_now").isNull(), F.coalesce("_near", _pick("_days", meets)["session_no"]))).drop("_days")
    out = opened(out, "_then").withColumns({
        name: F.coalesce("_now", _pick("_bars", meets)["idx"]),
        f"{name}_session": F.when(c("_now").isNotNull(), c(start_session)).otherwise(c("_then"))})
    return out.drop("_bars", "_own", "_now", "_near", "_later", "_then", *named)


def range_extremes(rows: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], start: str, start_session: str, end: str, end_session: str) -> DataFrame:
    """Add high_between and low_between: extremes of the bars from `start` to `end`, both included.

    Bars of the first and last session, sessions of their buckets, buckets in
    between. Rows with a NULL end have NULL extremes.
    """
    days, buckets, history = index
    out = rows.withColumns({"_b0": F.floor(c(start_session) / BUCKET), "_b1": F.floor(c(end_session) / BUCKET)})

    def of_session(df: DataFrame, session: str, name: str) -> DataFrame:
        return df.join(days.select("_ds", "_dn", c("_bars").alias(name)), (c("symbol") == c("_ds")) & (c(session) == c("_dn")), "left").drop("_ds", "_dn")

    def of_bucket(df: DataFrame, bucket: str, name: str) -> DataFrame:
        return df.join(buckets.select("_bs", "_bn", c("_days").alias(name)), (c("symbol") == c("_bs")) & (c(bucket) == c("_bn")), "left").drop("_bs", "_bn")

    found = []

    def keep(array: str, inside) -> None:
        some = F.filter(array, inside)
        found.append((F.array_max(F.transform(some, lambda v: v["high"])), F.array_min(F.transform(some, lambda v: v["low"]))))

    steps = (("_first", of_session, start_session, lambda v: (v["idx"] >= c(start)) & (v["idx"] <= c(end))),
             ("_final", of_session, end_session, lambda v: (v["idx"] >= c(start)) & (v["idx"] <= c(end))),
             ("_near", of_bucket, "_b0", lambda v: (v["session_no"] > c(start_session)) & (v["session_no"] < c(end_session))),
             ("_far", of_bucket, "_b1", lambda v: (v["session_no"] > c(start_session)) & (v["session_no"] < c(end_session))))
    for k, (array, add, at, inside) in enumerate(steps):
        keep(array, inside)
        out = add(out, at, array).withColumns({f"_h{k}": found[-1][0], f"_l{k}": found[-1][1]}).drop(array)
    keep("_buckets", lambda v: (v["_bn"] > c("_b0")) & (v["_bn"] < c("_b1")))
    out = out.join(history, c("symbol") == c("_hs"), "left").withColumns({"_h4": found[-1][0], "_l4": found[-1][1]}).drop("_hs", "_buckets")
    out = out.withColumns({"high_between": F.greatest(*[c(f"_h{k}") for k in range(5)]), "low_between": F.least(*[c(f"_l{k}") for k in range(5)])})
    return out.drop("_b0", "_b1", *[f"_{x}{k}" for x in "hl" for k in range(5)])
