"""What is alive at a row: price intervals around it, and levels near it.

A life runs from born_idx (in born_session) up to dead_idx (in dead_session;
NULL: still alive). Whole sessions inside a life are filed under blocks of
sessions, so a long life is a few dozen entries, and a row looks in one block
of each size. Inside a block nothing depends on time any more: entries and rows
are put in one order by price, and running counts tell what is open there. The
first and last session of a life are held against the rows of that session.
No row meets a life that has not a session in common with it, and no pair of a
row and a whole-session life is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Sessions in the blocks under which a life is filed.
SPANS = (1, 16, 256)


def last_sessions(bars: DataFrame) -> DataFrame:
    """Rows symbol, last_no: the last session of each symbol."""
    return bars.groupBy("symbol").agg(F.max("session_no").alias("last_no"))


def _inside(size: int) -> tuple[Column, Column]:
    """First and last block of this size that lies within the sessions _from to _to."""
    return F.ceil(c("_from") / size), F.floor((c("_to") + 1) / size) - 1


def whole_sessions(lives: DataFrame, last: DataFrame) -> DataFrame:
    """The rows of lives once for each block of sessions that lies inside, with size and block."""
    placed = lives.join(last, "symbol").withColumns({"_from": c("born_session") + 1, "_to": F.coalesce(c("dead_session") - 1, c("last_no"))})
    files = []
    for k, size in enumerate(SPANS):
        lo, hi = _inside(size)
        blocks = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        if k + 1 < len(SPANS):
            # Those inside a larger block are filed there.
            times = SPANS[k + 1] // size
            first, final = _inside(SPANS[k + 1])
            blocks = F.filter(blocks, _outside(first, final, times))
        files.append(F.transform(blocks, _filed(size)))
    return placed.filter("_from <= _to").withColumn("_f", F.explode(F.concat(*files))).select(*lives.columns, "_f.*")


def _outside(first: Column, final: Column, times: int):
    return lambda b: (F.floor(b / times) < first) | (F.floor(b / times) > final)


def _filed(size: int):
    return lambda b: F.struct(F.lit(size).alias("size"), b.cast("long").alias("block"))


def end_sessions(lives: DataFrame, fields: list[str]) -> DataFrame:
    """Rows symbol, side, session_no, lives: those that begin or end in the session."""
    ends = F.array_distinct(F.array_compact(F.array("born_session", "dead_session")))
    return lives.select("symbol", "side", F.explode(ends).alias("session_no"), F.struct("born_idx", "dead_idx", *fields).alias("_l")).groupBy(
        "symbol", "side", "session_no").agg(F.collect_list("_l").alias("lives"))


def _alive(x: Column) -> Column:
    return (x["born_idx"] <= c("idx")) & (x["dead_idx"].isNull() | (x["dead_idx"] > c("idx")))


def _placed(rows: DataFrame, key: list[str], events: Column) -> DataFrame:
    """Each row's events once for every block size."""
    sizes = F.array(*[F.struct(F.lit(s).alias("size"), F.floor(c("session_no") / s).cast("long").alias("block")) for s in SPANS])
    return rows.select(*key, "symbol", "side", F.explode(sizes).alias("_b"), events.alias("_e")).select(*dict.fromkeys([*key, "symbol", "side"]), "_b.*", F.inline("_e")).filter("p IS NOT NULL")


def _event(p: Column, order: int, step: int) -> Column:
    return F.struct(p.cast("double").alias("p"), F.lit(order).alias("o"), F.lit(step).alias("d"))


def in_interval(rows: DataFrame, key: list[str], zones: DataFrame, last: DataFrame, price: str) -> DataFrame:
    """Distinct (key, side) of the rows whose price lies in an interval that is alive at their bar.

    rows: key, symbol, side, idx, session_no and the price. zones: symbol,
    side, lo, hi and a life; both edges count. NULL prices lie nowhere.
    """
    names = list(dict.fromkeys([*key, "side"]))
    opened = whole_sessions(zones, last).select("symbol", "side", "size", "block", F.inline(F.array(_event(c("lo"), 0, 1), _event(c("hi"), 2, -1)))).filter("p IS NOT NULL")
    asked = _placed(rows, key, F.array(_event(c(price), 1, 0)))
    by_price = Window.partitionBy("symbol", "side", "size", "block").orderBy("p", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(opened, allowMissingColumns=True).withColumn("_n", F.sum("d").over(by_price))
    whole = both.filter("o = 1 AND _n > 0").select(*names)
    met = rows.join(end_sessions(zones, ["lo", "hi"]), ["symbol", "side", "session_no"])
    ends = met.filter(F.exists("lives", lambda x: _alive(x) & (c(price) >= x["lo"]) & (c(price) <= x["hi"]))).select(*names)
    return whole.unionByName(ends).distinct()


def kinds_near(rows: DataFrame, key: list[str], points: DataFrame, last: DataFrame, low: str, high: str, kinds: list[int]) -> DataFrame:
    """Rows key, kinds: the distinct kinds of the levels between `low` and `high` that are alive at the row's bar; rows near none are left out.

    rows: key, symbol, side, idx, session_no and both bounds, which count.
    points: symbol, side, kind (one of `kinds`), level and a life.
    """
    opened = whole_sessions(points, last).select("symbol", "side", "size", "block", "kind", F.inline(F.array(_event(c("level"), 1, 0))))
    asked = _placed(rows, key, F.array(_event(c(low), 0, -1), _event(c(high), 2, 1)))
    by_price = Window.partitionBy("symbol", "side", "size", "block").orderBy("p", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(opened, allowMissingColumns=True).withColumns({f"_n{k}": F.count(F.when(c("kind") == k, 1)).over(by_price) for k in kinds})
    # Levels up to the upper bound less those below the lower one, over all block sizes.
    counts = both.filter("o <> 1").groupBy(*key).agg(*[(F.sum(c("d") * c(f"_n{k}")) > 0).alias(f"_n{k}") for k in kinds])
    whole = counts.select(*key, F.filter(F.array(*[F.when(c(f"_n{k}"), F.lit(k)) for k in kinds]), lambda x: x.isNotNull()).alias("kinds"))
    met = rows.join(end_sessions(points, ["kind", "level"]), ["symbol", "side", "session_no"])
    near = F.filter("lives", lambda x: _alive(x) & (x["level"] >= c(low)) & (x["level"] <= c(high)))
    ends = met.select(*key, F.array_distinct(F.transform(near, lambda x: x["kind"].cast("int"))).alias("kinds"))
    return whole.unionByName(ends).groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"))
