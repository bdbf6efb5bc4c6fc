"""Bar order without one long window per symbol.

A symbol's history is one ordered series, so a window partitioned by symbol
alone would put the hottest symbol in one task. Here every bar first gets a
dense index from two bounded steps (row number inside a session plus the count
of earlier sessions), and history windows then run over fixed-size chunks of
that index. Each chunk also receives the last rows of the chunk before it (the
halo), so a bounded look-back gives the same answer as the full series.
Unbounded look-backs carry one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 4096


def session_w() -> WindowSpec:
    """Rows of one symbol and session in time order."""
    return Window.partitionBy("symbol", "session").orderBy("ts")


def session_so_far() -> WindowSpec:
    return session_w().rowsBetween(Window.unboundedPreceding, 0)


def session_summary(bars: DataFrame) -> DataFrame:
    """One row per (symbol, session) with its position and index offset."""
    per_day = bars.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("day_bars"))
    w = Window.partitionBy("symbol").orderBy("session")
    return per_day.select(
        "symbol",
        "session",
        "day_bars",
        F.row_number().over(w).alias("session_no"),
        F.coalesce(F.sum("day_bars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_idx"),
    )


def with_index(bars: DataFrame) -> DataFrame:
    """Add idx (0-based in the symbol), day_pos (1-based) and session_no."""
    days = session_summary(bars).select("symbol", "session", "session_no", "first_idx")
    placed = bars.withColumn("day_pos", F.row_number().over(session_w())).join(days, ["symbol", "session"])
    return placed.withColumn("idx", F.col("first_idx") + F.col("day_pos") - 1).drop("first_idx")


def over_history(
    df: DataFrame,
    look_back: int,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    key: str = "symbol",
    pos: str = "idx",
    chunk: int = CHUNK,
) -> DataFrame:
    """Run windows that reach back at most look_back rows, chunk by chunk."""
    if look_back > chunk:
        chunk = look_back
    home = F.floor(F.col(pos) / F.lit(chunk)).cast("long")
    copies = F.when(
        F.pmod(F.col(pos), F.lit(chunk)) >= chunk - look_back,
        F.array(F.struct(home.alias("chunk"), F.lit(False).alias("halo")),
                F.struct((home + 1).alias("chunk"), F.lit(True).alias("halo"))),
    ).otherwise(F.array(F.struct(home.alias("chunk"), F.lit(False).alias("halo"))))
    spread = df.withColumn("_copy", F.explode(copies)).select("*", "_copy.chunk", "_copy.halo").drop("_copy")
    w = Window.partitionBy(key, "chunk").orderBy(pos)
    return add(spread, w).filter(~F.col("halo")).drop("chunk", "halo")


def carry_last(
    df: DataFrame,
    source: dict[str, Column],
    key: str = "symbol",
    pos: str = "idx",
    chunk: int = CHUNK,
) -> DataFrame:
    """Last non-null value at or before each row, for any distance back.

    Inside a chunk this is a running last; across chunks one summary row per
    chunk is filled forward and joined back.
    """
    names = list(source)
    tagged = df.withColumn("chunk", F.floor(F.col(pos) / F.lit(chunk)).cast("long"))
    tagged = tagged.withColumns({f"_v_{n}": source[n] for n in names})
    w = Window.partitionBy(key, "chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    inside = tagged.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(w) for n in names})
    tails = tagged.groupBy(key, "chunk").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(pos))).alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        key, "chunk", *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in names])
    joined = inside.join(carried, [key, "chunk"])
    joined = joined.withColumns({n: F.coalesce(n, f"_c_{n}") for n in names})
    return joined.drop("chunk", *[f"_v_{n}" for n in names], *[f"_c_{n}" for n in names])


def back(w: WindowSpec, first: int, last: int = 0) -> WindowSpec:
    """Frame from `first` rows back to `last` rows back."""
    return w.rowsBetween(-first, -last)


def asof_join(probe: DataFrame, ref: DataFrame, key: str, probe_ts: str, ref_ts: str, value: str,
              span: int, strict: bool = False, seq: str | None = None) -> DataFrame:
    """Latest reference row at (or before) each probe row, as columns `value`.

    Both sides are cut into time slots of `span`; a slot's window starts from
    the last reference row of the slots before it, so no window grows with the
    length of the series. `value` is a struct column of the reference. With
    `strict` a reference at the very same time does not count.
    """
    slot = lambda col: F.floor(F.col(col) / F.lit(span)).cast("long")
    seq_col = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    refs = ref.select(key, F.col(ref_ts).cast("long").alias("_t"), seq_col.alias("_q"), F.col(value).alias("_r"))
    refs = refs.withColumn("_slot", slot("_t"))
    last = refs.groupBy(key, "_slot").agg(F.max_by("_r", F.struct("_t", "_q")).alias("_last"))
    slots = probe.select(key, slot(probe_ts).alias("_slot")).distinct()
    w = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    seeds = slots.join(last, [key, "_slot"], "full_outer").select(
        key, "_slot", F.last("_last", ignorenulls=True).over(w).alias("_seed"))
    order = F.lit(1 if strict else 0)
    probe_order = F.lit(0 if strict else 1)
    fields = probe.columns
    left = probe.select(key, slot(probe_ts).alias("_slot"), F.col(probe_ts).cast("long").alias("_t"),
                        probe_order.alias("_o"), F.lit(0).cast("long").alias("_q"),
                        F.struct(*fields).alias("_p"), F.lit(None).cast(refs.schema["_r"].dataType).alias("_r"))
    right = refs.join(slots, [key, "_slot"], "left_semi").select(
        key, "_slot", "_t", order.alias("_o"), "_q", F.lit(None).cast(left.schema["_p"].dataType).alias("_p"), "_r")
    run = Window.partitionBy(key, "_slot").orderBy("_t", "_o", "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_hit", F.last("_r", ignorenulls=True).over(run))
    both = both.filter(F.col("_p").isNotNull()).join(seeds, [key, "_slot"])
    return both.select("_p.*", F.coalesce("_hit", "_seed").alias(value))
