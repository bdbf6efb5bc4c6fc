"""Scheduled events and the minutes around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import timecols as tc

#: A calendar with at most this many filed events is broadcast; a larger one meets the rows by slot.
BROADCAST_ROWS = 200_000


def event_calendar_local(entries: DataFrame) -> DataFrame:
    """(stamp 'yyyy-MM-dd HH:mm' New York, name) to (event_ts, name)."""
    return entries.select(tc.local_to_epoch(F.col("stamp")).alias("event_ts"), F.col("name"))


def event_blackout(probe: DataFrame, calendar: DataFrame, before: int = 15, after: int = 15,
                   ts: str = "ts", name: str = "blocked_by") -> DataFrame:
    """Name of the earliest event whose blackout covers the row, else NULL.

    Both ends count. Time is cut into slots as long as a blackout, every event
    is filed under the slots it touches, and the join is on the slot.
    """
    span = max(60, (before + after) * 60)
    slots = F.sequence(F.floor((F.col("event_ts") - before * 60) / span).cast("long"),
                       F.floor((F.col("event_ts") + after * 60) / span).cast("long"))
    filed = calendar.select(F.explode(slots).alias("_slot"), F.struct("event_ts", "name").alias("_e"))
    per_slot = filed.groupBy("_slot").agg(F.array_sort(F.collect_list("_e")).alias("_events"))
    if filed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        per_slot = F.broadcast(per_slot)
    joined = probe.withColumn("_slot", F.floor(F.col(ts) / span).cast("long")).join(per_slot, "_slot", "left")
    hits = F.filter("_events", lambda e: (e.event_ts - before * 60 <= F.col(ts)) & (F.col(ts) <= e.event_ts + after * 60))
    return joined.withColumn("_hits", hits).withColumn(
        name, F.when(F.size("_hits") > 0, F.element_at("_hits", 1)["name"])).drop("_slot", "_events", "_hits")
