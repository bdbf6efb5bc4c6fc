"""New York wall clock, session windows and bucket arithmetic.

Instants are UTC epoch seconds (LONG); wall clocks are TIMESTAMP_NTZ. Nothing
here reads the session time zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NY = "America/New_York"
RTH_OPEN = 570
RTH_CLOSE = 960

# Minute of the New York day at which each key open is taken.
KEY_OPENS = {
    "midnight": 0,
    "premarket": 510,
    "ny_open": 570,
    "macro": 600,
    "pm": 810,
    "futures": 1080,
}


def epoch_seconds(wall: Column) -> Column:
    """UTC wall clock (NTZ) to epoch seconds, from its fields only."""
    days = F.datediff(wall.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)


def epoch_micros(wall: Column) -> Column:
    """Like epoch_seconds, with the fraction kept."""
    frac = F.extract(F.lit("SECOND"), wall) * 1000000
    days = F.datediff(wall.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return (days * 86400 + F.hour(wall) * 3600 + F.minute(wall) * 60) * 1000000 + frac.cast("long")


def utc_wall(ts: Column) -> Column:
    """Epoch seconds to UTC wall clock (NTZ)."""
    zero = F.lit(0)
    step = F.make_dt_interval(zero, zero, zero, ts.cast("decimal(18,6)"))
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + step


def to_ny(wall: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(NY), wall)


def from_ny(wall: Column) -> Column:
    return F.convert_timezone(F.lit(NY), F.lit("UTC"), wall)


def minute_of_day(wall: Column) -> Column:
    return F.hour(wall) * 60 + F.minute(wall)


def iso_date(wall: Column) -> Column:
    return wall.cast("date").cast("string")


def add_minutes(wall: Column, minutes: Column) -> Column:
    zero = F.lit(0)
    return wall + F.make_dt_interval(zero, zero, minutes.cast("int"))


def ny_time_columns(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add session (NY date), minute (of the NY day) and ny (wall clock)."""
    out = df.withColumn("ny", to_ny(utc_wall(F.col(ts))))
    return out.withColumns({"session": iso_date(F.col("ny")), "minute": minute_of_day(F.col("ny"))})


def trading_date(ny: Column, boundary: int = 1080) -> Column:
    """NY date that rolls forward at the boundary minute."""
    return iso_date(add_minutes(ny, F.lit(1440 - boundary)))


def bucket_index(minute: Column, width: int, anchor: int = RTH_OPEN) -> Column:
    return F.floor((minute - anchor) / F.lit(width)).cast("int")


def bucket_start(session: Column, bucket: Column, width: int, anchor: int = RTH_OPEN) -> Column:
    """Left edge of a bucket in epoch seconds, laid out on the wall clock."""
    midnight = session.cast("timestamp_ntz")
    return epoch_seconds(from_ny(add_minutes(midnight, bucket * width + anchor)))


def parse_session(spec: str) -> tuple[int, int]:
    """HHMM-HHMM to a pair of minutes; an end of 0000 is the end of the day."""
    found = re.fullmatch(r"(\d\d)(\d\d)-(\d\d)(\d\d)", spec)
    if not found:
        raise ValueError(f"session must look like HHMM-HHMM: {spec!r}")
    h0, m0, h1, m1 = map(int, found.groups())
    return h0 * 60 + m0, (h1 * 60 + m1) or 1440


def session_bounds(spec: Column) -> tuple[Column, Column]:
    """parse_session for specs held in a column."""
    part = lambda at: F.substring(spec, at, 2).cast("int")
    start, end = part(1) * 60 + part(3), part(6) * 60 + part(8)
    return start, F.when(end == 0, 1440).otherwise(end)


def in_window(minute: Column, start, end) -> Column:
    """Half-open window that wraps midnight when it starts after it ends."""
    start = start if isinstance(start, Column) else F.lit(start)
    end = end if isinstance(end, Column) else F.lit(end)
    straight = (minute >= start) & (minute < end)
    return F.when(start <= end, straight).otherwise((minute >= start) | (minute < end))


def in_session(minute: Column, spec: str) -> Column:
    return in_window(minute, *parse_session(spec))


def in_any(minute: Column, specs) -> Column:
    hit = F.lit(False)
    for spec in specs:
        hit = hit | in_session(minute, spec)
    return hit


def is_rth(minute: Column) -> Column:
    return (minute >= RTH_OPEN) & (minute < RTH_CLOSE)


def filter_rth(bars: DataFrame) -> DataFrame:
    return bars.filter(is_rth(F.col("minute")))


def slice_window(bars: DataFrame, start: int, end: int) -> DataFrame:
    return bars.filter((F.col("minute") >= start) & (F.col("minute") < end))


def local_to_epoch(stamp: Column) -> Column:
    """'yyyy-MM-dd HH:mm' on the New York clock to epoch seconds."""
    return epoch_seconds(from_ny(F.concat(stamp, F.lit(":00")).cast("timestamp_ntz")))
