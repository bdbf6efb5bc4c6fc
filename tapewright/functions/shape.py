"""Arithmetic on the columns of one bar, zone or level pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def r6(value, places: int = 6) -> Column:
    """Round for reporting; adding zero removes a negative zero."""
    value = c(value) if isinstance(value, str) else value
    return F.round(value, places) + F.lit(0.0)


def sign_of(value: Column) -> Column:
    """+1, -1 or 0 as an int; NULL counts as 0."""
    return F.when(value > 0, 1).when(value < 0, -1).otherwise(0)


def truthy(cond: Column) -> Column:
    """A condition with NULL read as false."""
    return F.coalesce(cond, F.lit(False))


def body_top() -> Column:
    return F.greatest("open", "close")


def body_bottom() -> Column:
    return F.least("open", "close")


def bar_range() -> Column:
    return c("high") - c("low")


def body_fraction() -> Column:
    return F.when(bar_range() > 0, (body_top() - body_bottom()) / bar_range()).otherwise(0.0)


def close_position() -> Column:
    return F.when(bar_range() > 0, (c("close") - c("low")) / bar_range()).otherwise(0.5)


def is_up() -> Column:
    return c("close") > c("open")


def is_down() -> Column:
    return c("close") < c("open")


def typical_price() -> Column:
    return (c("high") + c("low") + c("close")) / 3.0


def bar_shape_columns(bars: DataFrame) -> DataFrame:
    return bars.withColumns({
        "range": bar_range(),
        "body_top": body_top(),
        "body_bottom": body_bottom(),
        "body_fraction": body_fraction(),
        "is_up": is_up(),
        "is_down": is_down(),
        "close_position": close_position(),
    })


def rel_err(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


def simple_return(start: Column, end: Column) -> Column:
    """end/start - 1; NULL when either is missing or the start is not positive."""
    return F.when(start > 0, end / start - 1.0)


def r_multiple(entry: Column, stop: Column, price: Column, is_long: Column) -> Column:
    """Signed move over risk; 0 when there is no risk."""
    risk = F.abs(entry - stop)
    move = F.when(is_long, price - entry).otherwise(entry - price)
    return F.when(risk > 0, move / risk).otherwise(0.0)


def zone_contains(top: Column, bottom: Column) -> Column:
    """The bar's range overlaps the zone, edges included."""
    return (c("low") <= top) & (c("high") >= bottom)


def zone_invalidated(bull: Column, ext: Column, buffer: float = 0.0) -> Column:
    return F.when(bull, c("low") < ext - buffer).otherwise(c("high") > ext + buffer)


def gap_contains(price: Column, top: Column, bottom: Column, ob_top: Column | None = None,
                 ob_bottom: Column | None = None) -> Column:
    """Price inside a gap, or inside its order block when one is passed."""
    inside = (price >= bottom) & (price <= top)
    if ob_top is not None:
        inside = inside | truthy((price >= ob_bottom) & (price <= ob_top))
    return truthy(inside)


def range_ready() -> Column:
    return truthy((c("pdh") - c("pdl")) > 0)


def dealing_range_columns(df: DataFrame) -> DataFrame:
    """Middles and widths of the previous day and week."""
    return df.withColumns({
        "daily_eq": (c("pdh") + c("pdl")) / 2.0,
        "daily_range": c("pdh") - c("pdl"),
        "weekly_eq": (c("pwh") + c("pwl")) / 2.0,
        "weekly_range": c("pwh") - c("pwl"),
        "ready": range_ready(),
    })


def half_range_fraction(price: Column, bull: Column, high: str, low: str) -> Column:
    """Distance from the middle in half ranges, positive on the helpful side."""
    eq = (c(high) + c(low)) / 2.0
    width = c(high) - c(low)
    signed = F.when(bull, eq - price).otherwise(price - eq)
    return F.when(width > 0, signed / (width / 2.0)).otherwise(0.0)


def dealing_depth(price: Column, bull: Column) -> Column:
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    daily = clamp(half_range_fraction(price, bull, "pdh", "pdl"))
    weekly = clamp(half_range_fraction(price, bull, "pwh", "pwl"))
    return F.pow(daily * 0.65 + weekly * 0.35, F.lit(1.5))


def deep_on_both(price: Column, bull: Column) -> Column:
    daily = half_range_fraction(price, bull, "pdh", "pdl")
    weekly = half_range_fraction(price, bull, "pwh", "pwl")
    return (daily > 0.45) & (weekly > 0.45)


def favourable(price: Column, bull: Column, band: float = 0.10) -> Column:
    """Price beyond the daily middle by a share of the daily range."""
    eq = (c("pdh") + c("pdl")) / 2.0
    margin = (c("pdh") - c("pdl")) * band
    side = F.when(bull, price < eq - margin).otherwise(price > eq + margin)
    return range_ready() & truthy(side)
