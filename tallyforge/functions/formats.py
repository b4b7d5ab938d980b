"""Display formatting; none of it depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clock_of(seconds: Column) -> Column:
    """``HH:MM:SS`` of a number of seconds, wrapping at 24 hours."""
    s = F.pmod(seconds.cast("long"), F.lit(86400))
    part = lambda unit, wrap: F.floor(F.pmod(s, F.lit(wrap)) / unit)
    return F.format_string("%02d:%02d:%02d", part(3600, 86400), part(60, 3600), part(1, 60))


def hour_minute(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def day_and_time(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, HH:mm")


def one_decimal(value: Column) -> Column:
    return F.format_number(value, 1)
