"""Date predicates and presets.

Predicates compare the timestamp column itself with date literals, so they reach
the parquet scan as pushed range filters instead of hiding behind a cast.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

# Preset name -> days before the end date.
PRESET_DAYS = {"1d": 1, "7d": 7, "30d": 30, "90d": 90}
DEFAULT_PRESET = "7d"


def _column(ts: Column | str) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def in_days(ts: Column | str, start: date, end: date) -> Column:
    """``DATE(ts) BETWEEN start AND end``, both ends included."""
    ts = _column(ts)
    return (ts >= F.lit(start)) & (ts < F.lit(end + timedelta(days=1)))


def on_day(ts: Column | str, day: date) -> Column:
    """``DATE(ts) = day``."""
    return in_days(ts, day, day)


def rows_of_days(df: DataFrame, ts: str, start: date, end: date, partition: str = "date") -> DataFrame:
    """Rows of an inclusive day range.

    A table laid out in one folder per day carries that day as ``partition``; the
    filter on it prunes folders, the one on the timestamp prunes row groups.
    """
    condition = in_days(ts, start, end)
    if partition in df.columns and partition != ts:
        condition = condition & F.col(partition).between(F.lit(start), F.lit(end))
    return df.filter(condition)


def rows_since(df: DataFrame, ts: str, day: date, days: int, partition: str = "date") -> DataFrame:
    """Rows of a look-back, with the same pruning."""
    condition = since_days(ts, day, days)
    if partition in df.columns and partition != ts:
        condition = condition & (F.col(partition) >= F.lit(day - timedelta(days=days)))
    return df.filter(condition)


def since_days(ts: Column | str, day: date, days: int) -> Column:
    """``ts >= day - days``; open towards the future."""
    return _column(ts) >= F.lit(day - timedelta(days=days))


def preset_range(preset: str, as_of: date) -> tuple[date, date]:
    """Inclusive ``(start, end)`` of a named range; unknown names mean seven days."""
    if preset == "1y":
        try:
            return as_of.replace(year=as_of.year - 1), as_of
        except ValueError:  # 29 February rolls over to 1 March
            return date(as_of.year - 1, 3, 1), as_of
    days = PRESET_DAYS.get(preset, PRESET_DAYS[DEFAULT_PRESET])
    return as_of - timedelta(days=days), as_of


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole elapsed seconds, truncated towards zero."""
    return F.timestamp_diff("SECOND", _column(start), _column(end))


def younger_than(ts: Column | str, as_of, hours: int = 24) -> Column:
    """Client-side validity: still inside the last ``hours`` before ``as_of``."""
    cutoff = as_of - timedelta(hours=hours)
    return _column(ts) > F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
