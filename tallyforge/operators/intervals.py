"""Events inside intervals of their key, joined by stretches of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _stretch(ts: Column, seconds: int) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz")) / (seconds * 1_000_000))


def events_in_intervals(
    intervals: DataFrame, events: DataFrame, keys: list[str], start: str, end: str, ts: str, stretch_seconds: int
) -> DataFrame:
    """Every (interval, event) of equal ``keys`` with ``start <= ts <= end``, with the columns of both.

    Time is cut into stretches; an interval comes once for each stretch it touches, an event once, and they join on
    (keys, stretch). A busy key is so parted by time: an interval meets the events of its stretches, not all of its key. Stretches
    about as long as the usual interval are right. Intervals without an end hold nothing. Columns besides the keys must differ.
    """
    touched = F.explode(F.sequence(_stretch(F.col(start), stretch_seconds), _stretch(F.col(end), stretch_seconds)))
    cut = intervals.filter(F.col(start) <= F.col(end)).withColumn("_stretch", touched)
    dated = events.withColumn("_stretch", _stretch(F.col(ts), stretch_seconds))
    within = (F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))
    return cut.join(dated, [*keys, "_stretch"]).filter(within).drop("_stretch")
