"""Live sessions cut inside the stream, and joins of two streams.

:func:`cut_sessions` keeps one open session a key and the events that the watermark has not passed; no log is read
again. :func:`session_ends` and :func:`unanswered` join two feeds within an interval of time: the watermarks of
both sides bound what is held, and what never finds a partner is given out once it no longer can.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

# workers of a cluster need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STATE = "start LONG, lo LONG, last LONG, n LONG, timer LONG, waiting ARRAY<LONG>"


class SessionCutter(StatefulProcessor):
    """Sessions of one key in microseconds.

    Events wait until the watermark has passed them, then continue the open session in order of time: one more than
    ``gap`` after the last opens a new session, one in another stretch of ``longest`` from the session's start a new piece. An
    event-time timer closes the session once no event can continue it. State is the open piece and what waits.
    """

    def __init__(self, gap: int, longest: int):
        self.gap, self.longest = gap, longest

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._advance(key, [row["at"] for row in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, more: list[int], watermark_ms: int) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        start, lo, last, n, timer, waiting = held if held is not None else (0, 0, 0, 0, None, [])
        passed = watermark_ms * 1_000
        waiting = sorted([*waiting, *more])
        done = []
        while waiting and waiting[0] < passed:
            at = waiting.pop(0)
            if n and at - last > self.gap:
                done.append((lo, last, n))
                n = 0
                start = lo = at
            elif not n:
                start = lo = at
            elif (at - start) // self.longest != (lo - start) // self.longest:
                done.append((lo, last, n))
                n, lo = 0, at
            last, n = at, n + 1
        if n and last + self.gap < passed:
            done.append((lo, last, n))
            n = 0
        due = [waiting[0]] if waiting else []
        due += [last + self.gap] if n else []
        due_ms = min(due) // 1_000 + 1 if due else None
        if due_ms != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due_ms is not None:
                self.handle.registerTimer(due_ms)
        if due_ms is None:
            self.state.clear()
        else:
            self.state.update((start, lo, last, n, due_ms, waiting))
        for first, end, count in done:
            yield Row(key=key[0], session_start=first, session_end=end, event_count=count)

    def close(self) -> None:
        pass


def cut_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, longest_delay: str, max_seconds: int = 86400) -> DataFrame:
    """Closed sessions with pauses of at most ``gap_seconds``, cut at multiples of ``max_seconds`` from their start.

    The same rows as :func:`tallyforge.operators.sessions.sessionize` of all events. ``key`` is a long and ``ts`` a
    ``TIMESTAMP``; rows without either belong to no session. Events later than ``longest_delay`` are dropped by Spark.
    In a session whose state store isn't RocksDB, start it within :func:`tallyforge.session.rocksdb_state`.
    """
    timed = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, longest_delay)
    keyed = timed.select(F.col(key).cast("long").alias("key"), F.unix_micros(ts).alias("at"), ts)
    cut = keyed.groupBy("key").transformWithState(
        statefulProcessor=SessionCutter(gap_seconds * 1_000_000, max_seconds * 1_000_000),
        outputStructType="key LONG, session_start LONG, session_end LONG, event_count LONG",
        outputMode="Append",
        timeMode="EventTime",
    )
    return cut.select(
        F.col("key").alias(key),
        F.timestamp_micros("session_start").alias("session_start"),
        F.timestamp_micros("session_end").alias("session_end"),
        F.floor((F.col("session_end") - F.col("session_start")) / 1_000_000).alias("session_seconds"),
        "event_count",
    )


def session_ends(logins: DataFrame, logouts: DataFrame, longest_delay: str, longest: str = "24 hours") -> DataFrame:
    """Each login with its logout, or without one if none comes within ``longest``.

    Both hold session_id, admin_id and event_time (``TIMESTAMP``). A logout of another admin or of an unknown session joins nothing. A session that
    is logged out twice comes twice.
    """
    opened = logins.select("session_id", "admin_id", F.col("event_time").alias("login_time")).withWatermark("login_time", longest_delay)
    closed = logouts.select(
        F.col("session_id").alias("_session"), F.col("admin_id").alias("_admin"), F.col("event_time").alias("logout_time")
    ).withWatermark("logout_time", longest_delay)
    within = F.expr(f"logout_time >= login_time AND logout_time <= login_time + INTERVAL {longest}")
    same = (F.col("session_id") == F.col("_session")) & (F.col("admin_id") == F.col("_admin"))
    return opened.join(closed, same & within, "left_outer").select(
        "session_id",
        "admin_id",
        "login_time",
        "logout_time",
        F.coalesce(F.timestamp_diff("SECOND", "login_time", "logout_time"), F.lit(0)).alias("session_duration"),
    )


def unanswered(failed: DataFrame, answered: DataFrame, ts: str, keys: list[str], longest_delay: str) -> DataFrame:
    """Failed requests whose retry, equal in ``ts`` and ``keys``, never comes before the watermark passes them."""
    left = failed.withWatermark(ts, longest_delay)
    right = answered.select(F.col(ts).alias("_at"), *[F.col(k).alias(f"_{k}") for k in keys]).withWatermark("_at", longest_delay)
    same = F.col(ts) == F.col("_at")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return left.join(right, same, "left_outer").filter(F.col("_at").isNull()).select(failed.columns)
