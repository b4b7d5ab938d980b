"""Structured Streaming jobs over the live event feed.

Event time must be ``TIMESTAMP`` for a watermark, so feeds that carry
``TIMESTAMP_NTZ`` go through :func:`event_time` first. Dashboards poll every 30
seconds and every 5 minutes; jobs use the matching processing-time trigger, or
``availableNow`` to work off what has arrived and stop.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.intervals import events_in_intervals
from tallyforge.operators.lookups import accepted_rows, quarantined_rows, with_reason
from tallyforge.sources.sinks import committed_versions, drop_versions, write_version

# how often the pages that read a table ask for it
TRIGGERS = {"dashboard": "30 seconds", "report": "5 minutes"}


def event_time(feed: DataFrame, ts: str) -> DataFrame:
    return feed.withColumn(ts, F.col(ts).cast("timestamp"))


def run(writer, trigger: str | None = None) -> StreamingQuery:
    """Start a writer at an interval, or at that of a page in ``TRIGGERS``; without one it drains the source and stops."""
    if trigger:
        return writer.trigger(processingTime=TRIGGERS.get(trigger, trigger)).start()
    return writer.trigger(availableNow=True).start()


def ingest(
    requests: DataFrame,
    kind: str,
    sessions: DataFrame,
    admins: DataFrame,
    root: str,
    checkpoint: str,
    trigger: str | None = None,
) -> StreamingQuery:
    """A feed of requests to ``root/accepted`` and ``root/quarantine``, one version per micro-batch.

    Each request is judged once and goes to one side; a batch that is replayed after a
    failure rewrites its own versions, so nothing is added twice. :func:`compact_ingested` moves versions into day folders.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        judged = with_reason(batch, kind, sessions, admins).persist(StorageLevel.DISK_ONLY)
        write_version(accepted_rows(judged, kind), f"{root}/accepted", batch_id)
        write_version(quarantined_rows(judged, kind), f"{root}/quarantine", batch_id)
        judged.unpersist()

    writer = requests.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return run(writer, trigger)


def ingested(spark: SparkSession, root: str, side: str = "accepted", days: tuple[str, str] | None = None) -> DataFrame:
    """All committed rows of one side, or those of the days from the first to the last given: other day folders are not read."""
    segments, versions = _held(spark, f"{root}/{side}")
    out = spark.read.parquet(*[f"{root}/{side}/v={v}" for v in versions])  # the newest version is never moved
    within = F.lit(True) if days is None else F.col("date").between(*[F.lit(day).cast("date") for day in days])
    out = out.withColumn("date", F.to_date(_time_of(out)))
    for segment in segments:
        out = out.unionByName(spark.read.parquet(f"{root}/{side}/segments/v={segment}"))
    return out.filter(within).drop("date")


def _held(spark: SparkSession, folder: str) -> tuple[list[int], list[int]]:
    """Segments, and the versions that none of them covers."""
    segments = committed_versions(spark, f"{folder}/segments")
    return segments, [v for v in committed_versions(spark, folder) if not segments or v > segments[-1]]


def _time_of(rows: DataFrame) -> str:
    return "created_at" if "created_at" in rows.columns else "event_time"


def compact_ingested(spark: SparkSession, root: str, side: str = "accepted") -> int:
    """Move all versions but the newest, which its batch may write again, into a segment of day folders; returns how many.

    A segment is written once and never read to make another, so a row is moved once; the rebalance makes few files of a day
    and splits a busy one. Versions that a segment covers are not read any more, also if removing them broke off.
    """
    folder = f"{root}/{side}"
    segments, versions = _held(spark, folder)
    drop_versions(spark, folder, [v for v in committed_versions(spark, folder) if v not in versions])
    moved = versions[:-1]
    if not moved:
        return 0
    rows = spark.read.parquet(*[f"{folder}/v={v}" for v in moved])
    if rows.isEmpty():
        return 0
    dated = rows.withColumn("date", F.to_date(_time_of(rows)))
    dated.hint("rebalance", F.col("date")).write.mode("overwrite").partitionBy("date").parquet(f"{folder}/segments/v={moved[-1]}")
    drop_versions(spark, folder, moved)
    return len(moved)


def drop_repeats(feed: DataFrame, ts: str, event_id: str, longest_delay: str) -> DataFrame:
    """Exactly one copy of a retried event.

    The watermark must cover the longest time a client stays offline: state is
    kept that long, and events older than it are dropped as late.
    """
    return feed.withWatermark(ts, longest_delay).dropDuplicatesWithinWatermark([event_id])


def daily_counts(log: DataFrame, ts: str, longest_delay: str) -> DataFrame:
    """Activities per admin and tumbling day."""
    return (
        log.withWatermark(ts, longest_delay)
        .groupBy("admin_id", F.window(ts, "1 day").alias("day"))
        .agg(F.count(F.lit(1)).alias("total_activities"))
        .select("admin_id", F.to_date("day.start").alias("date"), "total_activities")
    )


def activity_sessions(log: DataFrame, ts: str, gap: str, longest_delay: str) -> DataFrame:
    """Live activity sessions; two missed heartbeats close one by default."""
    return (
        log.withWatermark(ts, longest_delay)
        .groupBy("admin_id", F.session_window(ts, gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("event_count"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))
        .select("admin_id", "session_start", "session_end", "event_count")
    )


def cut_long_sessions(
    sessions: DataFrame, log: DataFrame, ts: str, max_seconds: int = 86400
) -> DataFrame:
    """Closed live sessions, those longer than ``max_seconds`` cut at multiples of it from their start.

    A stream keeps only a session's ends and its count, so the few that are too long go back to
    their events in the log, by admin and stretches of time: a busy admin's events meet only the sessions
    around them. :func:`tallyforge.streaming.sessions.cut_sessions` needs no second look.
    """
    length = F.timestamp_diff("MICROSECOND", "session_start", "session_end")
    widest = max_seconds * 1_000_000
    short = sessions.filter(length < widest)
    long = sessions.filter(length >= widest)
    since = F.timestamp_diff("MICROSECOND", "session_start", F.col(ts))
    spans = long.select("admin_id", "session_start", "session_end")
    pieces = (
        events_in_intervals(spans, log.select("admin_id", F.col(ts)), ["admin_id"], "session_start", "session_end", ts, max_seconds)
        .groupBy("admin_id", "session_start", F.floor(since / widest).alias("_piece"))
        .agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count(F.lit(1)).alias("event_count"))
        .select("admin_id", F.col("_from").alias("session_start"), F.col("_to").alias("session_end"), "event_count")
    )
    return short.unionByName(pieces).withColumn(
        "session_seconds", F.floor(F.timestamp_diff("MICROSECOND", "session_start", "session_end") / 1_000_000)
    )


def write_updates(counts: DataFrame, root: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Changed rows of an update-mode aggregate, one version per micro-batch.

    Replaying a batch rewrites the same version, so restarts add nothing twice.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        write_version(batch, root, batch_id)

    writer = (
        counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    )
    return run(writer, trigger)
