"""Running states of a stream that don't depend on the order of arrival, and the rows a watermark would drop.

:func:`keep_states` writes one state a micro-batch (see :mod:`tallyforge.operators.registers`); :func:`kept_state` combines
them. :func:`keep_with_late` parts a feed into accepted, repeated and late rows, all written by the batch that brings them.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.registers import Registers, combine, state_of
from tallyforge.sources.sinks import committed_versions, drop_versions, keep_newest, latest_version, read_version, write_version
from tallyforge.streaming.feeds import run


def keep_states(feed: DataFrame, rule: Registers, root: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Write each micro-batch's state; a replayed batch rewrites its own."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        write_version(state_of(batch, rule), f"{root}/delta", batch_id)

    return run(feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), trigger)


def kept_state(spark: SparkSession, root: str, rule: Registers) -> DataFrame | None:
    """Everything so far as one state; None before the first batch."""
    base = latest_version(spark, f"{root}/base")
    later = [v for v in committed_versions(spark, f"{root}/delta") if base is None or v > base]
    paths = [f"{root}/base/v={base}"] if base is not None else []
    paths += [f"{root}/delta/v={v}" for v in later]
    return combine(spark.read.parquet(*paths), rule) if paths else None


def compact_states(spark: SparkSession, root: str, rule: Registers) -> None:
    """One base for all states so far. It is a state itself, times included, so an older event that comes later still loses."""
    deltas = committed_versions(spark, f"{root}/delta")
    if deltas and deltas[-1] != latest_version(spark, f"{root}/base"):
        write_version(kept_state(spark, root, rule), f"{root}/base", deltas[-1])
        drop_versions(spark, f"{root}/delta", deltas[:-1])
        keep_newest(spark, f"{root}/base")


SIDES = ("accepted", "repeated", "late")


def keep_with_late(
    feed: DataFrame, ts: str, event_id: str, longest_delay: timedelta, root: str, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """Part a feed: every row of a micro-batch becomes accepted, repeated or late, and none is lost.

    Late is what lies more than ``longest_delay`` behind the newest event of the batches before, or has no time. Of the other rows those
    whose id was accepted, in this batch or in an earlier one, are repeated. A copy that isn't late has its first one inside the
    delay as well, so only accepted rows inside it are searched: their folders by day are skipped else. ``root/newest`` holds the newest time
    after each batch; a replayed batch rewrites its versions of all tables.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest(spark, root, batch_id)
        behind = F.lit(False) if newest is None else F.col(ts) < F.lit(newest - longest_delay)
        judged = batch.withColumn("_late", F.coalesce(behind | F.col(ts).isNull(), F.lit(True))).persist(StorageLevel.DISK_ONLY)
        write_version(judged.filter("_late").drop("_late"), f"{root}/late", batch_id)
        fresh = judged.filter("NOT _late").drop("_late")
        columns = [c for c in fresh.columns if c != event_id]
        each = fresh.groupBy(event_id).agg(F.min(F.struct(ts, *[c for c in columns if c != ts])).alias("row"), F.count(F.lit(1)).alias("copies"))
        earlier = [v for v in committed_versions(spark, f"{root}/accepted") if v < batch_id]
        known = each.limit(0).select(event_id)
        if earlier:
            held = spark.read.parquet(*[f"{root}/accepted/v={v}" for v in earlier])
            since = F.lit(newest - longest_delay) if newest is not None else None
            known = (held if since is None else held.filter(F.col(ts) >= since)).select(event_id)
        seen = each.join(known.withColumn("_known", F.lit(1)), event_id, "left").persist(StorageLevel.DISK_ONLY)
        again = F.col("copies") - F.when(F.col("_known").isNull(), 1).otherwise(0)
        write_version(seen.filter("_known IS NULL").select(event_id, "row.*").select(batch.columns), f"{root}/accepted", batch_id)
        write_version(seen.filter(again > 0).select(event_id, "row.*", again.alias("copies")), f"{root}/repeated", batch_id)
        moment = judged.agg(F.max(ts).alias("newest"))
        write_version(moment if newest is None else moment.select(F.greatest("newest", F.lit(newest)).alias("newest")), f"{root}/newest", batch_id)
        seen.unpersist()
        judged.unpersist()

    return run(feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), trigger)


def _newest(spark: SparkSession, root: str, batch_id: int) -> datetime | None:
    versions = [v for v in committed_versions(spark, f"{root}/newest") if v < batch_id]
    return read_version(spark, f"{root}/newest", versions[-1]).first()["newest"] if versions else None


def parted(spark: SparkSession, root: str, side: str) -> DataFrame:
    """All rows of one of ``SIDES``; of repeated rows ``copies`` says how often each came again."""
    return spark.read.parquet(*[f"{root}/{side}/v={v}" for v in committed_versions(spark, f"{root}/{side}")])
