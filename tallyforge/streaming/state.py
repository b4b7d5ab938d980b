"""Running tables kept by a stream.

Two ways, with the same answer. :func:`keep_table` writes the whole table per
micro-batch: simple, and right for tables that are small beside a batch.
:func:`keep_deltas` writes only what a batch adds, one row per touched key, so a
batch costs what the batch holds however large the table is; readers fold the
deltas onto the last compacted base, and :func:`compact` bounds how many there are: what a
base holds is removed. Of whole tables and bases the newest two versions stay.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators import folds, lookups
from tallyforge.plans.rewards import daily_stats, leaderboard
from tallyforge.sources.sinks import committed_versions, drop_versions, keep_newest, latest_version, read_version, write_version
from tallyforge.streaming.feeds import run

Fold = Callable[[DataFrame, DataFrame], DataFrame]


def points_fold(profiles: DataFrame, batch: DataFrame) -> DataFrame:
    return folds.merge_points(profiles, folds.points_batch(batch))


def feature_fold(usage: DataFrame, batch: DataFrame) -> DataFrame:
    return folds.merge_features(usage, folds.feature_batch(batch))


def performance_fold(metrics: DataFrame, batch: DataFrame) -> DataFrame:
    return folds.merge_performance(metrics, folds.performance_counter(batch))


def intent_fold(intents: DataFrame, batch: DataFrame) -> DataFrame:
    return folds.merge_intents(intents, folds.intent_batch(batch))


def keep_table(
    feed: DataFrame, fold: Fold, initial: DataFrame, root: str, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """Fold a stream into a versioned table below ``root``.

    Batch *n* reads version *n - 1* (``initial`` for the first) and writes version
    *n*. Batch ids are consecutive and survive restarts, so a replayed batch
    repeats its own version and every event is applied exactly once. ``root`` and
    ``checkpoint`` belong together: start a new pair to start over.
    """
    columns = initial.columns

    def apply(batch: DataFrame, batch_id: int) -> None:
        before = initial if batch_id == 0 else read_version(batch.sparkSession, root, batch_id - 1)
        write_version(fold(before.select(*columns), batch).select(*columns), root, batch_id)
        keep_newest(batch.sparkSession, root)

    writer = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return run(writer, trigger)


def current_table(spark: SparkSession, root: str, initial: DataFrame) -> DataFrame:
    """The latest committed version, or ``initial`` before the first batch."""
    version = latest_version(spark, root)
    return initial if version is None else read_version(spark, root, version)


class Rule(NamedTuple):
    """An update rule: its batch half, how halves add up, and how they meet the table."""

    batch: Callable[[DataFrame], DataFrame]
    combine: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame, DataFrame], DataFrame]


POINTS = Rule(folds.points_batch, folds.combine_points, folds.merge_points)
FEATURES = Rule(folds.feature_batch, folds.combine_features, folds.merge_features)
PERFORMANCE = Rule(folds.performance_counter, folds.combine_performance, folds.merge_performance)
INTENTS = Rule(folds.intent_batch, folds.combine_intents, folds.merge_intents)


def keep_deltas(
    feed: DataFrame, rule: Rule, root: str, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """Write each micro-batch's half; a replayed batch rewrites its own."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        write_version(rule.batch(batch).withColumn("batch_id", F.lit(batch_id)), f"{root}/delta", batch_id)

    return run(feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), trigger)


def folded_table(spark: SparkSession, root: str, rule: Rule, initial: DataFrame) -> DataFrame:
    """The compacted base with all later deltas on top."""
    base = latest_version(spark, f"{root}/base")
    table = initial if base is None else read_version(spark, f"{root}/base", base)
    later = [v for v in committed_versions(spark, f"{root}/delta") if base is None or v > base]
    if not later:
        return table
    deltas = spark.read.parquet(*[f"{root}/delta/v={v}" for v in later])
    return rule.merge(table, rule.combine(deltas)).select(*initial.columns)


def compact(spark: SparkSession, root: str, rule: Rule, initial: DataFrame) -> int | None:
    """Write a base that holds every delta so far and remove what it replaces; returns its version.

    The newest base and the one before stay for readers that have begun; so does the newest
    delta, which its batch may write again after a failure.
    """
    deltas = committed_versions(spark, f"{root}/delta")
    newest = deltas[-1] if deltas else None
    if newest is not None and newest != latest_version(spark, f"{root}/base"):
        write_version(folded_table(spark, root, rule, initial), f"{root}/base", newest)
        drop_versions(spark, f"{root}/delta", deltas[:-1])
        keep_newest(spark, f"{root}/base")
    return newest


SESSION_EVENT = (
    "id BIGINT, kind STRING, session_id BIGINT, admin_id BIGINT, ip_address STRING, event_time TIMESTAMP_NTZ"
)


def session_fold(sessions: DataFrame, batch: DataFrame) -> DataFrame:
    """The session table after a batch of logins and logouts; a session may open and close in one batch."""
    logins = batch.filter("kind = 'login'").withColumn("login_time", F.col("event_time"))
    opened = lookups.login_sessions(logins).select(
        F.col("session_id").alias("id"),
        "admin_id",
        "session_token",
        "ip_address",
        "login_time",
        F.lit(None).cast("timestamp_ntz").alias("logout_time"),
        "is_active",
        F.lit(0).cast("long").alias("session_duration"),
    )
    return lookups.apply_logouts(sessions.unionByName(opened.select(sessions.columns)), batch.filter("kind = 'logout'"))


def session_log(sessions: DataFrame, batch: DataFrame, admins: DataFrame) -> DataFrame:
    """The log rows of a batch of logins and logouts; ``sessions`` as they are after it."""
    logins = batch.filter("kind = 'login'").withColumn("login_time", F.col("event_time"))
    return lookups.login_log(logins).unionByName(
        lookups.logout_log(batch.filter("kind = 'logout'"), sessions, admins)
    )


def keep_sessions(
    feed: DataFrame, initial: DataFrame, admins: DataFrame, root: str, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """Sessions opened and closed by a live feed (``SESSION_EVENT``), and the log rows this writes.

    Each micro-batch writes a version of the table and its own log rows; what :func:`feeds.ingest` checks
    requests against is the latest version.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = initial if batch_id == 0 else read_version(spark, f"{root}/table", batch_id - 1)
        write_version(session_fold(before, batch), f"{root}/table", batch_id)
        after = read_version(spark, f"{root}/table", batch_id)
        write_version(session_log(after, batch, admins), f"{root}/log", batch_id)
        keep_newest(spark, f"{root}/table")

    return run(feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), trigger)


def keep_points_job(
    feed: DataFrame, initial: DataFrame, root: str, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """The points job: each micro-batch writes its profile deltas, its ledger rows and the days it touches.

    A touched day is counted from the ledger's folders of its month alone. Every part is a version of
    its batch, so a batch that is replayed rewrites all of them. Read the parts with
    :func:`points_tables`.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_version(folds.points_batch(batch).withColumn("batch_id", F.lit(batch_id)), f"{root}/delta", batch_id)
        ledger = folds.ledger_rows(batch).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        ledger = ledger.withColumn("month", F.trunc("timestamp", "month"))
        ledger.hint("rebalance", F.col("month")).write.mode("overwrite").partitionBy("month").parquet(
            f"{root}/ledger/v={batch_id}"
        )
        so_far = ledger_of(spark, root).filter(F.col("v") <= batch_id)
        touched = folds.touched_days(so_far.filter(F.col("v") == batch_id))
        months = sorted({day.replace(day=1) for day in touched})
        days = daily_stats(so_far.filter(F.col("month").isin(months) & F.to_date("timestamp").isin(touched)))
        write_version(days.withColumn("batch_id", F.lit(batch_id)), f"{root}/days", batch_id)

    return run(feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), trigger)


def ledger_of(spark: SparkSession, root: str) -> DataFrame:
    """All ledger rows of the job, with the batch ``v`` that wrote them; folders by batch and month."""
    # declared, since an empty batch leaves a folder without files
    schema = "id STRING, user_id STRING, points INT, type STRING, waste_category STRING, timestamp TIMESTAMP"
    return spark.read.schema(f"{schema}, v INT, month DATE").parquet(f"{root}/ledger")


def points_tables(spark: SparkSession, root: str, initial: DataFrame) -> dict[str, DataFrame]:
    """profiles, ledger, days and leaderboard as of the last batch."""
    profiles = folded_table(spark, root, POINTS, initial)
    versions = committed_versions(spark, f"{root}/days")
    days = spark.read.parquet(*[f"{root}/days/v={v}" for v in versions])
    columns = [c for c in days.columns if c not in ("date", "batch_id")]
    last = days.groupBy("date").agg(F.max_by(F.struct(*columns), "batch_id").alias("last"))
    return {
        "profiles": profiles,
        "ledger": ledger_of(spark, root).drop("v", "month"),
        "days": last.select("date", "last.*"),
        "leaderboard": leaderboard(profiles),
    }
