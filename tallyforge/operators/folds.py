"""Per-event update rules folded over a batch of events.

Each rule has a batch half (one row per key, built from map-side combinable
aggregates, so a hot key never gathers its events in one task) and a merge half
that brings the batch onto a snapshot. Folding consecutive batches gives the same
snapshot as folding all events at once. An event that arrives after a later one
was folded is applied in arrival order; run the batch half over the whole history
when event order matters more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.labels import count_where, http_error, http_success
from tallyforge.operators.merge import merge
from tallyforge.plans.rewards import daily_stats

OLD = lambda name: F.col(f"old.{name}")
NEW = lambda name: F.col(f"new.{name}")


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def last_known(column: str, order: Column) -> Column:
    """Value of the latest event that carries one."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), order))


def _event_order(ts: str) -> Column:
    return F.struct(F.col(ts), F.col("id"))


# ---- points ---------------------------------------------------------------
def points_batch(feed: DataFrame) -> DataFrame:
    order = _event_order("event_time")
    return feed.groupBy("user_id").agg(
        F.sum("points_delta").alias("eco_points"),
        last_known("display_name", order).alias("display_name"),
        last_known("email", order).alias("email"),
        F.min("event_time").alias("joined_at"),
    )


def merge_points(profiles: DataFrame, batch: DataFrame) -> DataFrame:
    """Points add up; name and email keep the last value given."""
    return merge(
        profiles,
        batch,
        ["user_id"],
        {
            "email": F.coalesce(NEW("email"), OLD("email")),
            "display_name": F.coalesce(NEW("display_name"), OLD("display_name")),
            "eco_points": _zero(OLD("eco_points")) + _zero(NEW("eco_points")),
            "joined_at": F.coalesce(OLD("joined_at"), NEW("joined_at")),
        },
    )


def combine_points(deltas: DataFrame) -> DataFrame:
    """Several batch halves, numbered by ``batch_id``, as one."""
    order = F.col("batch_id")
    return deltas.groupBy("user_id").agg(
        F.sum("eco_points").alias("eco_points"),
        last_known("display_name", order).alias("display_name"),
        last_known("email", order).alias("email"),
        F.min_by("joined_at", order).alias("joined_at"),
    )


def ledger_rows(feed: DataFrame) -> DataFrame:
    """The ledger entry appended with each points change.

    The default type holds only for a feed without that column; a NULL that is sent stays NULL.
    """
    given = F.col("type") if "type" in feed.columns else F.lit("waste_deposit")
    category = F.col("waste_category") if "waste_category" in feed.columns else F.lit(None).cast("string")
    return feed.select(
        F.md5(F.concat_ws("|", F.lit("points"), F.col("id").cast("string"))).alias("id"),
        "user_id",
        F.col("points_delta").alias("points"),
        given.alias("type"),
        category.alias("waste_category"),
        F.col("event_time").alias("timestamp"),
    )


def touched_days(batch: DataFrame) -> list:
    """The days of a batch: at most as many values as the calendar has days."""
    return [row[0] for row in batch.select(F.to_date("timestamp")).distinct().collect() if row[0] is not None]


def daily_upsert(snapshot: DataFrame, ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace the days a batch touches by their recomputed figures.

    Distinct users do not add up, so a touched day is recomputed from the ledger
    (which already holds the batch). The list of touched days is bounded by the
    calendar and therefore safe to broadcast. Of a ledger laid out in day folders, which
    brings their column ``date``, only the touched folders are read.
    """
    touched = F.broadcast(batch.select(F.to_date("timestamp").alias("date")).distinct())
    if "date" in ledger.columns:
        days = ledger.filter(F.col("date").isin(touched_days(batch)))
    else:
        days = ledger.withColumn("date", F.to_date("timestamp")).join(touched, "date", "left_semi")
    return snapshot.join(touched, "date", "left_anti").unionByName(daily_stats(days))


# ---- feature usage --------------------------------------------------------
def feature_batch(log: DataFrame) -> DataFrame:
    """Usage per (admin, feature), with the first event's time kept apart."""
    spent = F.coalesce("execution_time_ms", F.lit(0))
    status = F.col("response_status")
    first = F.min(F.struct("created_at", "id", spent.alias("spent"), F.col("activity_category").alias("category")))
    return (
        log.filter(F.col("target_resource").isNotNull())
        .groupBy("admin_id", F.col("target_resource").alias("feature_name"))
        .agg(
            F.count(F.lit(1)).alias("usage_count"),
            F.max("created_at").alias("last_used_at"),
            F.sum(spent).alias("spent"),
            count_where(http_success(status)).alias("success_count"),
            count_where(http_error(status)).alias("error_count"),
            first.alias("first"),
        )
        .select(
            "admin_id",
            "feature_name",
            F.col("first.category").alias("feature_category"),
            "usage_count",
            "last_used_at",
            "spent",
            F.col("first.spent").cast("long").alias("first_spent"),
            "success_count",
            "error_count",
        )
    )


def combine_features(deltas: DataFrame) -> DataFrame:
    order = F.col("batch_id")
    return deltas.groupBy("admin_id", "feature_name").agg(
        F.min_by("feature_category", order).alias("feature_category"),
        F.sum("usage_count").alias("usage_count"),
        F.max_by("last_used_at", order).alias("last_used_at"),
        F.sum("spent").alias("spent"),
        F.min_by("first_spent", order).alias("first_spent"),
        F.sum("success_count").alias("success_count"),
        F.sum("error_count").alias("error_count"),
    )


def start_features(batch: DataFrame) -> DataFrame:
    """The insert leaves the time counter at zero, so the first event is not timed."""
    return batch.select(
        "admin_id",
        "feature_name",
        "feature_category",
        "usage_count",
        "last_used_at",
        (F.col("spent") - F.col("first_spent")).alias("total_time_spent"),
        "success_count",
        "error_count",
    )


def merge_features(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    known = OLD("feature_name").isNotNull()
    spent = F.when(known, NEW("spent")).otherwise(NEW("spent") - NEW("first_spent"))
    return merge(
        snapshot,
        batch,
        ["admin_id", "feature_name"],
        {
            "feature_category": F.coalesce(OLD("feature_category"), NEW("feature_category")),
            "usage_count": _zero(OLD("usage_count")) + _zero(NEW("usage_count")),
            "last_used_at": F.coalesce(NEW("last_used_at"), OLD("last_used_at")),
            "total_time_spent": _zero(OLD("total_time_spent")) + _zero(spent),
            "success_count": _zero(OLD("success_count")) + _zero(NEW("success_count")),
            "error_count": _zero(OLD("error_count")) + _zero(NEW("error_count")),
        },
    )


# ---- counters -------------------------------------------------------------
def performance_counter(log: DataFrame) -> DataFrame:
    """One per log row of the admin's day, whatever the activity type."""
    return log.groupBy("admin_id", F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("total_activities")
    )


def merge_performance(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    return merge(
        snapshot,
        batch,
        ["admin_id", "date"],
        {"total_activities": _zero(OLD("total_activities")) + _zero(NEW("total_activities"))},
    )


def combine_performance(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("admin_id", "date").agg(F.sum("total_activities").alias("total_activities"))


def intent_batch(messages: DataFrame) -> DataFrame:
    return (
        messages.filter(F.col("intent_category").isNotNull())
        .groupBy(F.col("intent_category").alias("intent_name"))
        .agg(F.count(F.lit(1)).alias("trigger_count"), F.max("created_at").alias("last_triggered_at"))
        .withColumn("intent_category", F.col("intent_name"))
    )


def combine_intents(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("intent_name").agg(
        F.sum("trigger_count").alias("trigger_count"),
        F.max_by("last_triggered_at", "batch_id").alias("last_triggered_at"),
        F.first("intent_category").alias("intent_category"),
    )


def merge_intents(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    return merge(
        snapshot,
        batch,
        ["intent_name"],
        {
            "intent_category": F.coalesce(OLD("intent_category"), NEW("intent_category")),
            "trigger_count": _zero(OLD("trigger_count")) + _zero(NEW("trigger_count")),
            "last_triggered_at": F.coalesce(NEW("last_triggered_at"), OLD("last_triggered_at")),
        },
    )


def count_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Add a batch of messages to the session counter; unknown sessions are ignored."""
    counted = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        sessions.join(counted, "session_id", "left")
        .withColumn("message_count", F.col("message_count") + _zero(F.col("_n")))
        .drop("_n")
    )


# ---- chat users -----------------------------------------------------------
USER_FIELDS = ["email", "display_name", "first_name", "last_name", "phone"]


def user_batch(feed: DataFrame) -> DataFrame:
    order = _event_order("event_time")
    return feed.groupBy("user_id").agg(
        *[last_known(f, order).alias(f) for f in USER_FIELDS],
        F.count(F.lit(1)).alias("_events"),
        F.max("event_time").alias("_last"),
    )


def merge_users(users: DataFrame, batch: DataFrame) -> DataFrame:
    """A user's first event creates the row and leaves the activity time unset."""
    updated = OLD("user_id").isNotNull() | (NEW("_events") > 1)
    rules = {f: F.coalesce(NEW(f), OLD(f)) for f in USER_FIELDS}
    rules["last_active_at"] = F.coalesce(F.when(updated, NEW("_last")), OLD("last_active_at"))
    return merge(users, batch, ["user_id"], rules)
