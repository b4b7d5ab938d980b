"""Chat summaries. Messages are reduced per session before any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.dates import seconds_between
from tallyforge.functions.labels import count_where, mean_of, percentage


def _per_session(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(
        F.count("id").alias("n_messages"),
        F.sum("response_time_ms").alias("response_ms"),
        F.count("response_time_ms").alias("n_response"),
        F.sum("user_rating").alias("rating_sum"),
        F.count("user_rating").alias("n_rating"),
    )


def user_summary(users: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    per_user = (
        sessions.select("id", "session_id", "user_id", "started_at")
        .join(_per_session(messages), "session_id", "left")
        .groupBy("user_id")
        .agg(
            F.count("id").alias("n_sessions"),
            F.sum("n_messages").alias("n_messages"),
            F.max("started_at").alias("last_chat_at"),
            F.sum("response_ms").alias("response_ms"),
            F.sum("n_response").alias("n_response"),
            F.sum("rating_sum").alias("rating_sum"),
            F.sum("n_rating").alias("n_rating"),
        )
    )
    return users.select("user_id", "display_name", "email").join(per_user, "user_id", "left").select(
        "user_id",
        "display_name",
        "email",
        F.coalesce("n_sessions", F.lit(0)).alias("total_sessions"),
        F.coalesce("n_messages", F.lit(0)).alias("total_messages"),
        "last_chat_at",
        mean_of(F.col("response_ms"), F.col("n_response")).alias("avg_response_time"),
        mean_of(F.col("rating_sum"), F.col("n_rating")).alias("avg_rating"),
    )


def daily_chat(sessions: DataFrame, messages: DataFrame, as_of: Column, message_weighted: bool = True) -> DataFrame:
    """Per-day chat figures; open sessions run until ``as_of``.

    The faithful form weights each session's duration by its message count (an
    empty session weighs one), because the duration is averaged after the join.
    """
    seconds = seconds_between("started_at", F.coalesce("ended_at", as_of))
    joined = (
        sessions.select("id", "session_id", "user_id", "started_at", seconds.alias("seconds"))
        .join(_per_session(messages), "session_id", "left")
        .withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))
    )
    repeat = F.greatest("n_messages", F.lit(1)) if message_weighted else F.lit(1)
    weight = F.when(F.col("seconds").isNotNull(), repeat).otherwise(0)
    daily = joined.groupBy(F.to_date("started_at").alias("date")).agg(
        F.count("id").alias("sessions"),
        F.sum("n_messages").alias("messages"),
        F.count_distinct("user_id").alias("unique_users"),
        F.sum(F.col("seconds") * weight).alias("seconds"),
        F.sum(weight).alias("weight"),
        F.sum("rating_sum").alias("rating_sum"),
        F.sum("n_rating").alias("n_rating"),
    )
    return daily.select(
        "date",
        "sessions",
        "messages",
        "unique_users",
        mean_of(F.col("seconds"), F.col("weight")).alias("avg_session_duration"),
        mean_of(F.col("rating_sum"), F.col("n_rating")).alias("avg_satisfaction"),
    )


def intent_performance(messages: DataFrame) -> DataFrame:
    """Helpful share over all rows of the intent, unrated ones included."""
    return (
        messages.filter(F.col("intent_category").isNotNull())
        .groupBy("intent_category")
        .agg(
            F.count(F.lit(1)).alias("total_occurrences"),
            F.round(F.avg("confidence_score"), 6).cast("double").alias("avg_confidence"),
            F.round(F.avg("user_rating"), 4).alias("avg_rating"),
            count_where(F.col("is_helpful")).alias("helpful_count"),
        )
        .withColumn("helpful_percentage", percentage(F.col("helpful_count"), F.col("total_occurrences")))
    )
