"""Daily rollups: the reported ones and those the schema only declares."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.functions.dates import in_days, rows_of_days
from tallyforge.functions.labels import count_where, http_error, http_success, mean_of, percentage, percentage_or_zero
from tallyforge.operators.aggregates import one_record, one_record_per, top_name, top_of
from tallyforge.operators.sessions import peak_concurrency
from tallyforge.plans.chat import daily_chat


def _log_days(log: DataFrame) -> DataFrame:
    """All log figures of a day in one pass; unused ones are pruned by the optimizer."""
    return (
        log.groupBy(F.to_date("created_at").alias("date"), "admin_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("execution_time_ms").alias("spent"),
            F.count("execution_time_ms").alias("timed"),
            count_where(http_error(F.col("response_status"))).alias("bad"),
        )
        .groupBy("date")
        .agg(
            F.sum("n").alias("total_activities"),
            top_of(F.col("admin_id"), F.col("n"), F.col("admin_id")).alias("most_active_admin"),
            F.round(F.try_divide(F.sum("spent"), F.sum("timed"))).cast("long").alias("avg_response_time_ms"),
            percentage(F.sum("bad"), F.sum("n"), 2).alias("error_rate"),
        )
    )


def _session_days(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(F.to_date("login_time").alias("date")).agg(
        F.count(F.lit(1)).alias("total_admin_logins"),
        count_where(F.col("is_active")).alias("total_active_sessions"),
    )


def _all_days(
    sessions: DataFrame, log: DataFrame, visits: DataFrame, usage: DataFrame, *more: DataFrame
) -> DataFrame:
    views = visits.groupBy(F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("total_page_views"))
    features = (
        usage.groupBy(F.to_date("last_used_at").alias("date"), "feature_name")
        .agg(F.sum("usage_count").alias("n"))
        .groupBy("date")
        .agg(top_name(F.col("feature_name"), F.col("n")).alias("most_used_feature"))
    )
    return one_record_per(["date"], _session_days(sessions), _log_days(log), views, features, *more)


def _zero(*columns: str) -> list[Column]:
    return [F.coalesce(c, F.lit(0)).alias(c) for c in columns]


def daily_rollup(sessions: DataFrame, log: DataFrame, visits: DataFrame, usage: DataFrame) -> DataFrame:
    """Logins, activities, page views and leaders of every day, in one job.

    The busiest admin is taken from the raw log, the leading feature from the
    lifetime usage counter of the features last used that day. Ties go to the
    smallest id or name.
    """
    return _all_days(sessions, log, visits, usage).select(
        "date",
        *_zero("total_admin_logins", "total_activities", "total_page_views"),
        "most_active_admin",
        "most_used_feature",
    )


def daily_rollup_of(
    sessions: DataFrame, log: DataFrame, visits: DataFrame, usage: DataFrame, start: date, end: date
) -> DataFrame:
    """The rollup of some days only, reading only those days."""
    return daily_rollup(
        rows_of_days(sessions, "login_time", start, end),
        rows_of_days(log, "created_at", start, end),
        rows_of_days(visits, "created_at", start, end),
        rows_of_days(usage, "last_used_at", start, end),
    )


def performance_rollup(sessions: DataFrame, log: DataFrame, visits: DataFrame) -> DataFrame:
    """Declared per-admin-and-day metrics; the activity counter is the reported one."""
    keys = ["admin_id", "date"]
    logins = sessions.groupBy("admin_id", F.to_date("login_time").alias("date")).agg(
        F.sum("session_duration").alias("total_login_time"),
        F.round(F.avg("session_duration")).cast("long").alias("avg_session_duration"),
    )
    status = F.col("response_status")
    activity = (
        log.groupBy("admin_id", F.to_date("created_at").alias("date"), "target_resource")
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_where(http_success(status)).alias("n_ok"),
            count_where(http_error(status)).alias("n_bad"),
        )
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("total_activities"),
            F.sum("n_ok").alias("n_ok"),
            F.sum("n_bad").alias("error_count"),
            top_name(
                F.col("target_resource"), F.when(F.col("target_resource").isNotNull(), F.col("n")).otherwise(0)
            ).alias("most_used_feature"),
        )
    )
    views = visits.groupBy("admin_id", F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("total_page_views")
    )
    return one_record_per(keys, logins, activity, views).select(
        *keys,
        *_zero("total_login_time", "total_activities", "total_page_views", "avg_session_duration", "error_count"),
        "most_used_feature",
        percentage_or_zero(F.coalesce("n_ok", F.lit(0)), F.coalesce("total_activities", F.lit(0))).alias("success_rate"),
    )


def system_rollup(sessions: DataFrame, log: DataFrame, visits: DataFrame, usage: DataFrame) -> DataFrame:
    """The reported daily rollup plus its declared but never filled columns."""
    return _all_days(sessions, log, visits, usage, peak_concurrency(sessions)).select(
        "date",
        *_zero(
            "total_admin_logins",
            "total_active_sessions",
            "total_activities",
            "total_page_views",
            "peak_concurrent_users",
            "avg_response_time_ms",
        ),
        F.coalesce("error_rate", F.lit(0.0)).alias("error_rate"),
        "most_active_admin",
        "most_used_feature",
    )


def chat_rollup(sessions: DataFrame, messages: DataFrame, as_of: Column) -> DataFrame:
    """Declared daily chat table: unweighted duration, modal intent, mean rating."""
    daily = daily_chat(sessions, messages, as_of, message_weighted=False)
    intents = (
        sessions.select("session_id", F.to_date("started_at").alias("date"))
        .join(
            messages.filter(F.col("intent_category").isNotNull())
            .groupBy("session_id", "intent_category")
            .agg(F.count(F.lit(1)).alias("n")),
            "session_id",
        )
        .groupBy("date", "intent_category")
        .agg(F.sum("n").alias("n"))
        .groupBy("date")
        .agg(top_name(F.col("intent_category"), F.col("n")).alias("most_common_intent"))
    )
    return daily.join(intents, "date", "left").select(
        "date",
        F.col("sessions").alias("total_sessions"),
        F.col("messages").alias("total_messages"),
        "unique_users",
        F.round("avg_session_duration").cast("long").alias("avg_session_duration"),
        mean_of(F.col("messages"), F.col("sessions"), 2).alias("avg_messages_per_session"),
        "most_common_intent",
        F.round("avg_satisfaction", 2).alias("satisfaction_score"),
    )


def intent_rollup(messages: DataFrame) -> DataFrame:
    return (
        messages.filter(F.col("intent_category").isNotNull())
        .groupBy(F.col("intent_category").alias("intent_name"))
        .agg(
            F.count(F.lit(1)).alias("trigger_count"),
            count_where(F.col("is_helpful")).alias("success_count"),
            F.round(F.avg("confidence_score"), 2).cast("double").alias("avg_confidence"),
            F.max("created_at").alias("last_triggered_at"),
        )
    )


def period_change(sessions: DataFrame, log: DataFrame, start: date, end: date) -> DataFrame:
    """Counters of a range against the same-length range before it."""
    length = (end - start) + timedelta(days=1)
    before = (start - length, end - length)

    def pair(frame: DataFrame, ts: str, name: str) -> DataFrame:
        return rows_of_days(frame, ts, before[0], end).agg(
            count_where(in_days(ts, start, end)).alias(f"{name}_now"),
            count_where(in_days(ts, *before)).alias(f"{name}_before"),
        )

    record = one_record(pair(sessions, "login_time", "sessions"), pair(log, "created_at", "activities"))
    return record.select(
        *record.columns,
        *[
            F.round(
                F.try_divide(F.col(f"{n}_now") - F.col(f"{n}_before"), F.col(f"{n}_before")) * 100, 2
            ).alias(f"{n}_change_pct")
            for n in ("sessions", "activities")
        ],
    )


def intraday(log: DataFrame, hours: int = 4) -> DataFrame:
    """Mean response time and distinct admins per bucket of the day's clock."""
    bucket = (F.floor(F.hour("created_at") / hours) * hours).cast("int").alias("bucket_hour")
    return log.groupBy(F.to_date("created_at").alias("date"), bucket).agg(
        F.round(F.avg("execution_time_ms"), 4).alias("avg_response_ms"),
        F.count_distinct("admin_id").alias("active_users"),
    )


def weekday_profile(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """Activities and sessions per weekday, Monday first."""
    weekday = lambda ts: (F.weekday(F.to_date(ts)) + 1).alias("weekday")
    return one_record_per(
        ["weekday"],
        log.groupBy(weekday("created_at")).agg(F.count(F.lit(1)).alias("activities")),
        sessions.groupBy(weekday("login_time")).agg(F.count(F.lit(1)).alias("sessions")),
    )


def security_share(events: DataFrame) -> DataFrame:
    """Two separate shares: by resolution status and by severity."""
    status = F.when(F.col("is_resolved"), "Resolved").otherwise("Pending")
    counted = events.groupBy(status.alias("status"), F.col("event_severity").alias("severity")).agg(
        F.count(F.lit(1)).alias("n")
    )
    long = counted.select(
        "n", F.expr("stack(2, 'status', status, 'severity', severity) AS (dimension, label)")
    )
    grouped = long.groupBy("dimension", "label").agg(F.sum("n").alias("events"))
    total = F.sum("events").over(Window.partitionBy("dimension"))
    return grouped.select("dimension", "label", "events", percentage(F.col("events"), total, 2).alias("share_pct"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("feedback_type").agg(
        F.count(F.lit(1)).alias("feedback_count"),
        F.round(F.avg("rating"), 4).alias("avg_rating"),
        count_where(~F.col("is_resolved")).alias("unresolved_count"),
    )


def preferences_pivot(preferences: DataFrame, keys: list[str]) -> DataFrame:
    """Preference rows to columns; the key list is fixed, so no extra pass."""
    return preferences.groupBy("user_id").pivot("preference_key", keys).agg(F.max("preference_value"))
