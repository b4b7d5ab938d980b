"""Activity summaries: per admin, per day, per feature, per security event type."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.dates import rows_of_days, rows_since
from tallyforge.functions.labels import count_where, mean_of, percentage


def _sessions_per_admin(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("admin_id").agg(
        F.count("id").alias("n_sessions"),
        F.max("login_time").alias("last_login"),
        F.sum("session_duration").alias("seconds"),
        F.count("session_duration").alias("timed"),
        F.count_distinct(F.to_date("login_time")).alias("days"),
    )


def _activity_per_admin(log: DataFrame) -> DataFrame:
    return log.groupBy("admin_id").agg(
        F.count("id").alias("n_activities"), F.count_distinct("activity_type").alias("n_types")
    )


def _with_children(admins: DataFrame, sessions: DataFrame, log: DataFrame) -> DataFrame:
    parent = admins.select(F.col("id").alias("admin_id"), "username", "display_name")
    return parent.join(_sessions_per_admin(sessions), "admin_id", "left").join(
        _activity_per_admin(log), "admin_id", "left"
    )


def _activity_total(fan_out: bool) -> Column:
    """Joining two child tables to one parent repeats each activity once per session.

    The repeated total is computed from the two counts instead of building the
    session x activity rows, which would grow quadratically for a busy admin.
    """
    activities = F.coalesce(F.col("n_activities"), F.lit(0))
    if not fan_out:
        return activities
    return activities * F.greatest(F.coalesce(F.col("n_sessions"), F.lit(0)), F.lit(1))


def admin_activity_summary(admins: DataFrame, sessions: DataFrame, log: DataFrame, fan_out: bool = True) -> DataFrame:
    return _with_children(admins, sessions, log).select(
        "admin_id",
        "username",
        "display_name",
        F.coalesce("n_sessions", F.lit(0)).alias("total_sessions"),
        _activity_total(fan_out).alias("total_activities"),
        "last_login",
        mean_of(F.col("seconds"), F.col("timed")).alias("avg_session_duration"),
        F.coalesce("days", F.lit(0)).alias("active_days"),
        F.coalesce("n_types", F.lit(0)).alias("unique_activity_types"),
    )


def admin_day(
    admins: DataFrame,
    sessions: DataFrame,
    log: DataFrame,
    day: date,
    admin_id: int | None = None,
    fan_out: bool = True,
) -> DataFrame:
    """One row per admin for one day, zeros included; optionally a single admin."""
    if admin_id is not None:
        admins = admins.filter(F.col("id") == admin_id)
        sessions = sessions.filter(F.col("admin_id") == admin_id)
        log = log.filter(F.col("admin_id") == admin_id)
    joined = _with_children(
        admins, rows_of_days(sessions, "login_time", day, day), rows_of_days(log, "created_at", day, day)
    )
    return joined.select(
        "admin_id",
        "username",
        "display_name",
        F.coalesce("n_sessions", F.lit(0)).alias("total_sessions"),
        _activity_total(fan_out).alias("total_activities"),
        mean_of(F.col("seconds"), F.col("timed")).alias("avg_session_duration"),
        F.coalesce("n_types", F.lit(0)).alias("unique_activity_types"),
        "last_login",
    )


def daily_admin_activity(log: DataFrame, admins: DataFrame) -> DataFrame:
    """Grouped by admin id, which is not shown: namesakes stay separate rows.

    The log is reduced to one row per admin and day before the names are joined.
    """
    per_day = log.groupBy(F.to_date("created_at").alias("date"), "admin_id").agg(
        F.count("id").alias("activity_count"),
        F.count_distinct("activity_type").alias("unique_activities"),
        F.count_distinct("target_resource").alias("resources_accessed"),
        F.sum("execution_time_ms").alias("total_execution_time"),
        F.count("execution_time_ms").alias("timed"),
    )
    names = admins.select(F.col("id").alias("admin_id"), "username", "display_name")
    return per_day.join(names, "admin_id").select(
        "date",
        "username",
        "display_name",
        "activity_count",
        "unique_activities",
        "resources_accessed",
        "total_execution_time",
        mean_of(F.col("total_execution_time"), F.col("timed")).alias("avg_execution_time"),
    )


def daily_series(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("total_activities"),
        F.count_distinct("admin_id").alias("unique_admins"),
        F.count_distinct("activity_type").alias("unique_activity_types"),
        mean_of(F.sum("execution_time_ms"), F.count("execution_time_ms")).alias("avg_execution_time"),
    )


def daily_analytics(log: DataFrame, day: date, days: int = 7) -> DataFrame:
    """Look-back series; later days than ``day`` are included as well."""
    return daily_series(rows_since(log, "created_at", day, days))


def daily_trends(log: DataFrame, start: date, end: date) -> DataFrame:
    return daily_series(rows_of_days(log, "created_at", start, end))


def activity_breakdown(log: DataFrame, start: date, end: date) -> DataFrame:
    return (
        rows_of_days(log, "created_at", start, end)
        .groupBy("activity_type", "activity_category")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.round(F.avg("execution_time_ms"), 4).alias("avg_execution_time"),
        )
    )


def security_summary(events: DataFrame) -> DataFrame:
    """An unset resolved flag is neither resolved nor pending."""
    return events.groupBy("event_type", "event_severity").agg(
        F.count(F.lit(1)).alias("event_count"),
        count_where(F.col("is_resolved")).alias("resolved_count"),
        count_where(~F.col("is_resolved")).alias("pending_count"),
        F.min("created_at").alias("first_occurrence"),
        F.max("created_at").alias("last_occurrence"),
    )


def security_counts(events: DataFrame, start: date, end: date) -> DataFrame:
    return security_summary(rows_of_days(events, "created_at", start, end)).drop(
        "first_occurrence", "last_occurrence"
    )


def security_trends(events: DataFrame, start: date, end: date) -> DataFrame:
    return (
        rows_of_days(events, "created_at", start, end)
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            count_where(F.col("event_severity") == "CRITICAL").alias("critical_events"),
            count_where(F.col("event_severity") == "HIGH").alias("high_events"),
            count_where(F.col("is_resolved")).alias("resolved_events"),
        )
    )


def feature_usage(usage: DataFrame) -> DataFrame:
    """Success rate over successes plus errors; NULL when a feature had neither."""
    totals = usage.groupBy("feature_name", "feature_category").agg(
        F.count_distinct("admin_id").alias("unique_users"),
        F.sum("usage_count").alias("total_usage"),
        F.count("usage_count").alias("n"),
        F.sum("total_time_spent").alias("total_time_spent"),
        F.sum("success_count").alias("total_successes"),
        F.sum("error_count").alias("total_errors"),
    )
    return totals.select(
        "feature_name",
        "feature_category",
        "unique_users",
        "total_usage",
        mean_of(F.col("total_usage"), F.col("n")).alias("avg_usage_per_user"),
        "total_time_spent",
        "total_successes",
        "total_errors",
        percentage(F.col("total_successes"), F.col("total_successes") + F.col("total_errors")).alias("success_rate"),
    )


def feature_usage_between(usage: DataFrame, start: date, end: date) -> DataFrame:
    return feature_usage(rows_of_days(usage, "last_used_at", start, end))


def feature_trends(usage: DataFrame, start: date, end: date) -> DataFrame:
    """Lifetime counters bucketed by the day of last use, as reported."""
    return (
        rows_of_days(usage, "last_used_at", start, end)
        .groupBy(F.to_date("last_used_at").alias("date"), "feature_name")
        .agg(F.sum("usage_count").alias("daily_usage"))
    )


def feature_trends_corrected(log: DataFrame, start: date, end: date) -> DataFrame:
    """Uses counted on the day they happened."""
    return (
        rows_of_days(log, "created_at", start, end)
        .filter(F.col("target_resource").isNotNull())
        .groupBy(F.to_date("created_at").alias("date"), F.col("target_resource").alias("feature_name"))
        .agg(F.count(F.lit(1)).alias("daily_usage"))
    )
