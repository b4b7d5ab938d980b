"""Day counters, filtered lists and the recent-rows panels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.dates import rows_of_days
from tallyforge.functions.formats import clock_of, day_and_time, hour_minute, one_decimal
from tallyforge.functions.labels import all_of, count_where, rate_band, resolved_label, truthy_or
from tallyforge.operators.aggregates import one_record
from tallyforge.operators.ranking import top_rows


def day_counters(
    sessions: DataFrame, log: DataFrame, visits: DataFrame, events: DataFrame, day: date
) -> DataFrame:
    """Six counters of one day; one scan per table. Admins are counted in the log."""
    return one_record(
        rows_of_days(sessions, "login_time", day, day).agg(
            F.count(F.lit(1)).alias("total_sessions"),
            count_where(F.col("is_active")).alias("active_sessions"),
        ),
        rows_of_days(log, "created_at", day, day).agg(
            F.count(F.lit(1)).alias("total_activities"), F.count_distinct("admin_id").alias("unique_admins")
        ),
        rows_of_days(visits, "created_at", day, day).agg(F.count(F.lit(1)).alias("total_page_views")),
        rows_of_days(events, "created_at", day, day).agg(F.count(F.lit(1)).alias("security_events")),
    )


def _names(admins: DataFrame) -> DataFrame:
    return admins.select(F.col("id").alias("admin_id"), "username", "display_name")


def _newest(ts: str) -> list[Column]:
    return [F.desc(ts), F.desc("id")]


def sessions_list(
    sessions: DataFrame,
    admins: DataFrame,
    admin_id: int | None = None,
    active: bool | int | None = None,
    limit: int = 50,
) -> DataFrame:
    """Latest sessions. An admin id of 0 is no filter; ``active=0`` is one."""
    filters = []
    if admin_id:
        filters.append(F.col("admin_id") == admin_id)
    if active is not None:
        filters.append(F.col("is_active") == F.lit(bool(active)))
    joined = sessions.filter(all_of(filters)).join(_names(admins), "admin_id")
    return top_rows(joined, _newest("login_time"), limit).select(
        "id",
        "admin_id",
        "session_token",
        "ip_address",
        "login_time",
        "logout_time",
        "is_active",
        "session_duration",
        "username",
        "display_name",
    )


def activities_list(
    log: DataFrame,
    admins: DataFrame,
    admin_id: int | None = None,
    activity_type: str | None = None,
    limit: int = 100,
) -> DataFrame:
    filters = []
    if admin_id:
        filters.append(F.col("admin_id") == admin_id)
    if activity_type:
        filters.append(F.col("activity_type") == activity_type)
    joined = log.filter(all_of(filters)).join(_names(admins), "admin_id")
    return top_rows(joined, _newest("created_at"), limit).select(
        "id",
        "admin_id",
        "activity_type",
        "activity_category",
        "activity_description",
        "target_resource",
        "target_id",
        "ip_address",
        "created_at",
        "execution_time_ms",
        "username",
        "display_name",
    )


def security_list(
    events: DataFrame, severity: str | None = None, resolved: bool | int | None = None, limit: int = 100
) -> DataFrame:
    filters = []
    if severity:
        filters.append(F.col("event_severity") == severity)
    if resolved is not None:
        filters.append(F.col("is_resolved") == F.lit(bool(resolved)))
    return top_rows(events.filter(all_of(filters)), _newest("created_at"), limit).select(
        "id",
        "admin_id",
        "event_type",
        "event_severity",
        "event_description",
        "ip_address",
        "is_resolved",
        "created_at",
        "resolved_at",
    )


def recent_activities(log: DataFrame, admins: DataFrame, limit: int = 20) -> DataFrame:
    joined = log.join(_names(admins), "admin_id")
    return top_rows(joined, _newest("created_at"), limit).select(
        "id",
        "activity_type",
        "activity_category",
        "activity_description",
        "target_resource",
        "created_at",
        "execution_time_ms",
        "username",
        "display_name",
        truthy_or(F.col("display_name"), F.col("username")).alias("shown_name"),
        hour_minute(F.col("created_at")).alias("shown_time"),
    )


def recent_security(
    events: DataFrame, limit: int = 10, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Dashboard form without a range; report form with a range and 50 rows."""
    if start is not None and end is not None:
        events = rows_of_days(events, "created_at", start, end)
    return top_rows(events, _newest("created_at"), limit).select(
        "id",
        "event_type",
        "event_severity",
        "event_description",
        "ip_address",
        "is_resolved",
        "created_at",
        "resolved_at",
        F.lower("event_severity").alias("severity_class"),
        resolved_label(F.col("is_resolved")).alias("status_label"),
        day_and_time(F.col("created_at")).alias("shown_time"),
    )


def performance_of_day(
    metrics: DataFrame, admins: DataFrame, day: date, admin_id: int | None = None
) -> DataFrame:
    filters = [F.col("date") == F.lit(day)]
    if admin_id:
        filters.append(F.col("admin_id") == admin_id)
    return (
        metrics.filter(all_of(filters))
        .join(_names(admins), "admin_id")
        .select(
            "admin_id",
            "username",
            "display_name",
            "date",
            "total_login_time",
            "total_activities",
            "total_page_views",
            "avg_session_duration",
            "success_rate",
            "error_count",
        )
    )


def performance_banded(metrics: DataFrame, admins: DataFrame, day: date) -> DataFrame:
    """The on-screen form: names, clock times, one-decimal rate and its colour."""
    table = performance_of_day(metrics, admins, day)
    return table.select(
        "admin_id",
        truthy_or(F.col("display_name"), F.col("username")).alias("shown_name"),
        "total_activities",
        clock_of(F.col("total_login_time")).alias("login_time"),
        clock_of(F.col("avg_session_duration")).alias("avg_session"),
        F.concat(one_decimal(F.col("success_rate")), F.lit("%")).alias("success_rate"),
        rate_band(F.col("success_rate")).alias("rate_band"),
        "error_count",
    )
