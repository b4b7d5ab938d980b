"""The six reports and their dispatcher."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, functions as F

from tallyforge.functions.dates import preset_range, rows_of_days
from tallyforge.functions.labels import count_where, http_error, http_success, mean_of, percentage, percentage_or_zero
from tallyforge.operators.aggregates import one_record
from tallyforge.plans import activity, dashboard
from tallyforge.plans.views import display_order


def overview(
    sessions: DataFrame,
    log: DataFrame,
    visits: DataFrame,
    events: DataFrame,
    usage: DataFrame,
    admins: DataFrame,
    start: date,
    end: date,
) -> DataFrame:
    """Eight metrics; admins are counted in the sessions, leaders may be NULL."""
    names = admins.select(F.col("id").alias("admin_id"), "username")
    active = F.when(F.col("session_duration") > 0, F.col("session_duration"))
    # orphan admins count as activities but cannot lead
    named = F.col("username").isNotNull()
    per_admin = rows_of_days(log, "created_at", start, end).groupBy("admin_id").agg(F.count("id").alias("n"))
    busiest = (
        per_admin.join(names, "admin_id", "left")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_activities"),
            F.min(F.when(named, F.struct((-F.col("n")).alias("w"), F.col("username").alias("name")))).alias("best"),
        )
        .select(
            "total_activities",
            F.col("best.name").alias("most_active_admin"),
            (-F.col("best.w")).alias("most_active_count"),
        )
    )
    feature = (
        rows_of_days(usage, "last_used_at", start, end)
        .groupBy("feature_name")
        .agg(F.sum("usage_count").alias("n"))
        .agg(F.min(F.struct((-F.col("n")).alias("w"), F.col("feature_name").alias("name"))).alias("best"))
        .select(F.col("best.name").alias("most_used_feature"), (-F.col("best.w")).alias("most_used_count"))
    )
    return one_record(
        rows_of_days(sessions, "login_time", start, end).agg(
            F.count(F.lit(1)).alias("total_sessions"),
            F.count_distinct("admin_id").alias("unique_admins"),
            mean_of(F.sum(active), F.count(active)).alias("avg_session_duration"),
        ),
        rows_of_days(visits, "created_at", start, end).agg(F.count(F.lit(1)).alias("total_page_views")),
        rows_of_days(events, "created_at", start, end).agg(F.count(F.lit(1)).alias("security_events")),
        busiest,
        feature,
    )


def overview_long(record: DataFrame) -> DataFrame:
    """``Metric, Value`` rows; nested values as JSON, a missing leader as NULL."""
    count = lambda c: F.to_json(F.struct(F.col(c).alias("count")))
    leader = lambda name, key, n, as_n: F.when(
        F.col(name).isNotNull(), F.to_json(F.struct(F.col(name).alias(key), F.col(n).alias(as_n)))
    )
    values = {
        "total_sessions": count("total_sessions"),
        "unique_admins": count("unique_admins"),
        "total_activities": count("total_activities"),
        "total_page_views": count("total_page_views"),
        "security_events": count("security_events"),
        "avg_session_duration": F.to_json(
            F.struct(F.col("avg_session_duration").alias("avg_duration")), {"ignoreNullFields": "false"}
        ),
        "most_active_admin": leader("most_active_admin", "username", "most_active_count", "activity_count"),
        "most_used_feature": leader("most_used_feature", "feature_name", "most_used_count", "total_usage"),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])
    return record.select(F.inline(rows))


def admin_summary(log: DataFrame, admins: DataFrame, start: date, end: date) -> DataFrame:
    """Success rate over all activities, 0 when there are none."""
    status = F.col("response_status")
    per_admin = (
        rows_of_days(log, "created_at", start, end)
        .groupBy("admin_id")
        .agg(
            F.count("id").alias("total_activities"),
            F.count_distinct(F.to_date("created_at")).alias("active_days"),
            F.sum("execution_time_ms").alias("spent"),
            F.count("execution_time_ms").alias("timed"),
            count_where(http_success(status)).alias("success_count"),
            count_where(http_error(status)).alias("error_count"),
        )
    )
    names = admins.select(F.col("id").alias("admin_id"), "username", "display_name")
    return per_admin.join(names, "admin_id").select(
        "username",
        "display_name",
        "total_activities",
        "active_days",
        mean_of(F.col("spent"), F.col("timed")).alias("avg_execution_time"),
        "success_count",
        "error_count",
        percentage_or_zero(F.col("success_count"), F.col("total_activities")).alias("success_rate"),
    )


def admin_performance(metrics: DataFrame, admins: DataFrame, start: date, end: date) -> DataFrame:
    per_admin = (
        rows_of_days(metrics, "date", start, end)
        .groupBy("admin_id")
        .agg(
            F.round(F.avg("total_activities"), 4).alias("avg_activities"),
            F.round(F.avg("total_login_time"), 4).alias("avg_login_time"),
            F.round(F.avg("avg_session_duration"), 4).alias("avg_session_duration"),
            F.round(F.avg(F.col("success_rate").cast("decimal(5,2)")), 6).cast("double").alias("avg_success_rate"),
            F.round(F.avg("error_count"), 4).alias("avg_error_count"),
            F.count_distinct("date").alias("active_days"),
        )
    )
    names = admins.select(F.col("id").alias("admin_id"), "username", "display_name")
    return per_admin.join(names, "admin_id").drop("admin_id")


def system_trends(system: DataFrame, start: date, end: date) -> DataFrame:
    return rows_of_days(system, "date", start, end).select(
        "date",
        "total_admin_logins",
        "total_activities",
        "total_page_views",
        "avg_response_time_ms",
        "error_rate",
    )


def system_health(sessions: DataFrame, log: DataFrame, start: date, end: date) -> DataFrame:
    """"Peak concurrent users" is the reported figure: most logins on one day."""
    daily = (
        rows_of_days(sessions, "login_time", start, end)
        .groupBy(F.to_date("login_time").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return one_record(
        rows_of_days(log, "created_at", start, end).agg(
            F.round(F.avg("execution_time_ms"), 4).alias("avg_response_time"),
            percentage(count_where(http_error(F.col("response_status"))), F.count(F.lit(1))).alias("error_rate"),
            F.count_distinct(F.to_date("created_at")).alias("uptime_days"),
        ),
        daily.agg(F.max("n").alias("peak_concurrent_users")),
    )


class Tables:
    """The frames a report reads, by name."""

    def __init__(self, **frames: DataFrame):
        self.__dict__.update(frames)


def _overview_sections(t: Tables, start: date, end: date) -> dict[str, DataFrame]:
    record = overview(t.sessions, t.log, t.visits, t.events, t.usage, t.admins, start, end)
    return {"overview": overview_long(record)}


def _activity_sections(t: Tables, start: date, end: date) -> dict[str, DataFrame]:
    return {
        "daily_trends": activity.daily_trends(t.log, start, end),
        "activity_breakdown": activity.activity_breakdown(t.log, start, end),
        "admin_summary": admin_summary(t.log, t.admins, start, end),
    }


def _security_sections(t: Tables, start: date, end: date) -> dict[str, DataFrame]:
    return {
        "security_events": activity.security_counts(t.events, start, end),
        "recent_events": dashboard.recent_security(t.events, 50, start, end),
        "security_trends": activity.security_trends(t.events, start, end),
    }


def _performance_sections(t: Tables, start: date, end: date) -> dict[str, DataFrame]:
    return {
        "admin_performance": admin_performance(t.performance, t.admins, start, end),
        "system_trends": system_trends(t.system, start, end),
    }


def _feature_sections(t: Tables, start: date, end: date) -> dict[str, DataFrame]:
    return {
        "feature_usage": activity.feature_usage_between(t.usage, start, end),
        "feature_trends": activity.feature_trends(t.usage, start, end),
    }


def _health_sections(t: Tables, start: date, end: date) -> dict[str, DataFrame]:
    return {"system_health": system_health(t.sessions, t.log, start, end)}


REPORTS: dict[str, Callable[[Tables, date, date], dict[str, DataFrame]]] = {
    "overview": _overview_sections,
    "admin_activity": _activity_sections,
    "security": _security_sections,
    "performance": _performance_sections,
    "feature_usage": _feature_sections,
    "system_health": _health_sections,
}


def generate_report(tables: Tables, report: str, preset: str, as_of: date) -> dict[str, DataFrame]:
    """Sections of a named report over a preset range; unknown names are an error."""
    if report not in REPORTS:
        raise ValueError(f"unknown report type: {report}")
    start, end = preset_range(preset, as_of)
    sections = REPORTS[report](tables, start, end)
    return {name: display_order(name, frame) for name, frame in sections.items()}


ANALYTICS = ("summary", "daily", "admin", "security", "performance")


def generate_analytics(
    tables: Tables, kind: str, day: date, admin_id: int | None = None, days: int = 7
) -> DataFrame:
    """The per-day analytics requests."""
    if kind == "summary":
        return dashboard.day_counters(tables.sessions, tables.log, tables.visits, tables.events, day)
    if kind == "daily":
        return display_order(kind, activity.daily_analytics(tables.log, day, days))
    if kind == "admin":
        if not admin_id:
            raise ValueError("an admin id is required")
        return activity.admin_day(tables.admins, tables.sessions, tables.log, day, admin_id)
    if kind == "security":
        return display_order(kind, activity.security_counts(tables.events, day, day))
    if kind == "performance":
        return display_order(kind, dashboard.performance_of_day(tables.performance, tables.admins, day))
    raise ValueError(f"unknown analytics type: {kind}")
