"""The named views: how each is built from stored tables, and its display order."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.plans import activity, chat, rewards

# Fixed values: (column, descending) per view or report section.
DISPLAY_ORDER: dict[str, list[tuple[str, bool]]] = {
    "v_daily_admin_activity": [("date", True), ("activity_count", True)],
    "v_security_events_summary": [("event_count", True)],
    "v_feature_usage_analytics": [("total_usage", True)],
    "v_daily_chat_analytics": [("date", True)],
    "v_intent_performance": [("total_occurrences", True)],
    "v_transaction_summary": [("timestamp", True)],
    "v_leaderboard": [("points", True), ("joined_at", False)],
    "v_daily_stats": [("date", True)],
    "v_category_stats": [("transaction_count", True)],
    "daily": [("date", True)],
    "security": [("event_count", True)],
    "performance": [("total_activities", True)],
    "daily_trends": [("date", False)],
    "activity_breakdown": [("count", True)],
    "admin_summary": [("total_activities", True)],
    "security_events": [("event_count", True)],
    "recent_events": [("created_at", True)],
    "security_trends": [("date", False)],
    "admin_performance": [("avg_activities", True)],
    "system_trends": [("date", False)],
    "feature_usage": [("total_usage", True)],
    "feature_trends": [("date", False), ("daily_usage", True)],
}


def display_order(name: str, df: DataFrame) -> DataFrame:
    """Rows in the order the application shows them.

    Sorting is left to whoever displays a result: plans stay unsorted, and a view
    that is only joined or aggregated further pays nothing for it.
    """
    keys = [F.desc(c) if descending else F.asc(c) for c, descending in DISPLAY_ORDER.get(name, [])]
    return df.orderBy(*keys) if keys else df


VIEWS: dict[str, Callable[[SimpleNamespace, Column], DataFrame]] = {
    "v_admin_activity_summary": lambda t, now: activity.admin_activity_summary(t.admins, t.sessions, t.log),
    "v_daily_admin_activity": lambda t, now: activity.daily_admin_activity(t.log, t.admins),
    "v_security_events_summary": lambda t, now: activity.security_summary(t.events),
    "v_feature_usage_analytics": lambda t, now: activity.feature_usage(t.usage),
    "v_user_chat_summary": lambda t, now: chat.user_summary(t.chat_users, t.chat_sessions, t.chat_messages),
    "v_daily_chat_analytics": lambda t, now: chat.daily_chat(t.chat_sessions, t.chat_messages, now),
    "v_intent_performance": lambda t, now: chat.intent_performance(t.chat_messages),
    "v_transaction_summary": lambda t, now: rewards.transaction_summary(t.transactions, t.profiles),
    "v_leaderboard": lambda t, now: rewards.leaderboard(t.profiles),
    "v_daily_stats": lambda t, now: rewards.daily_stats(t.transactions),
    "v_category_stats": lambda t, now: rewards.category_stats(t.transactions, t.waste_categories),
}


def create_views(tables: SimpleNamespace, as_of: Column, names: list[str] | None = None) -> list[str]:
    """Register views for SQL use. The leaderboard is ranked at this moment."""
    chosen = names or list(VIEWS)
    for name in chosen:
        VIEWS[name](tables, as_of).createOrReplaceTempView(name)
    return chosen
