"""Declared table schemas. Reads never infer.

Fixed values: column names and types of the 26 tables, with unsigned ids widened
to BIGINT, enums and JSON held as STRING. ``NOT NULL`` marks required columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

_STAMPS = "created_at TIMESTAMP, updated_at TIMESTAMP"

DDL: dict[str, str] = {
    # points and rewards
    "admins": "id BIGINT NOT NULL, username STRING NOT NULL, password_hash STRING NOT NULL, "
    f"display_name STRING, email STRING, is_active BOOLEAN, {_STAMPS}",
    "admin_audit": "id BIGINT NOT NULL, admin_id BIGINT NOT NULL, action STRING NOT NULL, details STRING, "
    "ip_address STRING, user_agent STRING, created_at TIMESTAMP",
    "profiles": "id BIGINT NOT NULL, user_id STRING NOT NULL, email STRING, display_name STRING, eco_points INT, "
    f"total_waste_deposited INT, joined_at TIMESTAMP, {_STAMPS}",
    "transactions": "id STRING NOT NULL, user_id STRING NOT NULL, points INT NOT NULL, type STRING, "
    "waste_category STRING, timestamp TIMESTAMP, created_at TIMESTAMP",
    "waste_categories": "id BIGINT NOT NULL, category_name STRING NOT NULL, points_value INT NOT NULL, "
    "is_active BOOLEAN, created_at TIMESTAMP",
    "ai_detection_mapping": "id BIGINT NOT NULL, coco_class STRING NOT NULL, waste_category STRING NOT NULL, "
    "confidence_threshold DECIMAL(3,2), is_active BOOLEAN, created_at TIMESTAMP",
    "rewards": "id STRING NOT NULL, title STRING NOT NULL, description STRING, cost_points INT NOT NULL, "
    f"is_active BOOLEAN, {_STAMPS}",
    "leaderboard_cache": "id BIGINT NOT NULL, user_id STRING NOT NULL, display_name STRING NOT NULL, "
    "eco_points INT NOT NULL, rank_position INT NOT NULL, updated_at TIMESTAMP",
    "daily_analytics": "id BIGINT NOT NULL, date DATE NOT NULL, total_transactions INT, total_points_earned INT, "
    f"total_points_redeemed INT, unique_users INT, waste_deposits INT, redemptions INT, {_STAMPS}",
    # admin activity
    "admin_sessions": "id BIGINT NOT NULL, admin_id BIGINT NOT NULL, session_token STRING NOT NULL, "
    "ip_address STRING NOT NULL, user_agent STRING, login_time TIMESTAMP, logout_time TIMESTAMP, "
    f"is_active BOOLEAN, session_duration INT, {_STAMPS}",
    "admin_activity_log": "id BIGINT NOT NULL, admin_id BIGINT NOT NULL, session_id BIGINT, "
    "activity_type STRING NOT NULL, activity_category STRING NOT NULL, activity_description STRING NOT NULL, "
    "target_resource STRING, target_id STRING, old_values STRING, new_values STRING, ip_address STRING NOT NULL, "
    "user_agent STRING, request_method STRING, request_url STRING, response_status INT, execution_time_ms INT, "
    "additional_data STRING, created_at TIMESTAMP",
    "admin_page_visits": "id BIGINT NOT NULL, admin_id BIGINT NOT NULL, session_id BIGINT, page_name STRING NOT NULL, "
    "page_url STRING NOT NULL, visit_duration INT, referrer_url STRING, ip_address STRING NOT NULL, "
    "user_agent STRING, screen_resolution STRING, browser_name STRING, browser_version STRING, os_name STRING, "
    "device_type STRING, created_at TIMESTAMP",
    "admin_data_changes": "id BIGINT NOT NULL, admin_id BIGINT NOT NULL, session_id BIGINT, table_name STRING NOT NULL, "
    "record_id STRING NOT NULL, operation_type STRING NOT NULL, field_name STRING, old_value STRING, "
    "new_value STRING, change_reason STRING, ip_address STRING NOT NULL, created_at TIMESTAMP",
    "admin_security_events": "id BIGINT NOT NULL, admin_id BIGINT, event_type STRING NOT NULL, "
    "event_severity STRING NOT NULL, event_description STRING NOT NULL, ip_address STRING NOT NULL, "
    "user_agent STRING, additional_data STRING, is_resolved BOOLEAN, resolved_at TIMESTAMP, resolved_by BIGINT, "
    "created_at TIMESTAMP",
    "admin_performance_metrics": "id BIGINT NOT NULL, admin_id BIGINT NOT NULL, date DATE NOT NULL, "
    "total_login_time INT, total_activities INT, total_page_views INT, avg_session_duration INT, "
    f"most_used_feature STRING, error_count INT, success_rate DECIMAL(5,2), {_STAMPS}",
    "system_usage_stats": "id BIGINT NOT NULL, date DATE NOT NULL, total_admin_logins INT, total_active_sessions INT, "
    "total_activities INT, total_page_views INT, peak_concurrent_users INT, avg_response_time_ms INT, "
    f"error_rate DECIMAL(5,2), most_active_admin BIGINT, most_used_feature STRING, {_STAMPS}",
    "feature_usage_tracking": "id BIGINT NOT NULL, admin_id BIGINT NOT NULL, feature_name STRING NOT NULL, "
    "feature_category STRING NOT NULL, usage_count INT, last_used_at TIMESTAMP, total_time_spent INT, "
    f"success_count INT, error_count INT, {_STAMPS}",
    # chat
    "chatbot_users": "id BIGINT NOT NULL, user_id STRING NOT NULL, email STRING, display_name STRING, "
    "first_name STRING, last_name STRING, phone STRING, avatar_url STRING, timezone STRING, language STRING, "
    f"is_active BOOLEAN, is_premium BOOLEAN, {_STAMPS}, last_active_at TIMESTAMP",
    "user_preferences": "id BIGINT NOT NULL, user_id STRING NOT NULL, preference_key STRING NOT NULL, "
    f"preference_value STRING, {_STAMPS}",
    "chat_sessions": "id BIGINT NOT NULL, session_id STRING NOT NULL, user_id STRING NOT NULL, session_name STRING, "
    "is_active BOOLEAN, started_at TIMESTAMP, ended_at TIMESTAMP, message_count INT, total_tokens_used INT, "
    f"{_STAMPS}",
    "chat_messages": "id BIGINT NOT NULL, session_id STRING NOT NULL, user_id STRING NOT NULL, "
    "message_type STRING NOT NULL, message_content STRING NOT NULL, message_tokens INT, response_time_ms INT, "
    "sentiment_score DECIMAL(3,2), intent_category STRING, confidence_score DECIMAL(3,2), is_helpful BOOLEAN, "
    "user_rating TINYINT, created_at TIMESTAMP",
    "ai_knowledge_base": "id BIGINT NOT NULL, category STRING NOT NULL, question_patterns STRING NOT NULL, "
    "response_template STRING NOT NULL, keywords STRING NOT NULL, priority INT, is_active BOOLEAN, "
    f"usage_count INT, success_rate DECIMAL(3,2), {_STAMPS}",
    "user_activity_log": "id BIGINT NOT NULL, user_id STRING NOT NULL, activity_type STRING NOT NULL, "
    "activity_data STRING, ip_address STRING, user_agent STRING, session_id STRING, created_at TIMESTAMP",
    "chat_analytics": "id BIGINT NOT NULL, date DATE NOT NULL, total_sessions INT, total_messages INT, "
    "unique_users INT, avg_session_duration INT, avg_messages_per_session DECIMAL(5,2), "
    f"most_common_intent STRING, satisfaction_score DECIMAL(3,2), {_STAMPS}",
    "intent_tracking": "id BIGINT NOT NULL, intent_name STRING NOT NULL, intent_category STRING NOT NULL, "
    f"trigger_count INT, success_count INT, avg_confidence DECIMAL(3,2), last_triggered_at TIMESTAMP, {_STAMPS}",
    "user_feedback": "id BIGINT NOT NULL, user_id STRING NOT NULL, session_id STRING, message_id BIGINT, "
    "feedback_type STRING NOT NULL, feedback_text STRING, rating TINYINT, is_resolved BOOLEAN, "
    f"admin_notes STRING, {_STAMPS}",
}

# The longest text of each limited column.
LENGTHS: dict[str, dict[str, int]] = {
    "admins": {"username": 64, "password_hash": 255, "display_name": 120, "email": 190},
    "admin_audit": {"action": 120, "ip_address": 45},
    "profiles": {"user_id": 64, "email": 190, "display_name": 120},
    "transactions": {"id": 36, "user_id": 64, "type": 50, "waste_category": 50},
    "waste_categories": {"category_name": 50},
    "ai_detection_mapping": {"coco_class": 100, "waste_category": 50},
    "rewards": {"id": 20, "title": 120},
    "leaderboard_cache": {"user_id": 64, "display_name": 120},
    "admin_sessions": {"session_token": 255, "ip_address": 45},
    "admin_activity_log": {"activity_type": 100, "activity_category": 50, "target_resource": 100, "target_id": 100,
                           "ip_address": 45, "request_method": 10},
    "admin_page_visits": {"page_name": 100, "ip_address": 45, "screen_resolution": 20, "browser_name": 50,
                          "browser_version": 20, "os_name": 50},
    "admin_data_changes": {"table_name": 100, "record_id": 100, "field_name": 100, "ip_address": 45},
    "admin_security_events": {"event_type": 50, "ip_address": 45},
    "admin_performance_metrics": {"most_used_feature": 100},
    "system_usage_stats": {"most_used_feature": 100},
    "feature_usage_tracking": {"feature_name": 100, "feature_category": 50},
    "chatbot_users": {"user_id": 64, "email": 190, "display_name": 120, "first_name": 60, "last_name": 60, "phone": 20,
                      "avatar_url": 255, "timezone": 50, "language": 10},
    "user_preferences": {"user_id": 64, "preference_key": 100},
    "chat_sessions": {"session_id": 36, "user_id": 64, "session_name": 120},
    "chat_messages": {"session_id": 36, "user_id": 64, "intent_category": 100},
    "ai_knowledge_base": {"category": 100},
    "user_activity_log": {"user_id": 64, "activity_type": 50, "ip_address": 45, "session_id": 36},
    "chat_analytics": {"most_common_intent": 100},
    "intent_tracking": {"intent_name": 100, "intent_category": 50},
    "user_feedback": {"user_id": 64, "session_id": 36},
}

# Unique keys (primary keys on ``id`` are implied).
UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "admins": [["username"]],
    "profiles": [["user_id"]],
    "waste_categories": [["category_name"]],
    "ai_detection_mapping": [["coco_class"]],
    "leaderboard_cache": [["user_id"]],
    "daily_analytics": [["date"]],
    "admin_sessions": [["session_token"]],
    "admin_performance_metrics": [["admin_id", "date"]],
    "system_usage_stats": [["date"]],
    "feature_usage_tracking": [["admin_id", "feature_name"]],
    "chatbot_users": [["user_id"]],
    "user_preferences": [["user_id", "preference_key"]],
    "chat_sessions": [["session_id"]],
    "chat_analytics": [["date"]],
    "intent_tracking": [["intent_name"]],
}

# Fixed values: (child, column, parent, column, what a parent delete does).
FOREIGN_KEYS: list[tuple[str, str, str, str, str]] = [
    ("admin_audit", "admin_id", "admins", "id", "cascade"),
    ("ai_detection_mapping", "waste_category", "waste_categories", "category_name", "cascade"),
    ("admin_sessions", "admin_id", "admins", "id", "cascade"),
    ("admin_activity_log", "admin_id", "admins", "id", "cascade"),
    ("admin_activity_log", "session_id", "admin_sessions", "id", "set null"),
    ("admin_page_visits", "admin_id", "admins", "id", "cascade"),
    ("admin_page_visits", "session_id", "admin_sessions", "id", "set null"),
    ("admin_data_changes", "admin_id", "admins", "id", "cascade"),
    ("admin_data_changes", "session_id", "admin_sessions", "id", "set null"),
    ("admin_security_events", "admin_id", "admins", "id", "set null"),
    ("admin_security_events", "resolved_by", "admins", "id", "set null"),
    ("admin_performance_metrics", "admin_id", "admins", "id", "cascade"),
    ("system_usage_stats", "most_active_admin", "admins", "id", "set null"),
    ("feature_usage_tracking", "admin_id", "admins", "id", "cascade"),
    ("user_preferences", "user_id", "chatbot_users", "user_id", "cascade"),
    ("chat_sessions", "user_id", "chatbot_users", "user_id", "cascade"),
    ("chat_messages", "session_id", "chat_sessions", "session_id", "cascade"),
    ("chat_messages", "user_id", "chatbot_users", "user_id", "cascade"),
    ("user_activity_log", "user_id", "chatbot_users", "user_id", "cascade"),
    ("user_feedback", "user_id", "chatbot_users", "user_id", "cascade"),
    ("user_feedback", "message_id", "chat_messages", "id", "set null"),
]

# Enum domains in ordinal order.
ENUMS: dict[tuple[str, str], list[str]] = {
    ("admin_page_visits", "device_type"): ["desktop", "tablet", "mobile"],
    ("admin_data_changes", "operation_type"): ["INSERT", "UPDATE", "DELETE"],
    ("admin_security_events", "event_severity"): ["LOW", "MEDIUM", "HIGH", "CRITICAL"],
    ("chat_messages", "message_type"): ["user", "bot", "system"],
    ("user_feedback", "feedback_type"): ["positive", "negative", "neutral"],
}

# Column defaults applied on ingest.
DEFAULTS: dict[str, dict[str, object]] = {
    "profiles": {"eco_points": 0, "total_waste_deposited": 0},
    "transactions": {"type": "waste_deposit"},
    "waste_categories": {"is_active": True},
    "ai_detection_mapping": {"confidence_threshold": 0.35, "is_active": True},
    "rewards": {"is_active": True},
    "admins": {"is_active": True},
    "admin_sessions": {"is_active": True, "session_duration": 0},
    "admin_activity_log": {"execution_time_ms": 0},
    "admin_page_visits": {"visit_duration": 0},
    "admin_security_events": {"is_resolved": False},
    "admin_performance_metrics": {
        "total_login_time": 0,
        "total_activities": 0,
        "total_page_views": 0,
        "avg_session_duration": 0,
        "error_count": 0,
        "success_rate": 0,
    },
    "system_usage_stats": {
        "total_admin_logins": 0,
        "total_active_sessions": 0,
        "total_activities": 0,
        "total_page_views": 0,
        "peak_concurrent_users": 0,
        "avg_response_time_ms": 0,
        "error_rate": 0,
    },
    "daily_analytics": {
        "total_transactions": 0,
        "total_points_earned": 0,
        "total_points_redeemed": 0,
        "unique_users": 0,
        "waste_deposits": 0,
        "redemptions": 0,
    },
    "feature_usage_tracking": {"usage_count": 1, "total_time_spent": 0, "success_count": 0, "error_count": 0},
    "chatbot_users": {"timezone": "UTC", "language": "en", "is_active": True, "is_premium": False},
    "chat_sessions": {"is_active": True, "message_count": 0, "total_tokens_used": 0},
    "chat_messages": {"message_tokens": 0, "response_time_ms": 0},
    "ai_knowledge_base": {"priority": 0, "is_active": True, "usage_count": 0, "success_rate": 0},
    "chat_analytics": {
        "total_sessions": 0,
        "total_messages": 0,
        "unique_users": 0,
        "avg_session_duration": 0,
        "avg_messages_per_session": 0,
        "satisfaction_score": 0,
    },
    "intent_tracking": {"trigger_count": 0, "success_count": 0, "avg_confidence": 0},
    "user_feedback": {"is_resolved": False},
}

# Keys an ingest request must carry, per feed.
REQUIRED_FIELDS: dict[str, list[str]] = {
    "login": ["admin_id"],
    "logout": ["session_id", "admin_id"],
    "activity": ["activity_type", "activity_category", "description"],
    "page_visit": ["page_name", "page_url"],
    "security_event": ["event_type", "event_severity", "event_description"],
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])
