"""The same queries as SQL for the checking engine.

Written independently of the Spark plans: plain joins, windows and subqueries over
the raw tables. ``BASE`` holds the projections that give the test tables the
declared shape; a query names the ones it needs.
"""

from __future__ import annotations

import re

from tallyforge.harness.fixtures import USER_AGENTS

_AGENT_CASES = " ".join(f"WHEN {i} THEN '{agent}'" for i, agent in enumerate(USER_AGENTS))

# Order matters: a projection may use the ones above it.
BASE: dict[str, str] = {
    "ev": "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events",
    "admins": """
        SELECT c_custkey AS id, c_name AS username,
               CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'FURNITURE' THEN ''
                    ELSE 'Admin ' || c_custkey END AS display_name,
               c_mktsegment <> 'MACHINERY' AS is_active
        FROM customer WHERE c_acctbal >= 0""",
    "activity_log": """
        SELECT event_id AS id, user_id AS admin_id, event_type AS activity_type,
               CASE WHEN event_type IN ('click', 'view') THEN 'NAVIGATION' WHEN event_type = 'purchase' THEN 'DATA'
                    WHEN event_type = 'signup' THEN 'USER' ELSE 'SYSTEM' END AS activity_category,
               event_type || ' #' || k AS activity_description,
               CASE WHEN k % 7 <> 0 THEN 'feature_' || (k % 10) END AS target_resource,
               CAST(k AS VARCHAR) AS target_id, '10.0.0.' || k AS ip_address,
               CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 500 WHEN event_type = 'error' THEN 404
                    WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 302 ELSE 200 END AS response_status,
               CAST(floor(value) AS INT) AS execution_time_ms, ts AS created_at
        FROM ev""",
    "sessions": """
        SELECT event_id AS id, user_id AS admin_id, 'sess_' || event_id AS session_token, '10.0.0.' || k AS ip_address,
               ts AS login_time, CASE WHEN k % 3 <> 0 THEN ts + stay * INTERVAL 1 SECOND END AS logout_time,
               k % 3 = 0 AS is_active, CASE WHEN k % 3 = 0 THEN 0 ELSE stay END AS session_duration
        FROM (SELECT *, CAST(CASE k % 50 WHEN 1 THEN floor(value * 10) + 200000 WHEN 2 THEN 0 ELSE floor(value * 10) END
                             AS INT) AS stay
              FROM ev WHERE event_type = 'signup')""",
    "page_view_rows": f"""
        SELECT event_id AS id, user_id AS admin_id, 'page_' || (k % 5) AS page_name, '/app/page_' || (k % 5) AS page_url,
               CAST(floor(value) AS INT) AS visit_duration,
               CASE k % 6 {_AGENT_CASES} END AS user_agent,
               CASE k % 3 WHEN 0 THEN 375 WHEN 1 THEN 800 ELSE 1920 END AS width, ts AS created_at
        FROM ev WHERE event_type = 'view'""",
    "security": """
        SELECT event_id AS id, user_id AS admin_id, 'TYPE_' || (k % 3) AS event_type,
               CASE k % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS event_severity,
               'event ' || k AS event_description, '10.0.0.' || k AS ip_address,
               CASE WHEN k % 5 = 0 THEN NULL ELSE k % 5 <= 2 END AS is_resolved,
               CASE WHEN k % 5 IN (1, 2) THEN ts + INTERVAL 1 HOUR END AS resolved_at, ts AS created_at
        FROM ev WHERE event_type = 'error'""",
    "profiles": """
        SELECT CAST(c_custkey AS VARCHAR) AS user_id,
               CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_name || '@example.com' END AS email,
               CASE WHEN c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD') THEN c_name END AS display_name,
               CAST(floor(c_acctbal) AS INT) AS eco_points,
               TIMESTAMP '2023-01-01 00:00:00' + (c_custkey % 365) * INTERVAL 1 DAY AS joined_at
        FROM customer""",
    "tx": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS seq,
               CAST(CASE WHEN o_custkey % 50 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS VARCHAR) AS user_id,
               CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN -floor(o_totalprice / 1000)
                    ELSE floor(o_totalprice / 1000) END AS INT) AS points,
               CASE WHEN o_orderstatus = 'F' THEN 'redeem' ELSE 'waste_deposit' END AS type,
               CASE WHEN o_orderstatus = 'F' THEN 'Redeem: Free Coffee' WHEN o_orderpriority = '1-URGENT' THEN 'plastic'
                    WHEN o_orderpriority = '2-HIGH' THEN 'paper' WHEN o_orderpriority = '3-MEDIUM' THEN 'steel'
                    WHEN o_orderpriority = '5-LOW' THEN 'organic' END AS waste_category,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'name ' || o_orderkey END AS new_name,
               CASE WHEN o_orderstatus = 'P' THEN o_orderkey || '@feed.example' END AS new_email,
               o_orderdate AS ts
        FROM orders""",
    "categories": "SELECT * FROM (VALUES ('plastic', 10), ('paper', 5), ('steel', 15), ('organic', 8)) "
    "AS c(category_name, points_value)",
    "rewards": """
        SELECT 'r-' || p_partkey AS id, p_name AS title, CAST(floor(p_retailprice) AS INT) AS cost_points,
               p_size > 10 AS is_active
        FROM part""",
    "chat_sessions": """
        SELECT conv_id AS id, 'c' || conv_id AS session_id, CAST(conv_id % 10 AS VARCHAR) AS user_id,
               TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR AS started_at,
               CASE WHEN conv_id % 5 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00'
                    + (conv_id * 3600 + max(turn) * 90) * INTERVAL 1 SECOND END AS ended_at
        FROM conversations GROUP BY conv_id""",
    "chat_messages": """
        SELECT conv_id * 1000 + turn AS id, 'c' || conv_id AS session_id, CAST(conv_id % 10 AS VARCHAR) AS user_id,
               CASE role WHEN 'assistant' THEN 'bot' ELSE role END AS message_type, text AS message_content,
               CASE WHEN role = 'assistant' THEN length(text) % 500 ELSE 0 END AS response_time_ms,
               CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 <> 0 THEN (conv_id + turn) % 5 + 1 END AS user_rating,
               CASE WHEN role = 'assistant' THEN CASE (conv_id + turn) % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END
                    END AS is_helpful,
               CASE WHEN role <> 'user' THEN CASE length(text) % 4 WHEN 0 THEN 'earn_points' WHEN 1 THEN 'recycling'
                    WHEN 2 THEN 'rewards' END END AS intent_category,
               CAST((length(text) % 100) / 100 AS DECIMAL(3,2)) AS confidence_score,
               TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 3600 + turn * 90) * INTERVAL 1 SECOND AS created_at
        FROM conversations""",
    "chat_days": """
        SELECT CAST(s.started_at AS DATE) AS date, count(*) AS sessions, CAST(sum(coalesce(m.n, 0)) AS BIGINT) AS messages,
               count(DISTINCT s.user_id) AS unique_users,
               round(avg(date_sub('second', s.started_at, coalesce(s.ended_at, TIMESTAMP '2024-01-31 12:00:00'))), 4)
                   AS avg_session_duration,
               round(sum(m.rating_sum) / sum(m.rated), 4) AS avg_satisfaction
        FROM chat_sessions s
        LEFT JOIN (SELECT session_id, count(*) AS n, sum(user_rating) AS rating_sum, count(user_rating) AS rated
                   FROM chat_messages GROUP BY 1) m ON m.session_id = s.session_id
        GROUP BY 1""",
    "chat_users": """
        SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name || '@example.com' AS email, c_name AS display_name
        FROM customer WHERE c_acctbal >= 0""",
    "feedback": """
        SELECT id, user_id, user_rating AS rating, id % 2 = 0 AS is_resolved,
               CASE WHEN user_rating >= 4 THEN 'positive' WHEN user_rating <= 2 THEN 'negative' ELSE 'neutral' END
                    AS feedback_type
        FROM chat_messages WHERE user_rating IS NOT NULL""",
    "detections": """
        SELECT l_orderkey AS order_id, l_linenumber AS line, p_type AS coco_class,
               CAST(l_discount * 10 AS DECIMAL(3,2)) AS confidence
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "user_feed": """
        SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS user_id,
               CASE WHEN o_orderstatus = 'P' THEN o_orderkey || '@feed.example' END AS email,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'name ' || o_orderkey END AS display_name,
               CASE WHEN o_orderpriority = '2-HIGH' THEN 'first ' || o_orderkey END AS first_name,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'last ' || o_orderkey END AS last_name,
               CASE WHEN o_orderpriority = '5-LOW' THEN '+' || o_orderkey END AS phone,
               o_orderdate AS ts
        FROM orders""",
    "requests": """
        SELECT event_id AS id, 'sess_' || (event_id - k % 4) AS session_token,
               CASE WHEN k % 17 <> 0 THEN event_type END AS activity_type,
               CASE WHEN event_type IN ('click', 'view') THEN 'NAVIGATION' ELSE 'DATA' END AS activity_category,
               CASE WHEN k % 2 = 0 OR k % 19 <> 0 THEN 'did ' || event_type END AS description,
               CASE WHEN k % 7 <> 0 THEN 'feature_' || (k % 10) END AS target_resource,
               CASE WHEN k % 5 <> 0 THEN CAST(floor(value) AS INT) END AS execution_time_ms,
               CAST(k AS VARCHAR) AS target_id, CASE WHEN k % 6 <> 0 THEN '10.1.0.' || k END AS ip_address,
               CASE WHEN event_type = 'error' THEN 500 WHEN k % 11 <> 0 THEN 200 END AS response_status,
               CASE WHEN k % 4 = 1 THEN props END AS additional_data, ts
        FROM ev""",
    "logouts": """
        SELECT event_id + CASE WHEN k % 9 = 0 THEN 1000000000 ELSE 0 END AS session_id,
               user_id + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS admin_id,
               ts + CAST(floor(value * 10) AS INT) * INTERVAL 1 SECOND AS ts
        FROM ev WHERE event_type = 'signup'""",
    # rule: the first event of a key adds no time
    "usage_events": """
        SELECT *, row_number() OVER (PARTITION BY admin_id, target_resource ORDER BY created_at, id) AS rn
        FROM activity_log WHERE target_resource IS NOT NULL""",
    "feature_usage": """
        SELECT admin_id, target_resource AS feature_name,
               max(CASE WHEN rn = 1 THEN activity_category END) AS feature_category,
               count(*) AS usage_count, max(created_at) AS last_used_at,
               CAST(sum(CASE WHEN rn > 1 THEN coalesce(execution_time_ms, 0) ELSE 0 END) AS BIGINT) AS total_time_spent,
               count(*) FILTER (WHERE response_status >= 200 AND response_status < 300) AS success_count,
               count(*) FILTER (WHERE response_status >= 400) AS error_count
        FROM usage_events GROUP BY 1, 2""",
    "perf_keys": """
        SELECT DISTINCT admin_id, date FROM (
            SELECT admin_id, CAST(login_time AS DATE) AS date FROM sessions
            UNION ALL SELECT admin_id, CAST(created_at AS DATE) FROM activity_log
            UNION ALL SELECT admin_id, CAST(created_at AS DATE) FROM page_view_rows)""",
    "perf_feature": """
        SELECT admin_id, date, feature FROM (
            SELECT admin_id, CAST(created_at AS DATE) AS date, target_resource AS feature,
                   row_number() OVER (PARTITION BY admin_id, CAST(created_at AS DATE)
                                      ORDER BY count(*) DESC, target_resource) AS rn
            FROM activity_log WHERE target_resource IS NOT NULL GROUP BY 1, 2, 3) WHERE rn = 1""",
    "performance": """
        SELECT p.admin_id, p.date, coalesce(s.login_time, 0) AS total_login_time, coalesce(l.n, 0) AS total_activities,
               coalesce(v.n, 0) AS total_page_views, coalesce(s.avg_time, 0) AS avg_session_duration,
               f.feature AS most_used_feature, coalesce(l.bad, 0) AS error_count,
               CASE WHEN coalesce(l.n, 0) > 0 THEN round(l.ok / l.n * 100, 2) ELSE 0.0 END AS success_rate
        FROM perf_keys p
        LEFT JOIN (SELECT admin_id, CAST(login_time AS DATE) AS date, CAST(sum(session_duration) AS BIGINT) AS login_time,
                          CAST(round(avg(session_duration)) AS BIGINT) AS avg_time
                   FROM sessions GROUP BY 1, 2) s ON s.admin_id = p.admin_id AND s.date = p.date
        LEFT JOIN (SELECT admin_id, CAST(created_at AS DATE) AS date, count(*) AS n,
                          count(*) FILTER (WHERE response_status BETWEEN 200 AND 299) AS ok,
                          count(*) FILTER (WHERE response_status >= 400) AS bad
                   FROM activity_log GROUP BY 1, 2) l ON l.admin_id = p.admin_id AND l.date = p.date
        LEFT JOIN (SELECT admin_id, CAST(created_at AS DATE) AS date, count(*) AS n
                   FROM page_view_rows GROUP BY 1, 2) v ON v.admin_id = p.admin_id AND v.date = p.date
        LEFT JOIN perf_feature f ON f.admin_id = p.admin_id AND f.date = p.date""",
    # a calendar, and the sessions that overlap each day's start and each second with a login
    "spans": """
        SELECT date_trunc('second', login_time) AS opened, coalesce(date_trunc('second', logout_time), TIMESTAMP '9999-01-01')
                   AS closed, logout_time
        FROM sessions""",
    "calendar": """
        SELECT CAST(unnest(generate_series(
            (SELECT min(CAST(opened AS DATE)) FROM spans),
            (SELECT max(greatest(CAST(opened AS DATE), coalesce(CAST(logout_time AS DATE), CAST(opened AS DATE)))) FROM spans),
            INTERVAL 1 DAY)) AS DATE) AS date""",
    "instants": """
        SELECT moment, count(*) AS level FROM (SELECT DISTINCT opened AS moment FROM spans)
        JOIN spans ON opened <= moment AND closed >= moment GROUP BY moment""",
    "peaks": """
        SELECT date, CAST(greatest(
                   (SELECT count(*) FROM spans WHERE opened < date AND closed >= date),
                   coalesce((SELECT max(level) FROM instants WHERE CAST(moment AS DATE) = date), 0)) AS BIGINT)
                   AS peak_concurrent_users
        FROM calendar""",
    "rollup_days": """
        SELECT DISTINCT date FROM (
            SELECT CAST(login_time AS DATE) AS date FROM sessions
            UNION ALL SELECT CAST(created_at AS DATE) FROM activity_log
            UNION ALL SELECT CAST(created_at AS DATE) FROM page_view_rows
            UNION ALL SELECT CAST(last_used_at AS DATE) FROM feature_usage)""",
    "daily_rollup_rows": """
        SELECT d.date,
               (SELECT count(*) FROM sessions s WHERE CAST(s.login_time AS DATE) = d.date) AS total_admin_logins,
               (SELECT count(*) FROM activity_log l WHERE CAST(l.created_at AS DATE) = d.date) AS total_activities,
               (SELECT count(*) FROM page_view_rows v WHERE CAST(v.created_at AS DATE) = d.date) AS total_page_views,
               a.admin_id AS most_active_admin, f.feature_name AS most_used_feature
        FROM rollup_days d
        LEFT JOIN (SELECT CAST(created_at AS DATE) AS date, admin_id,
                          row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY count(*) DESC, admin_id) AS rn
                   FROM activity_log GROUP BY 1, 2) a ON a.date = d.date AND a.rn = 1
        LEFT JOIN (SELECT CAST(last_used_at AS DATE) AS date, feature_name,
                          row_number() OVER (PARTITION BY CAST(last_used_at AS DATE)
                                             ORDER BY sum(usage_count) DESC, feature_name) AS rn
                   FROM feature_usage GROUP BY 1, 2) f ON f.date = d.date AND f.rn = 1""",
    "log_days": """
        SELECT CAST(created_at AS DATE) AS date, CAST(round(avg(execution_time_ms)) AS BIGINT) AS avg_ms,
               round(count(*) FILTER (WHERE response_status >= 400) / count(*) * 100, 2) AS error_rate
        FROM activity_log GROUP BY 1""",
    "system_rows": """
        SELECT coalesce(r.date, p.date) AS date, coalesce(r.total_admin_logins, 0) AS total_admin_logins,
               (SELECT count(*) FROM sessions s WHERE s.is_active AND CAST(s.login_time AS DATE) = coalesce(r.date, p.date))
                   AS total_active_sessions,
               coalesce(r.total_activities, 0) AS total_activities, coalesce(r.total_page_views, 0) AS total_page_views,
               coalesce(p.peak_concurrent_users, 0) AS peak_concurrent_users, coalesce(l.avg_ms, 0) AS avg_response_time_ms,
               coalesce(l.error_rate, 0.0) AS error_rate, r.most_active_admin, r.most_used_feature
        FROM daily_rollup_rows r FULL JOIN peaks p ON p.date = r.date
        LEFT JOIN log_days l ON l.date = coalesce(r.date, p.date)""",
    "profiles_after": """
        SELECT coalesce(p.user_id, f.user_id) AS user_id, coalesce(f.email, p.email) AS email,
               coalesce(f.display_name, p.display_name) AS display_name,
               CAST(coalesce(p.eco_points, 0) + coalesce(f.delta, 0) AS BIGINT) AS eco_points,
               coalesce(p.joined_at, f.first_ts) AS joined_at
        FROM profiles p FULL JOIN (
            SELECT user_id, sum(points) AS delta, min(ts) AS first_ts,
                   first(new_name ORDER BY ts DESC, seq DESC) FILTER (WHERE new_name IS NOT NULL) AS display_name,
                   first(new_email ORDER BY ts DESC, seq DESC) FILTER (WHERE new_email IS NOT NULL) AS email
            FROM tx GROUP BY 1) f ON f.user_id = p.user_id""",
}


def with_base(body: str) -> str:
    """Prefix a query with the projections it uses, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in BASE:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(BASE[name])

    visit(body)
    parts = [f"{name} AS ({BASE[name].strip()})" for name in BASE if name in needed]
    body = body.strip()
    if not parts:
        return body
    if body.startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[len('WITH '):]}"
    return f"WITH {', '.join(parts)} {body}"


START, END = "DATE '2024-01-13'", "DATE '2024-01-20'"
DAY = "DATE '2024-01-15'"
AS_OF = "TIMESTAMP '2024-01-31 12:00:00'"


def _days(column: str, start: str = START, end: str = END) -> str:
    return f"CAST({column} AS DATE) BETWEEN {start} AND {end}"


def _admin_summary(total: str) -> str:
    return f"""
        SELECT a.id AS admin_id, a.username, a.display_name, coalesce(s.n, 0) AS total_sessions,
               {total} AS total_activities, s.last_login, s.avg_time AS avg_session_duration,
               coalesce(s.days, 0) AS active_days, coalesce(l.types, 0) AS unique_activity_types
        FROM admins a
        LEFT JOIN (SELECT admin_id, count(*) AS n, max(login_time) AS last_login, round(avg(session_duration), 4) AS avg_time,
                          count(DISTINCT CAST(login_time AS DATE)) AS days FROM sessions GROUP BY 1) s ON s.admin_id = a.id
        LEFT JOIN (SELECT admin_id, count(*) AS n, count(DISTINCT activity_type) AS types
                   FROM activity_log GROUP BY 1) l ON l.admin_id = a.id"""


def _daily_log(where: str) -> str:
    return f"""
        SELECT CAST(created_at AS DATE) AS date, count(*) AS total_activities, count(DISTINCT admin_id) AS unique_admins,
               count(DISTINCT activity_type) AS unique_activity_types, round(avg(execution_time_ms), 4) AS avg_execution_time
        FROM activity_log WHERE {where} GROUP BY 1"""


def _security_counts(where: str) -> str:
    return f"""
        SELECT event_type, event_severity, count(*) AS event_count,
               count(*) FILTER (WHERE is_resolved) AS resolved_count, count(*) FILTER (WHERE NOT is_resolved) AS pending_count
        FROM security WHERE {where} GROUP BY 1, 2"""


def _recent_security(where: str, k: int) -> str:
    return f"""
        SELECT id, event_type, event_severity, event_description, ip_address, is_resolved, created_at, resolved_at,
               lower(event_severity) AS severity_class,
               CASE WHEN is_resolved THEN 'Resolved' ELSE 'Pending' END AS status_label,
               strftime(created_at, '%b %-d, %H:%M') AS shown_time
        FROM security WHERE {where} ORDER BY created_at DESC, id DESC LIMIT {k}"""


def _feature_usage(where: str) -> str:
    return f"""
        SELECT feature_name, feature_category, count(DISTINCT admin_id) AS unique_users,
               CAST(sum(usage_count) AS BIGINT) AS total_usage, round(avg(usage_count), 4) AS avg_usage_per_user,
               CAST(sum(total_time_spent) AS BIGINT) AS total_time_spent,
               CAST(sum(success_count) AS BIGINT) AS total_successes, CAST(sum(error_count) AS BIGINT) AS total_errors,
               round(sum(success_count) / nullif(sum(success_count) + sum(error_count), 0) * 100, 4) AS success_rate
        FROM feature_usage WHERE {where} GROUP BY 1, 2"""


_SECONDS = f"date_sub('second', s.started_at, coalesce(s.ended_at, {AS_OF}))"


_DAILY_STATS = """
    SELECT CAST(ts AS DATE) AS date, count(*) AS total_transactions,
           CAST(sum(CASE WHEN points > 0 THEN points ELSE 0 END) AS BIGINT) AS total_points_earned,
           CAST(sum(CASE WHEN points < 0 THEN abs(points) ELSE 0 END) AS BIGINT) AS total_points_redeemed,
           count(DISTINCT user_id) AS unique_users, count(*) FILTER (WHERE type = 'waste_deposit') AS waste_deposits,
           count(*) FILTER (WHERE type = 'redeem') AS redemptions
    FROM tx GROUP BY 1"""


def _transactions(extra: str) -> str:
    return f"""
        SELECT t.id, t.user_id, coalesce(p.display_name, p.email, t.user_id) AS user_name, t.points, t.type,
               t.waste_category, t.ts AS "timestamp", CAST(t.ts AS DATE) AS date_only{extra}
        FROM tx t LEFT JOIN profiles p ON t.user_id = p.user_id"""


def _ranked(name: str, points: str, extra: str = "", tail: str = "") -> str:
    return f"""
        SELECT coalesce(display_name, email, user_id) AS {name}, eco_points AS {points}, user_id{extra},
               row_number() OVER (ORDER BY eco_points DESC, joined_at, user_id) AS rank_position
        FROM profiles WHERE eco_points > 0 {tail}"""


_OVERVIEW = f"""
    SELECT (SELECT count(*) FROM sessions WHERE {_days('login_time')}) AS total_sessions,
           (SELECT count(DISTINCT admin_id) FROM sessions WHERE {_days('login_time')}) AS unique_admins,
           (SELECT round(avg(session_duration), 4) FROM sessions
            WHERE {_days('login_time')} AND session_duration > 0) AS avg_session_duration,
           (SELECT count(*) FROM activity_log WHERE {_days('created_at')}) AS total_activities,
           (SELECT count(*) FROM page_view_rows WHERE {_days('created_at')}) AS total_page_views,
           (SELECT count(*) FROM security WHERE {_days('created_at')}) AS security_events,
           a.username AS most_active_admin, a.n AS most_active_count,
           f.feature_name AS most_used_feature, CAST(f.n AS BIGINT) AS most_used_count
    FROM (SELECT a.username, count(*) AS n FROM activity_log l JOIN admins a ON a.id = l.admin_id
          WHERE {_days('l.created_at')} GROUP BY l.admin_id, a.username ORDER BY n DESC, a.username LIMIT 1) a
    FULL JOIN (SELECT feature_name, sum(usage_count) AS n FROM feature_usage WHERE {_days('last_used_at')}
               GROUP BY 1 ORDER BY n DESC, feature_name LIMIT 1) f ON TRUE"""

_PERFORMANCE_DAY = f"""
    SELECT p.admin_id, a.username, a.display_name, p.date, p.total_login_time, p.total_activities, p.total_page_views,
           p.avg_session_duration, p.success_rate, p.error_count
    FROM performance p JOIN admins a ON a.id = p.admin_id WHERE p.date = {DAY}"""


def _clock(column: str) -> str:
    s = f"({column} % 86400)"
    return f"printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60)"


def _top_list(columns: str, source: str, where: str, ts: str, k: int) -> str:
    return f"""
        SELECT {columns} FROM {source} t JOIN admins a ON a.id = t.admin_id WHERE {where}
        ORDER BY t.{ts} DESC, t.id DESC LIMIT {k}"""


_SHOWN_NAME = "CASE WHEN a.display_name IS NOT NULL AND a.display_name NOT IN ('', '0') THEN a.display_name ELSE a.username END"

_JSON_COUNT = "'{{\"count\":' || {0} || '}}'"


def _metric(name: str, value: str) -> str:
    return f"SELECT '{name}' AS metric, {value} AS value FROM o"


_OVERVIEW_LONG = (
    f"SELECT * FROM (WITH o AS MATERIALIZED ({_OVERVIEW}) "
    + " UNION ALL ".join(
        [
            _metric(m, _JSON_COUNT.format(m))
            for m in ("total_sessions", "unique_admins", "total_activities", "total_page_views", "security_events")
        ]
        + [
            _metric("avg_session_duration", "'{\"avg_duration\":' || avg_session_duration || '}'"),
            _metric(
                "most_active_admin",
                "'{\"username\":\"' || most_active_admin || '\",\"activity_count\":' || most_active_count || '}'",
            ),
            _metric(
                "most_used_feature",
                "'{\"feature_name\":\"' || most_used_feature || '\",\"total_usage\":' || most_used_count || '}'",
            ),
        ]
    )
    + ")"
)

_BROWSER = (
    "CASE WHEN contains(user_agent, 'Chrome') THEN 'Chrome' WHEN contains(user_agent, 'Firefox') THEN 'Firefox' "
    "WHEN contains(user_agent, 'Safari') THEN 'Safari' WHEN contains(user_agent, 'Edge') THEN 'Edge' ELSE 'Unknown' END"
)
_OS = (
    "CASE WHEN contains(user_agent, 'Windows') THEN 'Windows' WHEN contains(user_agent, 'Mac') THEN 'macOS' "
    "WHEN contains(user_agent, 'Linux') THEN 'Linux' WHEN contains(user_agent, 'Android') THEN 'Android' "
    "WHEN contains(user_agent, 'iOS') THEN 'iOS' ELSE 'Unknown' END"
)
_BROWSER_CORRECTED = (
    "CASE WHEN regexp_matches(user_agent, 'Edge?/') THEN 'Edge' WHEN contains(user_agent, 'Firefox') THEN 'Firefox' "
    "WHEN contains(user_agent, 'Chrome') THEN 'Chrome' WHEN contains(user_agent, 'Safari') THEN 'Safari' ELSE 'Unknown' END"
)
_OS_CORRECTED = (
    "CASE WHEN regexp_matches(user_agent, 'iPhone|iPad') THEN 'iOS' WHEN contains(user_agent, 'Android') THEN 'Android' "
    "WHEN contains(user_agent, 'Windows') THEN 'Windows' WHEN contains(user_agent, 'Mac') THEN 'macOS' "
    "WHEN contains(user_agent, 'Linux') THEN 'Linux' ELSE 'Unknown' END"
)


def _presets() -> str:
    rows = [
        ("1d", "2024-01-19"),
        ("7d", "2024-01-13"),
        ("30d", "2023-12-21"),
        ("90d", "2023-10-22"),
        ("1y", "2023-01-20"),
        ("other", "2024-01-13"),
    ]
    values = ", ".join(f"('{p}', DATE '{s}', {END})" for p, s in rows)
    return f"""
        SELECT r.preset, r.start_date, r.end_date, count(l.id) AS activities
        FROM (VALUES {values}) AS r(preset, start_date, end_date)
        LEFT JOIN activity_log l ON CAST(l.created_at AS DATE) BETWEEN r.start_date AND r.end_date
        GROUP BY 1, 2, 3"""


def _table_counts() -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS count FROM {source}" for t, source in _NAMED.items())


_ACCEPTED = """
    SELECT r.*, s.id AS session_id, s.admin_id, a.username
    FROM requests r JOIN sessions s ON s.session_token = r.session_token AND s.is_active JOIN admins a ON a.id = s.admin_id"""


def _duplicates(table: str, source: str, keys: list[str]) -> str:
    columns = ", ".join(keys)
    return f"""
        SELECT '{table}' AS table_name, '{",".join(keys)}' AS key_columns, count(*) FILTER (WHERE n > 1) AS duplicate_keys,
               CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows
        FROM (SELECT {columns}, count(*) AS n FROM {source} GROUP BY {columns})"""


def _orphans(child: str, source: str, column: str, parent: str, parent_source: str, parent_column: str) -> str:
    return f"""
        SELECT '{child}' AS child, '{column}' AS child_column, '{parent}' AS parent,
               count(DISTINCT c.{column}) AS orphan_keys, count(*) AS orphan_rows
        FROM {source} c WHERE c.{column} IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM {parent_source} p WHERE p.{parent_column} = c.{column})"""


def _enum(table: str, source: str, column: str, domain: list[str]) -> str:
    listed = ", ".join(f"'{v}'" for v in domain)
    return f"""
        SELECT '{table}' AS table_name, '{column}' AS column_name, {column} AS value, count(*) AS row_count
        FROM {source} WHERE {column} NOT IN ({listed}) GROUP BY {column}"""


def _column_check(table: str, source: str, column: str, longest: int | None, required: bool) -> str:
    missing = f"count(*) FILTER (WHERE {column} IS NULL)" if required else "CAST(0 AS BIGINT)"
    too_long = f"count(*) FILTER (WHERE length({column}) > {longest})" if longest else "CAST(0 AS BIGINT)"
    return f"""
        SELECT '{table}' AS table_name, '{column}' AS column_name, {missing} AS null_rows,
               {too_long} AS too_long_rows FROM {source}"""


# the test tables' sources by the names they stand for
_NAMED = {
    "admins": "admins",
    "admin_sessions": "sessions",
    "admin_activity_log": "activity_log",
    "admin_page_visits": "page_view_rows",
    "admin_security_events": "security",
    "feature_usage_tracking": "feature_usage",
    "admin_performance_metrics": "performance",
    "profiles": "profiles",
    "transactions": "tx",
    "waste_categories": "categories",
    "ai_detection_mapping": "(SELECT * FROM (VALUES ('MEDIUM', 'plastic'), ('PROMO', 'paper'), ('SMALL', 'steel'), "
    "('STANDARD', 'organic')) AS m(coco_class, waste_category))",
    "rewards": "rewards",
    "daily_analytics": "(SELECT DISTINCT CAST(ts AS DATE) AS date FROM tx)",
    "chatbot_users": "chat_users",
    "user_preferences": "(SELECT CAST(c_custkey AS VARCHAR) AS user_id, unnest(['segment', 'nation']) AS preference_key FROM customer)",
    "chat_sessions": "chat_sessions",
    "chat_messages": "chat_messages",
    "user_feedback": "(SELECT *, id AS message_id FROM feedback)",
    "ai_knowledge_base": "(SELECT * FROM (VALUES ('earn_points', 10), ('recycling', 10), ('ai_detection', 9), ('rewards', 8), "
    "('environment', 7)) AS b(category, priority))",
}
_KEYS = [
    ("admins", "id"), ("admins", "username"), ("admin_sessions", "id"), ("admin_sessions", "session_token"),
    ("admin_activity_log", "id"), ("admin_page_visits", "id"), ("admin_security_events", "id"),
    ("feature_usage_tracking", "admin_id,feature_name"), ("admin_performance_metrics", "admin_id,date"),
    ("profiles", "user_id"), ("transactions", "id"), ("waste_categories", "category_name"),
    ("ai_detection_mapping", "coco_class"), ("rewards", "id"), ("daily_analytics", "date"), ("chatbot_users", "user_id"),
    ("user_preferences", "user_id,preference_key"), ("chat_sessions", "id"), ("chat_sessions", "session_id"),
    ("chat_messages", "id"), ("user_feedback", "id"),
]
_LINKS = [
    ("ai_detection_mapping", "waste_category", "waste_categories", "category_name"),
    ("admin_sessions", "admin_id", "admins", "id"),
    ("admin_activity_log", "admin_id", "admins", "id"),
    ("admin_page_visits", "admin_id", "admins", "id"),
    ("admin_security_events", "admin_id", "admins", "id"),
    ("admin_performance_metrics", "admin_id", "admins", "id"),
    ("feature_usage_tracking", "admin_id", "admins", "id"),
    ("user_preferences", "user_id", "chatbot_users", "user_id"),
    ("chat_sessions", "user_id", "chatbot_users", "user_id"),
    ("chat_messages", "session_id", "chat_sessions", "session_id"),
    ("chat_messages", "user_id", "chatbot_users", "user_id"),
    ("user_feedback", "user_id", "chatbot_users", "user_id"),
    ("user_feedback", "message_id", "chat_messages", "id"),
]
_RAW_MESSAGES = (
    "(SELECT conv_id * 1000 + turn AS id, 'c' || conv_id AS session_id, CAST(conv_id % 10 AS VARCHAR) AS user_id, "
    "role AS message_type, CASE WHEN turn % 7 <> 3 THEN text END AS message_content, substr(text, 1, 150) AS intent_category "
    "FROM conversations)"
)
_RAW_SECURITY = (
    "(SELECT event_id AS id, 'TYPE_' || (k % 3) AS event_type, CASE WHEN k % 7 <> 0 THEN 'High' END AS event_severity, "
    "'event ' || k AS event_description, '10.2.0.' || k AS ip_address FROM ev)"
)

_REGISTRATIONS = """
    SELECT c_custkey AS id,
           CASE c_custkey % 7 WHEN 1 THEN 'ab' WHEN 2 THEN c_name ELSE replace(c_name, '#', '_') END AS username,
           CASE c_custkey % 7 WHEN 3 THEN 'no-at.example' WHEN 4 THEN 'a b@example.com'
                ELSE replace(c_name, '#', '.') || '@example.com' END AS email,
           CASE c_custkey % 7 WHEN 5 THEN ' A ' ELSE 'Customer' END AS first_name,
           CASE c_custkey % 7 WHEN 6 THEN NULL ELSE c_mktsegment END AS last_name
    FROM customer"""


def _registration() -> str:
    return f"""
        WITH r AS ({_REGISTRATIONS})
        SELECT id, 'first_name' AS field, 'too short' AS violation FROM r WHERE coalesce(length(trim(first_name)), 0) < 2
        UNION ALL SELECT id, 'last_name', 'too short' FROM r WHERE coalesce(length(trim(last_name)), 0) < 2
        UNION ALL SELECT id, 'username', 'too short' FROM r WHERE length(trim(username)) < 3
        UNION ALL SELECT id, 'username', 'invalid characters' FROM r
            WHERE length(trim(username)) >= 3 AND NOT regexp_matches(trim(username), '^[a-zA-Z0-9_]+$')
        UNION ALL SELECT id, 'email', 'invalid address' FROM r
            WHERE NOT regexp_matches(trim(email), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')"""


# A session runs while pauses stay within eight hours; pieces are 24 hours long.
_SESSIONIZE = """
    SELECT admin_id, min(ts) AS session_start, max(ts) AS session_end,
           CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS session_seconds,
           count(*) AS event_count
    FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY admin_id, grp)) // 86400000000 AS piece
          FROM (SELECT *, sum(opens) OVER (PARTITION BY admin_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp
                FROM (SELECT user_id AS admin_id, ts,
                             CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)
                                       <= 28800000000 THEN 0 ELSE 1 END AS opens
                      FROM events)))
    GROUP BY admin_id, grp, piece"""

_INTENT_MATCH = r"""
    WITH keywords(category, phrase, priority) AS (VALUES
            ('earn_points', 'thtion', 10), ('earn_points', 'thing', 10), ('earn_points', 'qu est ce', 10),
            ('earn_points', 'der die', 10), ('recycling', 'thble', 10), ('recycling', 'mente', 10),
            ('recycling', 'der', 10), ('recycling', 'la', 10), ('ai_detection', 'ering', 9),
            ('ai_detection', 'nicht', 9), ('ai_detection', 'des', 9), ('rewards', 'erble', 8), ('rewards', 'und', 8),
            ('rewards', 'de la', 8), ('rewards', 'the', 8), ('environment', 'el', 7), ('environment', 'les', 7),
            ('environment', 'des les', 7)),
         texts AS (
            SELECT id, ' ' || trim(regexp_replace(lower(message_content), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS words
            FROM chat_messages),
         found AS (
            SELECT t.id, k.category, k.priority, count(*) AS hits
            FROM texts t JOIN keywords k ON contains(t.words, ' ' || k.phrase || ' ') GROUP BY 1, 2, 3)
    SELECT id, category, hits FROM found
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, priority DESC, category) = 1"""

_CHANGES = """
    SELECT 'profiles' AS table_name, record_id, operation_type, field_name, old_value, new_value,
           CASE WHEN old_value IS NOT NULL THEN '{"' || field_name || '":' || quote || old_value || quote || '}' END AS old_values,
           CASE WHEN new_value IS NOT NULL THEN '{"' || field_name || '":' || quote || new_value || quote || '}' END AS new_values,
           operation_type || ' operation on profiles' AS activity_description
    FROM (
        SELECT coalesce(n.user_id, o.user_id) AS record_id, CASE WHEN o.user_id IS NULL THEN 'INSERT' ELSE 'UPDATE' END
                   AS operation_type, c.field_name, CASE WHEN c.field_name IN ('display_name', 'email') THEN '"' ELSE '' END AS quote,
               CASE c.field_name WHEN 'display_name' THEN nullif(o.display_name, '') WHEN 'email' THEN nullif(o.email, '')
                    WHEN 'is_rich' THEN CASE WHEN o.eco_points > 5000 THEN 'true' END
                    ELSE CAST(nullif(o.eco_points, 0) AS VARCHAR) END AS old_value,
               CASE c.field_name WHEN 'display_name' THEN nullif(n.display_name, '') WHEN 'email' THEN nullif(n.email, '')
                    WHEN 'is_rich' THEN CASE WHEN n.eco_points > 5000 THEN 'true' END
                    ELSE CAST(nullif(n.eco_points, 0) AS VARCHAR) END AS new_value,
               CASE c.field_name WHEN 'display_name' THEN n.display_name IS DISTINCT FROM o.display_name
                    WHEN 'email' THEN n.email IS DISTINCT FROM o.email
                    WHEN 'is_rich' THEN (n.eco_points > 5000) IS DISTINCT FROM (o.eco_points > 5000)
                    ELSE n.eco_points IS DISTINCT FROM o.eco_points END AS changed
        FROM profiles_after n LEFT JOIN profiles o ON o.user_id = n.user_id
        CROSS JOIN (VALUES ('display_name'), ('email'), ('eco_points'), ('is_rich')) AS c(field_name))
    WHERE changed"""

_LAST = "first({0} ORDER BY ts DESC, id DESC) FILTER (WHERE {0} IS NOT NULL)"

_USERS = f"""
    SELECT coalesce(u.user_id, f.user_id) AS user_id, coalesce(f.email, u.email) AS email,
           coalesce(f.display_name, u.display_name) AS display_name, f.first_name, f.last_name, f.phone,
           CASE WHEN u.user_id IS NOT NULL OR f.n > 1 THEN f.last_ts END AS last_active_at
    FROM chat_users u FULL JOIN (
        SELECT user_id, {_LAST.format('email')} AS email, {_LAST.format('display_name')} AS display_name,
               {_LAST.format('first_name')} AS first_name, {_LAST.format('last_name')} AS last_name,
               {_LAST.format('phone')} AS phone, count(*) AS n, max(ts) AS last_ts
        FROM user_feed GROUP BY 1) f ON f.user_id = u.user_id"""

_TOKEN = (
    "'sess_' || CAST(floor(epoch(login_time)) AS BIGINT) || '_' || admin_id || '_' || "
    "substr(md5(CAST(id AS VARCHAR)), 1, 16)"
)

_DAY_COUNTS = "SELECT admin_id, CAST(created_at AS DATE) AS date, count(*) AS total_activities FROM activity_log GROUP BY 1, 2"

_POINTS_COLUMNS = "SELECT user_id, email, display_name, eco_points, joined_at FROM profiles_after"

_FEATURE_COLUMNS = (
    "SELECT admin_id, feature_name, feature_category, usage_count, last_used_at, total_time_spent, success_count, "
    "error_count FROM feature_usage"
)

_SUMMARY_7D = f"""
    SELECT a.username, a.display_name, count(*) AS total_activities, count(DISTINCT CAST(l.created_at AS DATE)) AS active_days,
           round(avg(l.execution_time_ms), 4) AS avg_execution_time,
           count(*) FILTER (WHERE l.response_status >= 200 AND l.response_status < 300) AS success_count,
           count(*) FILTER (WHERE l.response_status >= 400) AS error_count,
           round(count(*) FILTER (WHERE l.response_status >= 200 AND l.response_status < 300) / count(*) * 100, 2)
               AS success_rate
    FROM activity_log l JOIN admins a ON a.id = l.admin_id WHERE {_days('l.created_at')}
    GROUP BY l.admin_id, a.username, a.display_name"""

_FEATURE_RANGE = _days("last_used_at", "DATE '2024-01-01'", "DATE '2024-01-31'")

_BODIES: dict[str, str] = {
    # the literal double join, which counts an activity once for each session
    "v_admin_activity_summary": """
        SELECT a.id AS admin_id, a.username, a.display_name, count(DISTINCT s.id) AS total_sessions,
               count(l.id) AS total_activities, max(s.login_time) AS last_login,
               round(avg(s.session_duration), 4) AS avg_session_duration,
               count(DISTINCT CAST(s.login_time AS DATE)) AS active_days, count(DISTINCT l.activity_type) AS unique_activity_types
        FROM admins a LEFT JOIN sessions s ON a.id = s.admin_id LEFT JOIN activity_log l ON a.id = l.admin_id
        GROUP BY a.id, a.username, a.display_name""",
    "v_admin_activity_summary_corrected": _admin_summary("coalesce(l.n, 0)"),
    "v_daily_admin_activity": """
        SELECT CAST(l.created_at AS DATE) AS date, a.username, a.display_name, count(l.id) AS activity_count,
               count(DISTINCT l.activity_type) AS unique_activities, count(DISTINCT l.target_resource) AS resources_accessed,
               CAST(sum(l.execution_time_ms) AS BIGINT) AS total_execution_time,
               round(avg(l.execution_time_ms), 4) AS avg_execution_time
        FROM activity_log l JOIN admins a ON l.admin_id = a.id
        GROUP BY CAST(l.created_at AS DATE), a.id, a.username, a.display_name""",
    "v_security_events_summary": """
        SELECT event_type, event_severity, count(*) AS event_count,
               count(CASE WHEN is_resolved THEN 1 END) AS resolved_count,
               count(CASE WHEN NOT is_resolved THEN 1 END) AS pending_count,
               min(created_at) AS first_occurrence, max(created_at) AS last_occurrence
        FROM security GROUP BY 1, 2""",
    "v_feature_usage_analytics": _feature_usage("TRUE"),
    "v_user_chat_summary": """
        SELECT u.user_id, u.display_name, u.email, count(DISTINCT s.id) AS total_sessions, count(m.id) AS total_messages,
               max(s.started_at) AS last_chat_at, round(avg(m.response_time_ms), 4) AS avg_response_time,
               round(avg(m.user_rating), 4) AS avg_rating
        FROM chat_users u LEFT JOIN chat_sessions s ON u.user_id = s.user_id
        LEFT JOIN chat_messages m ON s.session_id = m.session_id GROUP BY 1, 2, 3""",
    "v_daily_chat_analytics": f"""
        SELECT CAST(s.started_at AS DATE) AS date, count(DISTINCT s.id) AS sessions, count(m.id) AS messages,
               count(DISTINCT s.user_id) AS unique_users, round(avg({_SECONDS}), 4) AS avg_session_duration,
               round(avg(m.user_rating), 4) AS avg_satisfaction
        FROM chat_sessions s LEFT JOIN chat_messages m ON s.session_id = m.session_id GROUP BY 1""",
    "v_daily_chat_analytics_corrected": """
        SELECT date, sessions, messages, unique_users, avg_session_duration, avg_satisfaction FROM chat_days""",
    "v_intent_performance": """
        SELECT intent_category, count(*) AS total_occurrences,
               round(CAST(sum(confidence_score) AS DOUBLE) / count(confidence_score), 6) AS avg_confidence,
               round(avg(user_rating), 4) AS avg_rating, count(*) FILTER (WHERE is_helpful) AS helpful_count,
               round(count(*) FILTER (WHERE is_helpful) / count(*) * 100, 4) AS helpful_percentage
        FROM chat_messages WHERE intent_category IS NOT NULL GROUP BY 1""",
    "v_transaction_summary_v1": _transactions(""),
    "v_transaction_summary_v2": _transactions(", CASE WHEN t.points >= 0 THEN '+' ELSE '' END AS sign_display"),
    "v_leaderboard_v1": """
        SELECT coalesce(display_name, email, user_id) AS name, eco_points AS points, user_id, joined_at FROM profiles""",
    "v_leaderboard_v2": _ranked("name", "points", ", joined_at"),
    "leaderboard_top": _ranked("name", "points", ", joined_at", "ORDER BY rank_position LIMIT 5"),
    "leaderboard_rank": _ranked("display_name", "eco_points"),
    "leaderboard_refresh": _ranked("display_name", "eco_points"),
    "v_daily_stats": _DAILY_STATS,
    "v_category_stats_v1": """
        SELECT waste_category, count(*) AS count, CAST(sum(points) AS BIGINT) AS total_points,
               round(avg(points), 4) AS avg_points, count(DISTINCT user_id) AS unique_users
        FROM tx WHERE waste_category IS NOT NULL GROUP BY 1""",
    "v_category_stats_v2": """
        SELECT t.waste_category, count(*) AS transaction_count, CAST(sum(t.points) AS BIGINT) AS total_points,
               round(avg(t.points), 4) AS avg_points, count(DISTINCT t.user_id) AS unique_users,
               c.points_value AS category_points_value
        FROM tx t LEFT JOIN categories c ON t.waste_category = c.category_name
        WHERE t.waste_category IS NOT NULL GROUP BY t.waste_category, c.points_value""",
    "points_reconcile": """
        SELECT coalesce(p.user_id, l.user_id) AS user_id, p.eco_points AS profile_points, l.points AS ledger_points,
               CAST(coalesce(p.eco_points, 0) - coalesce(l.points, 0) AS BIGINT) AS difference
        FROM profiles p FULL JOIN (SELECT user_id, CAST(sum(points) AS BIGINT) AS points FROM tx GROUP BY 1) l
             ON l.user_id = p.user_id
        WHERE coalesce(p.eco_points, 0) <> coalesce(l.points, 0)""",
    "dashboard_counters": f"""
        SELECT (SELECT count(*) FROM sessions WHERE CAST(login_time AS DATE) = {DAY}) AS total_sessions,
               (SELECT count(*) FROM sessions WHERE CAST(login_time AS DATE) = {DAY} AND is_active) AS active_sessions,
               (SELECT count(*) FROM activity_log WHERE CAST(created_at AS DATE) = {DAY}) AS total_activities,
               (SELECT count(DISTINCT admin_id) FROM activity_log WHERE CAST(created_at AS DATE) = {DAY}) AS unique_admins,
               (SELECT count(*) FROM page_view_rows WHERE CAST(created_at AS DATE) = {DAY}) AS total_page_views,
               (SELECT count(*) FROM security WHERE CAST(created_at AS DATE) = {DAY}) AS security_events""",
    "daily_analytics": _daily_log(f"created_at >= {DAY} - INTERVAL 7 DAY"),
    "admin_analytics": f"""
        SELECT a.id AS admin_id, a.username, a.display_name, count(DISTINCT s.id) AS total_sessions,
               count(l.id) AS total_activities, round(avg(s.session_duration), 4) AS avg_session_duration,
               count(DISTINCT l.activity_type) AS unique_activity_types, max(s.login_time) AS last_login
        FROM admins a LEFT JOIN sessions s ON a.id = s.admin_id AND CAST(s.login_time AS DATE) = {DAY}
        LEFT JOIN activity_log l ON a.id = l.admin_id AND CAST(l.created_at AS DATE) = {DAY}
        GROUP BY a.id, a.username, a.display_name""",
    "security_day": _security_counts(_days("created_at", DAY, DAY)),
    "performance_filtered": _PERFORMANCE_DAY,
    "performance_banded": f"""
        SELECT p.admin_id, {_SHOWN_NAME} AS shown_name, p.total_activities, {_clock('p.total_login_time')} AS login_time,
               {_clock('p.avg_session_duration')} AS avg_session, printf('%.1f', round(p.success_rate, 1)) || '%' AS success_rate,
               CASE WHEN p.success_rate > 90 THEN 'green' WHEN p.success_rate > 70 THEN 'yellow' ELSE 'red' END AS rate_band,
               p.error_count
        FROM performance p JOIN admins a ON a.id = p.admin_id WHERE p.date = {DAY}""",
    "sessions_filtered": _top_list(
        "t.id, t.admin_id, t.session_token, t.ip_address, t.login_time, t.logout_time, t.is_active, t.session_duration, "
        "a.username, a.display_name",
        "sessions",
        "NOT t.is_active",
        "login_time",
        50,
    ),
    "activities_filtered": _top_list(
        "t.id, t.admin_id, t.activity_type, t.activity_category, t.activity_description, t.target_resource, t.target_id, "
        "t.ip_address, t.created_at, t.execution_time_ms, a.username, a.display_name",
        "activity_log",
        "t.activity_type = 'purchase'",
        "created_at",
        100,
    ),
    "security_filtered": """
        SELECT id, admin_id, event_type, event_severity, event_description, ip_address, is_resolved, created_at, resolved_at
        FROM security WHERE event_severity = 'CRITICAL' AND NOT is_resolved ORDER BY created_at DESC, id DESC LIMIT 100""",
    "recent_activities": _top_list(
        "t.id, t.activity_type, t.activity_category, t.activity_description, t.target_resource, t.created_at, "
        f"t.execution_time_ms, a.username, a.display_name, {_SHOWN_NAME} AS shown_name, "
        "strftime(t.created_at, '%H:%M') AS shown_time",
        "activity_log",
        "TRUE",
        "created_at",
        20,
    ),
    "recent_security": _recent_security("TRUE", 10),
    "report_recent_security": _recent_security(_days("created_at"), 50),
    "report_overview": _OVERVIEW,
    "report_overview_long": _OVERVIEW_LONG,
    "report_daily_trends": _daily_log(_days("created_at")),
    "report_activity_breakdown": f"""
        SELECT activity_type, activity_category, count(*) AS count, round(avg(execution_time_ms), 4) AS avg_execution_time
        FROM activity_log WHERE {_days('created_at')} GROUP BY 1, 2""",
    "report_admin_summary": _SUMMARY_7D,
    # an empty CSV field stands for both NULL and empty text
    "export_csv_roundtrip": f"SELECT * REPLACE (nullif(display_name, '') AS display_name) FROM ({_SUMMARY_7D})",
    "export_json_roundtrip": _daily_log(_days("created_at")),
    "report_security_events": _security_counts(_days("created_at")),
    "report_security_trends": f"""
        SELECT CAST(created_at AS DATE) AS date, count(*) AS total_events,
               count(*) FILTER (WHERE event_severity = 'CRITICAL') AS critical_events,
               count(*) FILTER (WHERE event_severity = 'HIGH') AS high_events,
               count(*) FILTER (WHERE is_resolved) AS resolved_events
        FROM security WHERE {_days('created_at')} GROUP BY 1""",
    "report_admin_performance": f"""
        SELECT a.username, a.display_name, round(avg(p.total_activities), 4) AS avg_activities,
               round(avg(p.total_login_time), 4) AS avg_login_time, round(avg(p.avg_session_duration), 4) AS avg_session_duration,
               round(CAST(sum(CAST(p.success_rate AS DECIMAL(5,2))) AS DOUBLE) / count(*), 6) AS avg_success_rate,
               round(avg(p.error_count), 4) AS avg_error_count, count(DISTINCT p.date) AS active_days
        FROM performance p JOIN admins a ON a.id = p.admin_id WHERE p.date BETWEEN {START} AND {END}
        GROUP BY p.admin_id, a.username, a.display_name""",
    "report_system_trends": f"""
        SELECT date, total_admin_logins, total_activities, total_page_views, avg_response_time_ms, error_rate
        FROM system_rows WHERE date BETWEEN {START} AND {END}""",
    "report_feature_usage": _feature_usage(_FEATURE_RANGE),
    "report_feature_trends": f"""
        SELECT CAST(last_used_at AS DATE) AS date, feature_name, CAST(sum(usage_count) AS BIGINT) AS daily_usage
        FROM feature_usage WHERE {_FEATURE_RANGE} GROUP BY 1, 2""",
    "report_feature_trends_corrected": f"""
        SELECT CAST(created_at AS DATE) AS date, target_resource AS feature_name, count(*) AS daily_usage
        FROM activity_log WHERE target_resource IS NOT NULL AND
             {_days('created_at', "DATE '2024-01-01'", "DATE '2024-01-31'")} GROUP BY 1, 2""",
    "system_health": f"""
        SELECT (SELECT round(avg(execution_time_ms), 4) FROM activity_log WHERE {_days('created_at')}) AS avg_response_time,
               (SELECT round(count(*) FILTER (WHERE response_status >= 400) / nullif(count(*), 0) * 100, 4)
                FROM activity_log WHERE {_days('created_at')}) AS error_rate,
               (SELECT count(DISTINCT CAST(created_at AS DATE)) FROM activity_log WHERE {_days('created_at')}) AS uptime_days,
               (SELECT max(n) FROM (SELECT count(*) AS n FROM sessions WHERE {_days('login_time')}
                                    GROUP BY CAST(login_time AS DATE))) AS peak_concurrent_users""",
    "preset_ranges": _presets(),
    "daily_rollup": "SELECT * FROM daily_rollup_rows",
    "performance_rollup": "SELECT * FROM performance",
    "system_rollup": "SELECT * FROM system_rows",
    "peak_concurrency": "SELECT * FROM peaks",
    "chat_rollup": """
        SELECT d.date, d.sessions AS total_sessions, d.messages AS total_messages, d.unique_users,
               CAST(round(d.avg_session_duration) AS BIGINT) AS avg_session_duration,
               round(d.messages / d.sessions, 2) AS avg_messages_per_session, i.intent_category AS most_common_intent,
               round(d.avg_satisfaction, 2) AS satisfaction_score
        FROM chat_days d
        LEFT JOIN (SELECT CAST(s.started_at AS DATE) AS date, m.intent_category,
                          row_number() OVER (PARTITION BY CAST(s.started_at AS DATE)
                                             ORDER BY count(*) DESC, m.intent_category) AS rn
                   FROM chat_sessions s JOIN chat_messages m ON m.session_id = s.session_id
                   WHERE m.intent_category IS NOT NULL GROUP BY 1, 2) i ON i.date = d.date AND i.rn = 1""",
    "intent_rollup": """
        SELECT intent_category AS intent_name, count(*) AS trigger_count, count(*) FILTER (WHERE is_helpful) AS success_count,
               round(CAST(sum(confidence_score) AS DOUBLE) / count(confidence_score), 2) AS avg_confidence,
               max(created_at) AS last_triggered_at
        FROM chat_messages WHERE intent_category IS NOT NULL GROUP BY 1""",
    "waste_deposited": """
        SELECT user_id, count(*) FILTER (WHERE type = 'waste_deposit') AS total_waste_deposited FROM tx GROUP BY 1""",
    "period_change": f"""
        SELECT *, round((sessions_now - sessions_before) / nullif(sessions_before, 0) * 100, 2) AS sessions_change_pct,
               round((activities_now - activities_before) / nullif(activities_before, 0) * 100, 2) AS activities_change_pct
        FROM (SELECT
            (SELECT count(*) FROM sessions WHERE {_days('login_time')}) AS sessions_now,
            (SELECT count(*) FROM sessions WHERE {_days('login_time', "DATE '2024-01-05'", "DATE '2024-01-12'")})
                AS sessions_before,
            (SELECT count(*) FROM activity_log WHERE {_days('created_at')}) AS activities_now,
            (SELECT count(*) FROM activity_log WHERE {_days('created_at', "DATE '2024-01-05'", "DATE '2024-01-12'")})
                AS activities_before)""",
    "intraday_4h": """
        SELECT CAST(created_at AS DATE) AS date, CAST(hour(created_at) // 4 * 4 AS INT) AS bucket_hour,
               round(avg(execution_time_ms), 4) AS avg_response_ms, count(DISTINCT admin_id) AS active_users
        FROM activity_log GROUP BY 1, 2""",
    "weekday_profile": """
        SELECT a.weekday, a.activities, s.sessions
        FROM (SELECT CAST(isodow(created_at) AS INT) AS weekday, count(*) AS activities FROM activity_log GROUP BY 1) a
        FULL JOIN (SELECT CAST(isodow(login_time) AS INT) AS weekday, count(*) AS sessions FROM sessions GROUP BY 1) s
             ON s.weekday = a.weekday""",
    "security_share": """
        SELECT dimension, label, count(*) AS events,
               round(count(*) / sum(count(*)) OVER (PARTITION BY dimension) * 100, 2) AS share_pct
        FROM (SELECT 'status' AS dimension, CASE WHEN is_resolved THEN 'Resolved' ELSE 'Pending' END AS label FROM security
              UNION ALL SELECT 'severity', event_severity FROM security) GROUP BY 1, 2""",
    "feedback_summary": """
        SELECT feedback_type, count(*) AS feedback_count, round(avg(rating), 4) AS avg_rating,
               count(*) FILTER (WHERE NOT is_resolved) AS unresolved_count
        FROM feedback GROUP BY 1""",
    "preferences_pivot": """
        SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation
        FROM customer""",
    "table_counts": _table_counts(),
    "knowledge_listing": f"SELECT category, priority FROM {_NAMED['ai_knowledge_base']}",
    "rewards_catalog": "SELECT id, title, cost_points, is_active FROM rewards WHERE is_active",
    "users_sample": "SELECT user_id, display_name, email FROM chat_users ORDER BY user_id LIMIT 5",
    "ua_classify": f"""
        SELECT {_BROWSER} AS browser_name,
               coalesce(nullif(regexp_extract(user_agent, '(Chrome|Firefox|Safari|Edge)/(\\d+)', 2), ''), 'Unknown')
                   AS browser_version,
               {_OS} AS os_name, count(*) AS visits
        FROM page_view_rows GROUP BY 1, 2, 3""",
    "ua_classify_corrected": f"""
        SELECT {_BROWSER_CORRECTED} AS browser_name, {_OS_CORRECTED} AS os_name, count(*) AS visits
        FROM page_view_rows GROUP BY 1, 2""",
    "device_mix": """
        SELECT CASE WHEN width < 768 THEN 'mobile' WHEN width < 1024 THEN 'tablet' ELSE 'desktop' END AS device_type,
               count(*) AS visits, CAST(sum(visit_duration) AS BIGINT) AS total_seconds
        FROM page_view_rows GROUP BY 1""",
    "tagged_clicks": """
        SELECT event_id AS id, upper(event_type) AS activity_type,
               CASE WHEN k % 2 = 0 THEN 'INTERACTION' END AS activity_category, 'Clicked on ' || event_type AS description,
               CAST(floor(trunc(value * 1000) / 1000) AS INT) AS visit_seconds
        FROM ev""",
    "valid_sessions": """
        SELECT id, admin_id, login_time FROM sessions WHERE login_time > TIMESTAMP '2024-01-19 00:00:00'""",
    "ingest_required_fields": """
        SELECT CASE WHEN activity_type IS NULL OR description IS NULL THEN 'quarantined' ELSE 'accepted' END AS outcome,
               id, activity_type, activity_category, description
        FROM requests""",
    "ingest_json_requests": """
        SELECT event_id AS id, CASE WHEN k % 10 = 3 THEN 'malformed' ELSE 'parsed' END AS outcome,
               CASE WHEN k % 10 <> 3 THEN event_type END AS activity_type, CASE WHEN k % 10 <> 3 THEN k END AS k
        FROM ev""",
    "ingest_defaults": """
        SELECT 'visit' AS feed, CAST(CASE WHEN k % 5 <> 0 THEN CAST(floor(value) AS INT) ELSE 0 END AS VARCHAR) AS value,
               count(*) AS row_count FROM ev GROUP BY 2
        UNION ALL SELECT 'ledger', CASE WHEN points < 0 THEN type ELSE 'waste_deposit' END, count(*) FROM tx GROUP BY 2""",
    "ingest_auth_inner": f"SELECT id, session_token, session_id, admin_id, username FROM ({_ACCEPTED})",
    "ingest_auth_anti": """
        SELECT r.id, r.session_token FROM requests r
        WHERE NOT EXISTS (SELECT 1 FROM sessions s JOIN admins a ON a.id = s.admin_id
                          WHERE s.session_token = r.session_token AND s.is_active)""",
    "retry_remaining": """
        SELECT ts AS "timestamp", CASE WHEN k % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, '/api/' || (k % 5) AS endpoint,
               props AS data
        FROM ev e WHERE event_type = 'error' AND NOT EXISTS (
            SELECT 1 FROM ev d WHERE d.event_type = 'error' AND d.value < 50 AND d.ts = e.ts
                   AND d.k % 2 = e.k % 2 AND d.k % 5 = e.k % 5)""",
    "login_events": f"""
        SELECT 'session' AS target, admin_id, id AS session_id, {_TOKEN} AS detail, login_time AS at FROM sessions
        UNION ALL SELECT 'log', admin_id, id, 'Admin logged in successfully', login_time FROM sessions""",
    "chat_session_start": """
        SELECT md5(CAST(conv_id % 10 AS VARCHAR) || '|' || CAST(CAST(started AS DATE) AS VARCHAR) || '|' || conv_id)
                   AS session_id,
               CAST(conv_id % 10 AS VARCHAR) AS user_id, 'Chat ' || conv_id AS session_name, TRUE AS is_active,
               started AS started_at, 0 AS message_count, 0 AS total_tokens_used
        FROM (SELECT conv_id, TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR AS started
              FROM conversations WHERE turn = 0)""",
    "logout_events": """
        SELECT CASE WHEN s.id IS NULL OR NOT EXISTS (SELECT 1 FROM admins a WHERE a.id = o.admin_id) THEN 'rejected'
                    WHEN s.admin_id = o.admin_id THEN 'closed' ELSE 'logged' END AS target,
               o.admin_id, o.session_id, s.ip_address,
               'Admin logged out after ' || CASE WHEN s.admin_id = o.admin_id THEN date_sub('second', s.login_time, o.ts)
                                                 WHEN s.id IS NOT NULL THEN 0 END || ' seconds' AS detail,
               CASE WHEN s.admin_id = o.admin_id THEN date_sub('second', s.login_time, o.ts)
                    WHEN s.id IS NOT NULL THEN 0 END AS session_duration, o.ts AS at
        FROM logouts o LEFT JOIN sessions s ON s.id = o.session_id""",
    "logout_sessions": """
        SELECT s.id, s.admin_id, s.session_token, s.ip_address, s.login_time,
               coalesce(o.ts, s.logout_time) AS logout_time, s.is_active AND o.ts IS NULL AS is_active,
               CASE WHEN o.ts IS NULL THEN s.session_duration ELSE date_sub('second', s.login_time, o.ts) END
                   AS session_duration
        FROM sessions s LEFT JOIN logouts o ON o.session_id = s.id AND o.admin_id = s.admin_id""",
    "detection_points": """
        SELECT d.coco_class, m.waste_category, count(*) AS detections, CAST(sum(c.points_value) AS BIGINT) AS total_points
        FROM detections d
        JOIN (VALUES ('MEDIUM', 'plastic'), ('PROMO', 'paper'), ('SMALL', 'steel'), ('STANDARD', 'organic'))
             AS m(coco_class, waste_category) ON m.coco_class = d.coco_class
        JOIN categories c ON c.category_name = m.waste_category
        WHERE d.confidence >= 0.35 GROUP BY 1, 2""",
    "affordable_rewards": """
        SELECT p.user_id, coalesce(p.display_name, p.email, p.user_id) AS name, p.eco_points,
               count(r.id) AS affordable_count,
               first(r.id ORDER BY r.cost_points DESC, r.id) AS best_reward_id, max(r.cost_points) AS best_cost
        FROM profiles p LEFT JOIN rewards r ON r.is_active AND r.cost_points <= p.eco_points GROUP BY 1, 2, 3""",
    "intent_match": _INTENT_MATCH,
    "points_upsert": _POINTS_COLUMNS,
    "stream_upsert_points": _POINTS_COLUMNS,
    "stream_points_deltas": _POINTS_COLUMNS,
    "points_ledger": """
        SELECT md5('points|' || id) AS id, user_id, points, CASE WHEN seq % 89 <> 0 THEN type END AS type,
               CASE WHEN type <> 'redeem' THEN 'kind ' || seq % 4 END AS waste_category, ts AS "timestamp"
        FROM tx""",
    "daily_upsert": _DAILY_STATS,
    "feature_upsert": _FEATURE_COLUMNS,
    "performance_counter": _DAY_COUNTS,
    "stream_daily_counts": _DAY_COUNTS,
    "intent_upsert": """
        SELECT intent_category AS intent_name, intent_category, count(*) AS trigger_count, max(created_at) AS last_triggered_at
        FROM chat_messages WHERE intent_category IS NOT NULL GROUP BY 1""",
    "session_counter": """
        SELECT s.session_id, s.user_id, count(m.id) AS message_count
        FROM chat_sessions s LEFT JOIN chat_messages m ON m.session_id = s.session_id GROUP BY 1, 2""",
    "user_upsert": _USERS,
    "seed_upsert_keep": """
        SELECT id, CASE WHEN is_active THEN title ELSE 'New ' || title END AS title,
               CASE WHEN is_active THEN cost_points ELSE cost_points + 5 END AS cost_points, TRUE AS is_active FROM rewards""",
    "seed_upsert_overwrite": """
        SELECT id, CASE WHEN is_active THEN title ELSE 'New ' || title END AS title, cost_points + 5 AS cost_points,
               TRUE AS is_active FROM rewards""",
    "changed_profiles": """
        SELECT o.user_id, o.eco_points AS old_value, n.eco_points AS new_value
        FROM profiles o JOIN profiles_after n ON n.user_id = o.user_id WHERE o.eco_points <> n.eco_points""",
    "data_change_log": _CHANGES,
    "dq_unique": " UNION ALL ".join(
        _duplicates(table, _NAMED[table], keys.split(","))
        if table != "admin_security_events"
        else _duplicates(table, "(SELECT * FROM security UNION ALL SELECT * FROM security)", ["id"])
        for table, keys in _KEYS
    ),
    "dq_orphans": " UNION ALL ".join(
        _orphans(child, _NAMED[child], column, parent, _NAMED[parent], key) for child, column, parent, key in _LINKS
    ),
    "dq_enum": " UNION ALL ".join(
        [
            _enum("chat_messages", _RAW_MESSAGES, "message_type", ["user", "bot", "system"]),
            _enum("admin_security_events", _RAW_SECURITY, "event_severity", ["LOW", "MEDIUM", "HIGH", "CRITICAL"]),
        ]
    ),
    "dq_nulls_len": " UNION ALL ".join(
        [
            _column_check("chat_messages", _RAW_MESSAGES, column, longest, required)
            for column, longest, required in [
                ("id", None, True), ("session_id", 36, True), ("user_id", 64, True), ("message_type", None, True),
                ("message_content", None, True), ("intent_category", 100, False),
            ]
        ]
        + [
            _column_check("admin_security_events", _RAW_SECURITY, column, longest, required)
            for column, longest, required in [
                ("id", None, True), ("event_type", 50, True), ("event_severity", None, True),
                ("event_description", None, True), ("ip_address", 45, True),
            ]
        ]
        + [
            _column_check("admin_activity_log", "activity_log", column, longest, required)
            for column, longest, required in [
                ("id", None, True), ("admin_id", None, True), ("activity_type", 100, True), ("activity_category", 50, True),
                ("activity_description", None, True), ("target_resource", 100, False), ("target_id", 100, False),
                ("ip_address", 45, True),
            ]
        ]
    ),
    "delete_cascade": """
        SELECT id, admin_id, activity_type FROM activity_log
        WHERE admin_id NOT IN (SELECT id FROM admins WHERE NOT is_active)""",
    "delete_set_null": """
        SELECT s.id, CASE WHEN a.id IS NULL THEN s.admin_id END AS admin_id, s.event_type
        FROM security s LEFT JOIN admins a ON a.id = s.admin_id AND NOT a.is_active""",
    "dq_registration": _registration(),
    "sessionize": _SESSIONIZE,
    "stream_sessionize": _SESSIONIZE,
    "page_visits": """
        SELECT page_name, page_url, 2 * count(*) AS visits, CAST(sum(visit_duration) AS BIGINT) AS total_seconds,
               round(sum(visit_duration) / (2 * count(*)), 4) AS avg_seconds
        FROM page_view_rows GROUP BY 1, 2""",
    "page_visits_corrected": """
        SELECT page_name, page_url, count(*) AS visits, CAST(sum(visit_duration) AS BIGINT) AS total_seconds,
               round(avg(visit_duration), 4) AS avg_seconds
        FROM page_view_rows GROUP BY 1, 2""",
    "dedup_double_fire": """
        SELECT id, admin_id, activity_type, target_resource, execution_time_ms, created_at FROM (
            SELECT *, lag(created_at) OVER (PARTITION BY admin_id, activity_type, target_resource ORDER BY created_at, id) AS before
            FROM (SELECT id * 2 AS id, admin_id, activity_type, target_resource, execution_time_ms, created_at FROM activity_log
                  UNION ALL SELECT id * 2 + 1, admin_id, activity_type, target_resource, execution_time_ms,
                                   created_at + (id % 9 + 1) * INTERVAL 1 MILLISECOND
                  FROM activity_log WHERE activity_type = 'click'))
        WHERE before IS NULL OR created_at - before > INTERVAL 1 SECOND""",
    "dedup_same_second": """
        SELECT min(id) AS id, admin_id, activity_type, target_resource, arg_min(created_at, id) AS created_at
        FROM activity_log GROUP BY admin_id, activity_type, target_resource, date_trunc('second', created_at)""",
    "stream_sessions": """
        WITH live AS (SELECT o.* FROM logouts o JOIN ev ON ev.event_id = o.session_id % 1000000000 WHERE ev.k % 5 <> 0)
        SELECT 'session' AS part, s.id AS session_id, s.admin_id, o.ts AS moment,
               CASE WHEN o.ts IS NULL THEN 'true' ELSE 'false' END AS detail,
               coalesce(date_sub('second', s.login_time, o.ts), 0) AS seconds
        FROM sessions s LEFT JOIN live o ON o.session_id = s.id AND o.admin_id = s.admin_id
        UNION ALL SELECT 'log', id, admin_id, login_time, 'Admin logged in successfully', NULL FROM sessions
        UNION ALL SELECT 'log', o.session_id, o.admin_id, o.ts, 'Admin logged out after '
                         || CASE WHEN s.admin_id = o.admin_id THEN date_sub('second', s.login_time, o.ts) ELSE 0 END || ' seconds', NULL
                  FROM live o JOIN sessions s ON s.id = o.session_id JOIN admins a ON a.id = o.admin_id""",
    "stream_points_job": """
        SELECT 'profile' AS part, user_id AS key, eco_points AS value, coalesce(display_name, email) AS detail FROM profiles_after
        UNION ALL SELECT 'ledger', md5('points|' || id), CAST(points AS BIGINT),
                         CASE WHEN type <> 'redeem' THEN 'kind ' || seq % 4 END FROM tx
        UNION ALL SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR), count(*), CAST(count(DISTINCT user_id) AS VARCHAR)
                  FROM tx GROUP BY CAST(ts AS DATE)
        UNION ALL SELECT 'rank', CAST(row_number() OVER (ORDER BY eco_points DESC, joined_at, user_id) AS VARCHAR), eco_points,
                         coalesce(display_name, email, user_id)
                  FROM profiles_after WHERE eco_points > 0""",
    "stream_ingest_append": f"""
        SELECT id, admin_id, session_id, activity_type, activity_category, description AS activity_description,
               target_resource, target_id, CAST(NULL AS VARCHAR) AS old_values, CAST(NULL AS VARCHAR) AS new_values,
               coalesce(ip_address, 'unknown') AS ip_address, 'unknown' AS user_agent, 'POST' AS request_method,
               '' AS request_url, response_status, coalesce(execution_time_ms, 0) AS execution_time_ms, additional_data,
               ts AS created_at
        FROM ({_ACCEPTED}) WHERE activity_type IS NOT NULL AND description IS NOT NULL""",
    "stream_ingest_visits": f"""
        SELECT e.event_id AS id, s.admin_id, s.id AS session_id, 'page_' || (k % 5) AS page_name,
               '/app/page_' || (k % 5) AS page_url, CASE WHEN k % 5 <> 0 THEN CAST(floor(value) AS INT) ELSE 0 END AS visit_duration,
               'unknown' AS ip_address, coalesce(CASE k % 6 {_AGENT_CASES} END, 'unknown') AS user_agent,
               CASE k % 3 WHEN 0 THEN '375x812' WHEN 1 THEN '1920x1080' END AS screen_resolution,
               CASE k % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' END AS device_type, k % 2 = 0 AS named_browser, ts AS created_at
        FROM ev e JOIN sessions s ON s.session_token = 'sess_' || (e.event_id - e.k % 4) AND s.is_active
        JOIN admins a ON a.id = s.admin_id
        WHERE e.k % 13 <> 0""",
    "stream_ingest_security": """
        SELECT event_id AS id, CASE WHEN k % 3 <> 0 THEN user_id END AS admin_id, 'TYPE_' || (k % 3) AS event_type,
               'HIGH' AS event_severity, 'event ' || k AS event_description, '10.2.0.' || k AS ip_address,
               'unknown' AS user_agent, CASE WHEN k % 4 = 1 THEN props END AS additional_data, FALSE AS is_resolved,
               ts AS created_at
        FROM ev WHERE k % 7 <> 0""",
    "stream_quarantine": f"""
        SELECT 'activity' AS feed, CASE WHEN id % 10 = 3 THEN 'malformed'
                    WHEN activity_type IS NULL OR description IS NULL THEN 'incomplete'
                    WHEN id NOT IN (SELECT id FROM ({_ACCEPTED})) THEN 'no active session' ELSE 'accepted' END AS reason, id
        FROM requests
        UNION ALL SELECT 'security_event', CASE WHEN k % 7 = 0 THEN 'incomplete' ELSE 'accepted' END, event_id FROM ev""",
    "stream_ingested_activities": f"""
        SELECT id, activity_type, target_id FROM ({_ACCEPTED}) WHERE activity_type IS NOT NULL AND description IS NOT NULL
        ORDER BY ts DESC, id DESC LIMIT 100""",
    "stream_dedup": "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}

ORACLE: dict[str, str] = {name: with_base(body) for name, body in _BODIES.items()}
