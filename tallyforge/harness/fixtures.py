"""Frames of the declared shape, projected from the generated test tables.

Every frame is a lazy projection of whole tables; nothing is sampled or capped.
Timestamps stay ``TIMESTAMP_NTZ`` so results do not depend on the session zone.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AS_OF = datetime(2024, 1, 31, 12, 0, 0)
DAY = date(2024, 1, 15)
RANGE_END = date(2024, 1, 20)
SPLIT_DAY = date(2024, 1, 16)

RAW_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# Category points, detection mapping and threshold.
CATEGORY_POINTS = [("plastic", 10), ("paper", 5), ("steel", 15), ("organic", 8)]
DETECTION_CLASSES = [("MEDIUM", "plastic"), ("PROMO", "paper"), ("SMALL", "steel"), ("STANDARD", "organic")]

# User agents given to page visits by ``k % 6``.
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/119.0 Safari/537.36 Edg/119.0",
    "Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0",
    "Mozilla/5.0 (Linux; Android 14) AppleWebKit/537.36 Chrome/118.0 Mobile Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1 Version/17.0 Safari/604.1",
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Edge/18.1",
    "curl/8.0",
]

# Keywords of the intent rules: (category, keywords as a JSON array, priority).
KNOWLEDGE_BASE = [
    ("earn_points", '["thtion", "thing", "qu est ce", "der die"]', 10),
    ("recycling", '["thble", "mente", "der", "la"]', 10),
    ("ai_detection", '["ering", "nicht", "des"]', 9),
    ("rewards", '["erble", "und", "de la", "the"]', 8),
    ("environment", '["el", "les", "des les"]', 7),
]


def literal_ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def literal_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small fixed table as VALUES, whose size the optimizer knows."""
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(show(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.schema(RAW_SCHEMAS[table]).parquet(f"{self.sf_dir}/{table}.parquet")

    # ---- activity ---------------------------------------------------------
    @cached_property
    def ev(self) -> DataFrame:
        return with_k(self.raw("events"))

    @cached_property
    def admins(self) -> DataFrame:
        """Customers in credit; events of the others are orphans."""
        return (
            self.raw("customer")
            .filter("c_acctbal >= 0")
            .selectExpr(
                "c_custkey AS id",
                "c_name AS username",
                "CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'FURNITURE' THEN '' "
                "ELSE concat('Admin ', c_custkey) END AS display_name",
                "c_mktsegment <> 'MACHINERY' AS is_active",
            )
        )

    @cached_property
    def activity_log(self) -> DataFrame:
        return activity_from(self.ev)

    @cached_property
    def sessions(self) -> DataFrame:
        # some sessions last days, some end in the second they begin
        seconds = (
            "CAST(CASE k % 50 WHEN 1 THEN floor(value * 10) + 200000 WHEN 2 THEN 0 ELSE floor(value * 10) END AS INT)"
        )
        return self.ev.filter("event_type = 'signup'").selectExpr(
            "event_id AS id",
            "user_id AS admin_id",
            "concat('sess_', event_id) AS session_token",
            "concat('10.0.0.', k) AS ip_address",
            "ts AS login_time",
            f"CASE WHEN k % 3 <> 0 THEN timestampadd(SECOND, {seconds}, ts) END AS logout_time",
            "k % 3 = 0 AS is_active",
            f"CASE WHEN k % 3 = 0 THEN 0 ELSE {seconds} END AS session_duration",
        )

    @cached_property
    def page_visits(self) -> DataFrame:
        agents = " ".join(f"WHEN {i} THEN '{agent}'" for i, agent in enumerate(USER_AGENTS))
        return self.ev.filter("event_type = 'view'").selectExpr(
            "event_id AS id",
            "user_id AS admin_id",
            "concat('page_', k % 5) AS page_name",
            "concat('/app/page_', k % 5) AS page_url",
            "CAST(floor(value) AS INT) AS visit_duration",
            f"CASE k % 6 {agents} END AS user_agent",
            "CASE k % 3 WHEN 0 THEN '375x812' WHEN 1 THEN '800x600' ELSE '1920x1080' END AS screen_resolution",
            "ts AS created_at",
        )

    @cached_property
    def security_events(self) -> DataFrame:
        return self.ev.filter("event_type = 'error'").selectExpr(
            "event_id AS id",
            "user_id AS admin_id",
            "concat('TYPE_', k % 3) AS event_type",
            "CASE k % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS event_severity",
            "concat('event ', k) AS event_description",
            "concat('10.0.0.', k) AS ip_address",
            "CASE WHEN k % 5 <> 0 THEN k % 5 <= 2 END AS is_resolved",
            "CASE WHEN k % 5 IN (1, 2) THEN timestampadd(HOUR, 1, ts) END AS resolved_at",
            "ts AS created_at",
        )

    # ---- points and rewards -----------------------------------------------
    @cached_property
    def profiles(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "CAST(c_custkey AS STRING) AS user_id",
            "CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN concat(c_name, '@example.com') END AS email",
            "CASE WHEN c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD') THEN c_name END AS display_name",
            "CAST(floor(c_acctbal) AS INT) AS eco_points",
            "timestampadd(DAY, CAST(c_custkey % 365 AS INT), TIMESTAMP_NTZ '2023-01-01 00:00:00') AS joined_at",
        )

    @cached_property
    def transactions(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "CAST(o_orderkey AS STRING) AS id",
            f"{LEDGER_USER} AS user_id",
            f"{SIGNED_POINTS} AS points",
            f"{LEDGER_TYPE} AS type",
            "CASE WHEN o_orderstatus = 'F' THEN 'Redeem: Free Coffee' WHEN o_orderpriority = '1-URGENT' THEN 'plastic' "
            "WHEN o_orderpriority = '2-HIGH' THEN 'paper' WHEN o_orderpriority = '3-MEDIUM' THEN 'steel' "
            "WHEN o_orderpriority = '5-LOW' THEN 'organic' END AS waste_category",
            "o_orderdate AS timestamp",
        )

    @cached_property
    def waste_categories(self) -> DataFrame:
        return literal_table(self.spark, CATEGORY_POINTS, "category_name, points_value").selectExpr("*", "true AS is_active")

    @cached_property
    def detection_mapping(self) -> DataFrame:
        return literal_table(self.spark, DETECTION_CLASSES, "coco_class, waste_category").selectExpr(
            "*", "CAST(0.35 AS DECIMAL(3,2)) AS confidence_threshold", "true AS is_active"
        )

    @cached_property
    def detections(self) -> DataFrame:
        part = self.raw("part").selectExpr("p_partkey AS l_partkey", "p_type")
        return (
            self.raw("lineitem")
            .join(part, "l_partkey")
            .selectExpr(
                "l_orderkey AS order_id",
                "l_linenumber AS line",
                "p_type AS coco_class",
                "CAST(l_discount * 10 AS DECIMAL(3,2)) AS confidence",
            )
        )

    @cached_property
    def rewards(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "concat('r-', p_partkey) AS id",
            "p_name AS title",
            "CAST(floor(p_retailprice) AS INT) AS cost_points",
            "p_size > 10 AS is_active",
        )

    # ---- chat ---------------------------------------------------------------
    @cached_property
    def chat_sessions(self) -> DataFrame:
        return (
            self.raw("conversations")
            .groupBy("conv_id")
            .agg(F.max("turn").alias("last_turn"))
            .selectExpr(
                "conv_id AS id",
                "concat('c', conv_id) AS session_id",
                "CAST(conv_id % 10 AS STRING) AS user_id",
                f"{CHAT_START} AS started_at",
                f"CASE WHEN conv_id % 5 <> 0 THEN timestampadd(SECOND, CAST(last_turn * 90 AS INT), {CHAT_START}) END "
                "AS ended_at",
            )
        )

    @cached_property
    def chat_messages(self) -> DataFrame:
        return self.raw("conversations").selectExpr(
            "conv_id * 1000 + turn AS id",
            "concat('c', conv_id) AS session_id",
            "CAST(conv_id % 10 AS STRING) AS user_id",
            "CASE role WHEN 'assistant' THEN 'bot' ELSE role END AS message_type",
            "text AS message_content",
            "CASE WHEN role = 'assistant' THEN length(text) % 500 ELSE 0 END AS response_time_ms",
            "CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 <> 0 "
            "THEN CAST((conv_id + turn) % 5 + 1 AS INT) END AS user_rating",
            "CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 <> 0 THEN (conv_id + turn) % 3 = 1 END AS is_helpful",
            "CASE WHEN role <> 'user' THEN CASE length(text) % 4 WHEN 0 THEN 'earn_points' WHEN 1 THEN 'recycling' "
            "WHEN 2 THEN 'rewards' END END AS intent_category",
            "CAST((length(text) % 100) / 100 AS DECIMAL(3,2)) AS confidence_score",
            f"timestampadd(SECOND, CAST(turn * 90 AS INT), {CHAT_START}) AS created_at",
        )

    @cached_property
    def chat_users(self) -> DataFrame:
        """Customers in credit; feeds that mention the others create new users."""
        return (
            self.raw("customer")
            .filter("c_acctbal >= 0")
            .selectExpr(
                "CAST(c_custkey AS STRING) AS user_id",
                "concat(c_name, '@example.com') AS email",
                "c_name AS display_name",
                "CAST(NULL AS STRING) AS first_name",
                "CAST(NULL AS STRING) AS last_name",
                "CAST(NULL AS STRING) AS phone",
                "CAST(NULL AS TIMESTAMP_NTZ) AS last_active_at",
            )
        )

    @cached_property
    def user_feedback(self) -> DataFrame:
        return self.chat_messages.filter("user_rating IS NOT NULL").selectExpr(
            "id",
            "user_id",
            "id AS message_id",
            "CASE WHEN user_rating >= 4 THEN 'positive' WHEN user_rating <= 2 THEN 'negative' ELSE 'neutral' END "
            "AS feedback_type",
            "user_rating AS rating",
            "id % 2 = 0 AS is_resolved",
        )

    @cached_property
    def preferences(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "CAST(c_custkey AS STRING) AS user_id",
            "stack(2, 'segment', c_mktsegment, 'nation', CAST(c_nationkey AS STRING)) AS (preference_key, preference_value)",
        )

    @cached_property
    def knowledge_base(self) -> DataFrame:
        return literal_table(self.spark, KNOWLEDGE_BASE, "category, keywords, priority").selectExpr("*", "true AS is_active")

    # ---- feeds --------------------------------------------------------------
    @cached_property
    def points_feed(self) -> DataFrame:
        return points_from(self.raw("orders"))

    @cached_property
    def user_feed(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "CAST(o_custkey AS STRING) AS user_id",
            "CASE WHEN o_orderstatus = 'P' THEN concat(o_orderkey, '@feed.example') END AS email",
            "CASE WHEN o_orderpriority = '1-URGENT' THEN concat('name ', o_orderkey) END AS display_name",
            "CASE WHEN o_orderpriority = '2-HIGH' THEN concat('first ', o_orderkey) END AS first_name",
            "CASE WHEN o_orderpriority = '3-MEDIUM' THEN concat('last ', o_orderkey) END AS last_name",
            "CASE WHEN o_orderpriority = '5-LOW' THEN concat('+', o_orderkey) END AS phone",
            "o_orderdate AS event_time",
        )

    @cached_property
    def request_feed(self) -> DataFrame:
        return requests_from(self.ev)

    @cached_property
    def logout_feed(self) -> DataFrame:
        """A logout per session; some name the wrong admin, some a session that never was."""
        return self.ev.filter("event_type = 'signup'").selectExpr(
            "event_id + CASE WHEN k % 9 = 0 THEN 1000000000 ELSE 0 END AS session_id",
            "user_id + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS admin_id",
            "timestampadd(SECOND, CAST(floor(value * 10) AS INT), ts) AS event_time",
        )

    @cached_property
    def failed_requests(self) -> DataFrame:
        return retry_queue(self.ev.filter("event_type = 'error'"))

    @cached_property
    def retried_requests(self) -> DataFrame:
        return retry_queue(self.ev.filter("event_type = 'error' AND value < 50"))

    @cached_property
    def registrations(self) -> DataFrame:
        """Sign-ups of all customers, with a defect that depends on the key."""
        return self.raw("customer").selectExpr(
            "c_custkey AS id",
            "CASE c_custkey % 7 WHEN 1 THEN 'ab' WHEN 2 THEN c_name ELSE replace(c_name, '#', '_') END AS username",
            "CASE c_custkey % 7 WHEN 3 THEN 'no-at.example' WHEN 4 THEN 'a b@example.com' "
            "ELSE concat(replace(c_name, '#', '.'), '@example.com') END AS email",
            "CASE c_custkey % 7 WHEN 5 THEN ' A ' ELSE 'Customer' END AS first_name",
            "CASE WHEN c_custkey % 7 <> 6 THEN c_mktsegment END AS last_name",
        )


CHAT_START = "timestampadd(SECOND, CAST(conv_id * 3600 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"
LEDGER_USER = "CAST(CASE WHEN o_custkey % 50 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS STRING)"
LEDGER_TYPE = "CASE WHEN o_orderstatus = 'F' THEN 'redeem' ELSE 'waste_deposit' END"
SIGNED_POINTS = (
    "CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN -floor(o_totalprice / 1000) "
    "ELSE floor(o_totalprice / 1000) END AS INT)"
)


def with_k(events: DataFrame) -> DataFrame:
    return events.selectExpr("*", "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k")


def activity_from(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "event_id AS id",
        "user_id AS admin_id",
        "event_type AS activity_type",
        "CASE WHEN event_type IN ('click', 'view') THEN 'NAVIGATION' WHEN event_type = 'purchase' THEN 'DATA' "
        "WHEN event_type = 'signup' THEN 'USER' ELSE 'SYSTEM' END AS activity_category",
        "concat(event_type, ' #', k) AS activity_description",
        "CASE WHEN k % 7 <> 0 THEN concat('feature_', k % 10) END AS target_resource",
        "CAST(k AS STRING) AS target_id",
        "concat('10.0.0.', k) AS ip_address",
        "CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 500 WHEN event_type = 'error' THEN 404 "
        "WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 302 ELSE 200 END AS response_status",
        "CAST(floor(value) AS INT) AS execution_time_ms",
        "props AS additional_data",
        "ts AS created_at",
    )


def points_from(orders: DataFrame) -> DataFrame:
    """One delta per order, naming the user only now and then."""
    return orders.selectExpr(
        "o_orderkey AS id",
        f"{LEDGER_USER} AS user_id",
        f"{SIGNED_POINTS} AS points_delta",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN concat('name ', o_orderkey) END AS display_name",
        "CASE WHEN o_orderstatus = 'P' THEN concat(o_orderkey, '@feed.example') END AS email",
        f"CASE WHEN o_orderkey % 89 <> 0 THEN {LEDGER_TYPE} END AS type",
        "CASE WHEN o_orderstatus <> 'F' THEN 'kind ' || o_orderkey % 4 END AS waste_category",
        "o_orderdate AS event_time",
    )


def requests_from(ev: DataFrame) -> DataFrame:
    """Activity requests as they arrive: some lack a field, many an active session."""
    return ev.selectExpr(
        "event_id AS id",
        "concat('sess_', event_id - k % 4) AS session_token",
        "CASE WHEN k % 17 <> 0 THEN event_type END AS activity_type",
        "CASE WHEN event_type IN ('click', 'view') THEN 'NAVIGATION' ELSE 'DATA' END AS activity_category",
        "CASE WHEN k % 2 = 0 THEN concat('did ', event_type) END AS description",
        "CASE WHEN k % 2 = 1 AND k % 19 <> 0 THEN concat('did ', event_type) END AS activity_description",
        "CASE WHEN k % 7 <> 0 THEN concat('feature_', k % 10) END AS target_resource",
        "CASE WHEN k % 5 <> 0 THEN CAST(floor(value) AS INT) END AS execution_time_ms",
        "CAST(k AS STRING) AS target_id",
        "CASE WHEN k % 6 <> 0 THEN concat('10.1.0.', k) END AS ip_address",
        "CASE WHEN event_type = 'error' THEN 500 WHEN k % 11 <> 0 THEN 200 END AS response_status",
        "CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN props END AS additional_data",
        "'POST' AS request_method",
        "ts AS event_time",
    )


def session_events_from(ev: DataFrame) -> DataFrame:
    """A login and a logout of each sign-up; some logouts name another admin or an unknown session, some never come."""
    login = "named_struct('kind', 'login', 'session_id', event_id, 'admin_id', user_id, 'event_time', ts)"
    logout = (
        "named_struct('kind', 'logout', 'session_id', event_id + CASE WHEN k % 9 = 0 THEN 1000000000L ELSE 0L END, "
        "'admin_id', user_id + CASE WHEN k % 4 = 0 THEN 1L ELSE 0L END, "
        "'event_time', timestampadd(SECOND, CAST(floor(value * 10) AS INT), ts))"
    )
    return ev.filter("event_type = 'signup'").selectExpr(
        "event_id AS id", "concat('10.0.0.', k) AS ip_address",
        f"inline(CASE WHEN k % 5 = 0 THEN array({login}) ELSE array({login}, {logout}) END)",
    )


def visits_from(ev: DataFrame) -> DataFrame:
    """Page-visit requests: some name no page, many come without an active session."""
    agents = " ".join(f"WHEN {i} THEN '{agent}'" for i, agent in enumerate(USER_AGENTS))
    return ev.selectExpr(
        "event_id AS id",
        "concat('sess_', event_id - k % 4) AS session_token",
        "CASE WHEN k % 13 <> 0 THEN concat('page_', k % 5) END AS page_name",
        "concat('/app/page_', k % 5) AS page_url",
        "CASE WHEN k % 5 <> 0 THEN CAST(floor(value) AS INT) END AS visit_duration",
        f"CASE k % 6 {agents} END AS user_agent",
        "CASE k % 3 WHEN 0 THEN '375x812' WHEN 1 THEN '1920x1080' END AS screen_resolution",
        "CASE WHEN k % 2 = 0 THEN 'Own Browser' END AS browser_name",
        "ts AS event_time",
    )


def security_from(ev: DataFrame) -> DataFrame:
    """Security requests without a session: some name no admin, some lack a field."""
    return ev.selectExpr(
        "event_id AS id",
        "CASE WHEN k % 3 <> 0 THEN user_id END AS admin_id",
        "concat('TYPE_', k % 3) AS event_type",
        "CASE WHEN k % 7 <> 0 THEN 'HIGH' END AS event_severity",
        "concat('event ', k) AS event_description",
        "concat('10.2.0.', k) AS ip_address",
        "CASE WHEN k % 4 = 1 THEN props END AS additional_data",
        "ts AS event_time",
    )


def retry_queue(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "ts AS timestamp",
        "CASE WHEN k % 2 = 0 THEN 'POST' ELSE 'GET' END AS method",
        "concat('/api/', k % 5) AS endpoint",
        "props AS data",
    )
