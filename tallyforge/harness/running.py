"""Queries on running tables: order-safe folds, late rows, live sessions, joins of streams, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.harness import fixtures as shapes
from tallyforge.harness.fixtures import RAW_SCHEMAS, Fixtures
from tallyforge.functions import payloads
from tallyforge.harness.oracle import _ACCEPTED, _BODIES, _NAMED, BASE, ORACLE, with_base
from tallyforge.harness.queries import named_tables, query
from tallyforge.operators import board, cascade, folds, intervals, lookups, registers
from tallyforge.plans import catalog
from tallyforge.session import rocksdb_state, scratch_path
from tallyforge.sources import readers
from tallyforge.sources.readers import stream_files
from tallyforge.streaming import feeds, ordered, state
from tallyforge.streaming import sessions as live

#: Order in which batches are folded; unlike that of their events.
SHUFFLED = (2, 0, 3, 1)


def dealt(frame: DataFrame, event_id: str, batches: int = 4) -> list[DataFrame]:
    """Whole frame in batches by a hash of the id, as if every client sent when it came online."""
    lot = F.pmod(F.xxhash64(event_id), F.lit(batches))
    return [frame.filter(lot == i) for i in SHUFFLED if i < batches]


def in_slices(
    f: Fixtures,
    schema: str,
    slices: list[DataFrame],
    start: Callable[[DataFrame], StreamingQuery],
    after: Callable[[int], None] | None = None,
) -> None:
    """Feed a job slice by slice: each is written by many tasks, becomes one micro-batch, and the job restarts for the next."""
    folder = scratch_path(f.spark, "slices")
    for number, part in enumerate(slices):
        part.write.mode("append").parquet(folder)
        start(stream_files(f.spark, folder, schema)).awaitTermination()
        if after:
            after(number)


# ---- folds in any order -------------------------------------------------------
def _any_order(feed: DataFrame, rule: registers.Registers) -> DataFrame:
    """States of four batches, two combined first and the others one by one."""
    a, b, c, d = (registers.state_of(part, rule) for part in dealt(feed, "id"))
    return registers.folded([registers.folded([registers.folded([a, b], rule), c], rule), d], rule)


@query
def points_any_order(f):
    """The points feed folded from shuffled batches; equal to one batch in order."""
    return registers.points_view(f.profiles, _any_order(f.points_feed, registers.POINTS))


@query
def features_any_order(f):
    return registers.features_view(_any_order(f.activity_log, registers.FEATURES))


@query
def users_any_order(f):
    return registers.users_view(f.chat_users, _any_order(f.user_feed, registers.USERS))


@query
def stream_points_any_order(f):
    """A stream of shuffled slices, compacted half way."""
    root = scratch_path(f.spark, "ordered-points")

    def start(raw: DataFrame) -> StreamingQuery:
        return ordered.keep_states(shapes.points_from(raw), registers.POINTS, root, f"{root}/cp")

    def after(number: int) -> None:
        if number == 1:
            ordered.compact_states(f.spark, root, registers.POINTS)

    in_slices(f, RAW_SCHEMAS["orders"], dealt(f.raw("orders"), "o_orderkey"), start, after)
    return registers.points_view(f.profiles, ordered.kept_state(f.spark, root, registers.POINTS))


# ---- late rows --------------------------------------------------------------------
DELAY = timedelta(days=8)


def arrivals(f: Fixtures) -> list[DataFrame]:
    """Events as they arrive in four slices: some one or two slices late, purchases twice, some views again in the next slice."""
    own = F.when(F.col("ts") < "2024-01-11", 0).when(F.col("ts") < "2024-01-21", 1).otherwise(2)
    slot = F.least(F.lit(3), own + F.when(F.col("k") % 17 == 5, 2).when(F.col("k") % 10 == 3, 1).otherwise(0))
    copies = F.when(F.col("event_type") == "purchase", F.array(slot, slot)).when(
        (F.col("event_type") == "view") & (F.col("k") % 3 == 0), F.array(slot, F.least(F.lit(3), slot + 1))
    )
    sent = f.ev.withColumn("slice", F.explode(F.coalesce(copies, F.array(slot))))
    return [sent.filter(F.col("slice") == i).drop("slice", "k") for i in range(4)]


@query
def stream_late_events(f):
    """Each event that arrived is accepted, repeated or late; the three add up to the feed."""
    root = scratch_path(f.spark, "late")
    in_slices(f, RAW_SCHEMAS["events"], arrivals(f), lambda raw: ordered.keep_with_late(raw, "ts", "event_id", DELAY, root, f"{root}/cp"))
    out = None
    for side in ordered.SIDES:
        rows = ordered.parted(f.spark, root, side)
        copies = F.sum("copies") if side == "repeated" else F.count(F.lit(1))
        counts = rows.groupBy(F.lit(side).alias("side"), F.to_date("ts").alias("date"), "event_type").agg(copies.alias("events"))
        out = counts if out is None else out.unionByName(counts)
    return out


_LATE = """
    WITH sent AS (
        SELECT event_id, event_type, ts, k, least(3, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1
               ELSE 2 END + CASE WHEN k % 17 = 5 THEN 2 WHEN k % 10 = 3 THEN 1 ELSE 0 END) AS slot FROM ev),
    arrived AS (
        SELECT event_id, event_type, ts, slot FROM sent
        UNION ALL SELECT event_id, event_type, ts, slot FROM sent WHERE event_type = 'purchase'
        UNION ALL SELECT event_id, event_type, ts, least(3, slot + 1) FROM sent WHERE event_type = 'view' AND k % 3 = 0),
    judged AS (
        SELECT *, ts < (SELECT max(ts) FROM arrived b WHERE b.slot < a.slot) - INTERVAL 8 DAY AS late FROM arrived a)
    SELECT CASE WHEN late THEN 'late' WHEN nth = 1 THEN 'accepted' ELSE 'repeated' END AS side, CAST(ts AS DATE) AS date, event_type,
           count(*) AS events
    FROM (SELECT event_id, event_type, ts, coalesce(late, FALSE) AS late,
                 row_number() OVER (PARTITION BY event_id, coalesce(late, FALSE) ORDER BY slot) AS nth FROM judged)
    GROUP BY 1, 2, 3"""

# ---- JSON requests --------------------------------------------------------------------
@query
def stream_json_requests(f):
    """Activity requests as lines of JSON, some broken, through the gates; the log is moved into day folders as it grows."""
    root = scratch_path(f.spark, "json-ingest")
    requests = shapes.requests_from(f.ev)
    body = F.to_json(F.struct(*requests.columns))
    text = requests.select("id", "event_time", F.when(F.col("id") % 10 == 3, F.concat(F.lit("{"), body)).otherwise(body).alias("value"))
    fields = [x for x in requests.schema if x.name != "event_time"]
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in fields) + ", event_time TIMESTAMP_NTZ"
    folder = scratch_path(f.spark, "json-lines")
    for part in dealt(text, "id", 3):
        part.select("value").write.mode("append").text(folder)
        feed = readers.parse_requests(stream_files(f.spark, folder, "value STRING", "text"), schema)
        judged = lookups.normalise_requests(feed)
        feeds.ingest(judged, "activity", f.sessions, f.admins, root, f"{root}/cp").awaitTermination()
        for side in ("accepted", "quarantine"):
            feeds.compact_ingested(f.spark, root, side)
    refused = feeds.ingested(f.spark, root, "quarantine").groupBy("reason").agg(F.count(F.lit(1)).alias("requests"))
    accepted = feeds.ingested(f.spark, root).groupBy(F.to_date("created_at").cast("string").alias("reason")).agg(F.count(F.lit(1)).alias("requests"))
    week = feeds.ingested(f.spark, root, days=("2024-01-08", "2024-01-14")).agg(F.count(F.lit(1)).alias("requests"))
    return refused.unionByName(accepted).unionByName(week.select(F.lit("one week").alias("reason"), "requests"))


@query
def knowledge_by_use(f):
    """Keyword rules by priority, with the messages that each category answers."""
    used = lookups.match_intents(f.chat_messages, f.knowledge_base).groupBy("category").agg(F.count(F.lit(1)).alias("messages"))
    listed = catalog.knowledge_by_priority(f.knowledge_base)
    return listed.join(used, "category", "left").select("category", "priority", F.coalesce("messages", F.lit(0)).alias("messages"))


_JSON_REQUESTS = f"""
    WITH judged AS (
        SELECT CASE WHEN id % 10 = 3 THEN 'malformed' WHEN activity_type IS NULL OR description IS NULL THEN 'incomplete'
                    WHEN id NOT IN (SELECT id FROM ({_ACCEPTED})) THEN 'no active session' END AS reason, ts FROM requests)
    SELECT coalesce(reason, CAST(CAST(ts AS DATE) AS VARCHAR)) AS reason, count(*) AS requests FROM judged GROUP BY 1
    UNION ALL SELECT 'one week', count(*) FROM judged WHERE reason IS NULL AND CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"""


# ---- live sessions and joins of streams ---------------------------------------------
def _with_end(f: Fixtures, parts: list[DataFrame]) -> list[DataFrame]:
    """One more slice with a far event, so that the watermark passes all others."""
    end = f.spark.sql(
        "SELECT -1L AS event_id, TIMESTAMP_NTZ '2034-01-01 00:00:00' AS ts, -1L AS user_id, 'signup' AS event_type, 0D AS value, '1' AS props"
    )
    return [*parts, end]


def _drained(f: Fixtures, parts: list[DataFrame], job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that a stateful job has given out after all slices."""
    root = scratch_path(f.spark, "drained")

    def start(raw: DataFrame) -> StreamingQuery:
        sink = job(raw).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
        return feeds.run(sink)

    in_slices(f, RAW_SCHEMAS["events"], _with_end(f, parts), start)
    return f.spark.read.parquet(f"{root}/out")


def _ntz(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


@query
def stream_cut_sessions(f):
    """Live sessions with pauses of up to eight hours, cut at 24 hours by the stream's own state."""
    cuts = [F.col("ts") < "2024-01-11", (F.col("ts") >= "2024-01-11") & (F.col("ts") < "2024-01-21"), F.col("ts") >= "2024-01-21"]
    with rocksdb_state(f.spark):
        closed = _drained(
            f,
            [f.raw("events").filter(part) for part in cuts],
            lambda raw: live.cut_sessions(feeds.event_time(raw.withColumnRenamed("user_id", "admin_id"), "ts"), "admin_id", "ts", 8 * 3600, "1 hour"),
        )
    return closed.select("admin_id", _ntz("session_start"), _ntz("session_end"), "session_seconds", "event_count")


@query
def stream_session_ends(f):
    """Logins joined with logouts of the same live feed, which comes in shuffled slices."""

    def job(raw: DataFrame) -> DataFrame:
        feed = feeds.event_time(shapes.session_events_from(shapes.with_k(raw)), "event_time")
        return live.session_ends(feed.filter("kind = 'login'"), feed.filter("kind = 'logout'"), "40 days")

    ends = _drained(f, dealt(f.raw("events"), "event_id", 3), job).filter("session_id >= 0")
    return ends.select("session_id", "admin_id", _ntz("login_time"), _ntz("logout_time"), "session_duration")


@query
def stream_unanswered(f):
    """Failed requests that no retry of the same feed answers."""

    def job(raw: DataFrame) -> DataFrame:
        ev = shapes.with_k(raw)
        failed = feeds.event_time(shapes.retry_queue(ev.filter("event_type = 'error' OR event_id < 0")), "timestamp")
        answered = feeds.event_time(shapes.retry_queue(ev.filter("event_type = 'error' AND value < 50 OR event_id < 0")), "timestamp")
        return live.unanswered(failed, answered, "timestamp", ["method", "endpoint"], "40 days")

    left = _drained(f, dealt(f.raw("events"), "event_id", 3), job)
    return left.select(_ntz("timestamp"), "method", "endpoint", "data").filter(F.col("timestamp") < "2034-01-01")


# ---- distinct users -------------------------------------------------------------------
@query
def users_rolling(f):
    """Different users of the seven days up to each day, from day rows that four shuffled batches add up to."""
    return registers.rolling_users(_any_order_of(f.transactions, registers.DAY_USERS), 7)


def _any_order_of(feed: DataFrame, rule: registers.Registers) -> DataFrame:
    return registers.folded([registers.state_of(part, rule) for part in dealt(feed, "id")], rule)


@query
def users_rolling_sketch(f):
    """Days on which the sketch of seven days keeps its bound against the exact count."""
    exact = users_rolling(f).withColumnRenamed("users", "exact")
    sketched = registers.rolling_estimates(_any_order_of(f.transactions, registers.DAY_SKETCHES), 7)
    miss = F.abs(F.col("users") - F.col("exact"))
    return exact.join(sketched, "date").select("date", (miss <= F.greatest(F.lit(1), registers.SKETCH_BOUND * F.col("exact"))).alias("within"))


@query
def stream_users_rolling(f):
    """The bitmaps kept by a stream of shuffled slices."""
    root = scratch_path(f.spark, "day-users")

    def start(raw: DataFrame) -> StreamingQuery:
        feed = shapes.points_from(raw).select("user_id", F.col("event_time").alias("timestamp"))
        return ordered.keep_states(feed, registers.DAY_USERS, root, f"{root}/cp")

    in_slices(f, RAW_SCHEMAS["orders"], dealt(f.raw("orders"), "o_orderkey"), start)
    return registers.rolling_users(ordered.kept_state(f.spark, root, registers.DAY_USERS), 7)


_ROLLING = """
    SELECT d.date, count(DISTINCT t.user_id) AS users
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM tx) d
    JOIN (SELECT DISTINCT CAST(ts AS DATE) AS date, user_id FROM tx) t ON t.date BETWEEN d.date - 6 AND d.date GROUP BY 1"""


# ---- leaderboard by batches ---------------------------------------------------------
BOARD_CUTS = ("1994-06-01", "1997-01-01", "2030-01-01")


@query
def leaderboard_incremental(f):
    """The board after each of three batches, each of which touches only the buckets of its users."""
    root = scratch_path(f.spark, "board")
    board.start_board(f.profiles, root)
    out, before, low = None, f.profiles, None
    for stage, cut in enumerate(BOARD_CUTS, 1):
        upto = F.col("event_time") < F.lit(cut).cast("timestamp_ntz")
        batch = f.points_feed.filter(upto if low is None else upto & (F.col("event_time") >= F.lit(low).cast("timestamp_ntz")))
        touched = batch.select("user_id").distinct()
        old = before.join(touched, "user_id", "left_semi")
        new = board.entries(folds.merge_points(old, folds.points_batch(batch)))
        changes = new.join(old.select("user_id", F.col("eco_points").cast("long").alias("old_points")), "user_id", "left")
        board.update_board(changes, root, stage, keep=len(BOARD_CUTS))
        shown = board.read_board(f.spark, root, stage).withColumn("stage", F.lit(stage))
        out = shown if out is None else out.unionByName(shown)
        before, low = folds.merge_points(f.profiles, folds.points_batch(f.points_feed.filter(upto))), cut
    return out


def _board_sql() -> str:
    after = BASE["profiles_after"].replace("FROM tx GROUP BY", "FROM tx WHERE ts < TIMESTAMP '{cut}' GROUP BY")
    stages = [
        f"SELECT user_id, coalesce(display_name, email, user_id) AS display_name, eco_points, "
        f"row_number() OVER (ORDER BY eco_points DESC, joined_at, user_id) AS rank_position, {stage} AS stage "
        f"FROM ({after.format(cut=cut)}) WHERE eco_points > 0"
        for stage, cut in enumerate(BOARD_CUTS, 1)
    ]
    return " UNION ALL ".join(stages)


# ---- deletes along references -----------------------------------------------------------
def _graph_tables(f: Fixtures) -> dict[str, DataFrame]:
    tables = {
        name: frame
        for name, frame in named_tables(f).items()
        if name in ("admins", "admin_sessions", "admin_page_visits", "admin_security_events", "feature_usage_tracking", "chatbot_users",
                    "user_preferences", "chat_sessions", "chat_messages", "user_feedback")
    }
    tables["admin_activity_log"] = f.activity_log.withColumn("session_id", F.col("id") - F.col("target_id").cast("long") % 4)
    tables["admin_security_events"] = tables["admin_security_events"].withColumn("resolved_by", (F.col("admin_id") + 1).cast("long"))
    tables["user_feedback"] = tables["user_feedback"].withColumn("message_id", F.col("message_id") + F.when(F.col("id") % 3 == 0, 1000).otherwise(0))
    return tables


_GRAPH_KEYS = {"feature_usage_tracking": ["admin_id", "feature_name"], "user_preferences": ["user_id", "preference_key"],
               "chatbot_users": ["user_id"]}
_GRAPH_REFS = {
    "admin_sessions": ["admin_id"], "admin_activity_log": ["admin_id", "session_id"], "admin_page_visits": ["admin_id"],
    "admin_security_events": ["admin_id", "resolved_by"], "feature_usage_tracking": ["admin_id"], "user_preferences": ["user_id"],
    "chat_sessions": ["user_id"], "chat_messages": ["user_id", "session_id"], "user_feedback": ["user_id", "message_id"],
}


@query
def delete_graph(f):
    """Every dependent row after deleting the inactive admins and a quarter of the chat users, with its references."""
    tables = _graph_tables(f)
    deleted = {
        "admins": f.admins.filter(~F.col("is_active")).select("id"),
        "chatbot_users": f.chat_users.filter(F.col("user_id").cast("long") % 4 == 1).select("user_id"),
    }
    out = None
    for name, frame in cascade.delete_graph(tables, deleted).items():
        text = lambda names: F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names])
        rows = frame.select(
            F.lit(name).alias("table_name"), text(_GRAPH_KEYS.get(name, ["id"])).alias("row_key"), text(_GRAPH_REFS.get(name, [])).alias("refs")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _graph_sql() -> str:
    """Each table by its own rules, one level after the other."""
    text = lambda names: " || '|' || ".join(f"coalesce(CAST({n} AS VARCHAR), '-')" for n in names) or "''"
    bodies = {
        "admins": "SELECT id FROM admins WHERE is_active",
        "admin_sessions": "SELECT id, admin_id FROM sessions WHERE admin_id NOT IN (SELECT id FROM out_admins)",
        "admin_activity_log": """SELECT id, admin_id, CASE WHEN (id - k % 4) NOT IN (SELECT id FROM out_sessions) THEN id - k % 4 END AS session_id
            FROM (SELECT *, CAST(target_id AS INT) AS k FROM activity_log) WHERE admin_id NOT IN (SELECT id FROM out_admins)""",
        "admin_page_visits": "SELECT id, admin_id FROM page_view_rows WHERE admin_id NOT IN (SELECT id FROM out_admins)",
        "admin_security_events": """SELECT id, CASE WHEN admin_id NOT IN (SELECT id FROM out_admins) THEN admin_id END AS admin_id,
            CASE WHEN admin_id + 1 NOT IN (SELECT id FROM out_admins) THEN admin_id + 1 END AS resolved_by FROM security""",
        "feature_usage_tracking": "SELECT admin_id, feature_name FROM feature_usage WHERE admin_id NOT IN (SELECT id FROM out_admins)",
        "chatbot_users": "SELECT user_id FROM chat_users WHERE user_id NOT IN (SELECT user_id FROM out_users)",
        "user_preferences": f"SELECT user_id, preference_key FROM {_NAMED['user_preferences']} WHERE user_id NOT IN (SELECT user_id FROM out_users)",
        "chat_sessions": "SELECT id, user_id FROM chat_sessions WHERE user_id NOT IN (SELECT user_id FROM out_users)",
        "chat_messages": """SELECT id, user_id, session_id FROM chat_messages WHERE user_id NOT IN (SELECT user_id FROM out_users)
            AND session_id NOT IN (SELECT session_id FROM chat_sessions WHERE user_id IN (SELECT user_id FROM out_users))""",
        "user_feedback": """SELECT id, user_id, CASE WHEN NOT EXISTS (SELECT 1 FROM chat_messages m WHERE m.id = moved AND m.user_id IN
            (SELECT user_id FROM out_users)) THEN moved END AS message_id
            FROM (SELECT *, id + CASE WHEN id % 3 = 0 THEN 1000 ELSE 0 END AS moved FROM feedback)
            WHERE user_id NOT IN (SELECT user_id FROM out_users)""",
    }
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {text(_GRAPH_KEYS.get(name, ['id']))} AS row_key, {text(_GRAPH_REFS.get(name, []))} AS refs FROM ({body})"
        for name, body in bodies.items()
    )
    return f"""WITH out_admins AS (SELECT id FROM admins WHERE NOT is_active),
        out_users AS (SELECT user_id FROM chat_users WHERE CAST(user_id AS BIGINT) % 4 = 1),
        out_sessions AS (SELECT id FROM sessions WHERE admin_id IN (SELECT id FROM out_admins)) {rows}"""


# ---- events inside sessions -------------------------------------------------------------
@query
def session_activity(f):
    """Activities of its admin between the login and the logout of each session."""
    closed = f.sessions.select(F.col("id").alias("session_id"), "admin_id", "login_time", "logout_time")
    inside = intervals.events_in_intervals(
        closed, f.activity_log.select("admin_id", "created_at", "execution_time_ms"), ["admin_id"], "login_time", "logout_time", "created_at", 6 * 3600
    )
    counted = inside.groupBy("session_id").agg(F.count(F.lit(1)).alias("activities"), F.sum("execution_time_ms").alias("spent_ms"))
    return closed.join(counted, "session_id", "left").select("session_id", F.coalesce("activities", F.lit(0)).alias("activities"), "spent_ms")


# ---- JSON payloads -------------------------------------------------------------------------
@query
def payload_changes(f):
    """Most-changed fields of a log of old and new rows as JSON, with the sum of numeric changes; broken payloads are counted apart."""
    after = state.points_fold(f.profiles, f.points_feed)
    fields = ["display_name", "email", "eco_points"]
    pack = lambda side: F.to_json(F.struct(*[F.col(f"{side}.{c}").alias(c) for c in fields]))
    log = f.profiles.alias("o").join(after.alias("n"), "user_id").select("user_id", pack("o").alias("old_values"), pack("n").alias("new_values"))
    broken = F.col("user_id").cast("long") % 13 == 0
    log = log.withColumn("new_values", F.when(broken, F.concat(F.lit("{"), "new_values")).otherwise(F.col("new_values")))
    rows = payloads.parsed(log, ["old_values", "new_values"])
    sound = rows.filter("NOT malformed")
    moved = payloads.typed(F.col("new_values"), "$.eco_points", "bigint") - payloads.typed(F.col("old_values"), "$.eco_points", "bigint")
    none = F.lit(None).cast("long")
    changes = payloads.changed_fields(sound, "user_id", "old_values", "new_values").groupBy("field").agg(F.count(F.lit(1)).alias("changes"))
    bad = rows.filter("malformed").agg(F.lit("(malformed)").alias("field"), F.count("new_values_text").alias("changes"))
    total = sound.agg(F.lit("eco_points").alias("field"), F.lit(0).cast("long").alias("changes"), F.sum(moved).alias("moved"))
    parts = changes.withColumn("moved", none).unionByName(bad.withColumn("moved", none)).unionByName(total)
    return parts.groupBy("field").agg(F.sum("changes").alias("changes"), F.max("moved").alias("moved")).filter("changes > 0")


ORACLE.update({name: with_base(body) for name, body in {
    "points_any_order": _BODIES["points_upsert"],
    "stream_points_any_order": _BODIES["points_upsert"],
    "features_any_order": _BODIES["feature_upsert"],
    "users_any_order": _BODIES["user_upsert"],
    "stream_late_events": _LATE,
    "stream_json_requests": _JSON_REQUESTS,
    "knowledge_by_use": f"""
        SELECT b.category, b.priority, count(m.id) AS messages
        FROM {_NAMED['ai_knowledge_base']} b LEFT JOIN ({_BODIES['intent_match']}) m ON m.category = b.category GROUP BY 1, 2""",
    "stream_cut_sessions": _BODIES["sessionize"],
    "stream_session_ends": """
        WITH live AS (SELECT o.* FROM logouts o JOIN ev ON ev.event_id = o.session_id % 1000000000 WHERE ev.k % 5 <> 0)
        SELECT s.id AS session_id, s.admin_id, s.login_time, o.ts AS logout_time,
               coalesce(date_sub('second', s.login_time, o.ts), 0) AS session_duration
        FROM sessions s LEFT JOIN live o ON o.session_id = s.id AND o.admin_id = s.admin_id
             AND o.ts BETWEEN s.login_time AND s.login_time + INTERVAL 1 DAY""",
    "stream_unanswered": _BODIES["retry_remaining"],
    "users_rolling": _ROLLING,
    "stream_users_rolling": _ROLLING,
    "users_rolling_sketch": "SELECT DISTINCT CAST(ts AS DATE) AS date, TRUE AS within FROM tx",
    "leaderboard_incremental": _board_sql(),
    "delete_graph": _graph_sql(),
    "session_activity": """
        SELECT s.id AS session_id, count(l.id) AS activities, CAST(sum(l.execution_time_ms) AS BIGINT) AS spent_ms
        FROM sessions s LEFT JOIN activity_log l ON l.admin_id = s.admin_id AND l.created_at BETWEEN s.login_time AND s.logout_time
        GROUP BY s.id""",
    "payload_changes": """
        WITH both_rows AS (SELECT p.user_id, p.display_name AS d0, p.email AS e0, p.eco_points AS p0, a.display_name AS d1,
                                  a.email AS e1, a.eco_points AS p1, CAST(p.user_id AS BIGINT) % 13 = 0 AS broken
                           FROM profiles p JOIN profiles_after a ON a.user_id = p.user_id)
        SELECT * FROM (
            SELECT 'display_name' AS field, count(*) FILTER (WHERE d0 IS DISTINCT FROM d1 AND NOT broken) AS changes, CAST(NULL AS BIGINT) AS moved
            FROM both_rows
            UNION ALL SELECT 'email', count(*) FILTER (WHERE e0 IS DISTINCT FROM e1 AND NOT broken), NULL FROM both_rows
            UNION ALL SELECT 'eco_points', count(*) FILTER (WHERE p0 IS DISTINCT FROM p1 AND NOT broken),
                             CAST(sum(p1 - p0) FILTER (WHERE NOT broken) AS BIGINT) FROM both_rows) WHERE changes > 0
        UNION ALL SELECT '(malformed)', count(*) FILTER (WHERE broken), NULL FROM both_rows HAVING count(*) FILTER (WHERE broken) > 0""",
}.items()})
