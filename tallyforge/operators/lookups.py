"""Ingest gates and lookups against reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tallyforge.functions import client
from tallyforge.functions.ids import session_token, stable_id
from tallyforge.functions.dates import seconds_between
from tallyforge.functions.labels import all_of, name_or_id
from tallyforge.operators.ranking import steps_up_to
from tallyforge.sources.schemas import DEFAULTS, REQUIRED_FIELDS, schema_of


# ---- ingest ---------------------------------------------------------------
def normalise_requests(feed: DataFrame) -> DataFrame:
    """Clients send the text under either of two names."""
    return feed.withColumn("description", F.coalesce("description", "activity_description")).drop(
        "activity_description"
    )


def is_complete(required: list[str]) -> Column:
    return all_of([F.col(c).isNotNull() for c in required])


def split_required(feed: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) by presence of every required field."""
    return feed.filter(is_complete(required)), feed.filter(~is_complete(required))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill absent values the way the table's defaults would."""
    present = {name: value for name, value in defaults.items() if name in df.columns}
    types = dict(df.dtypes)
    return df.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value).cast(types[name])) for name, value in present.items()}
    )


def authenticate(feed: DataFrame, sessions: DataFrame, admins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with session and admin, rejected) by active session token."""
    active = active_sessions(sessions, admins)
    accepted = feed.join(active, "session_token")
    rejected = feed.join(active.select("session_token"), "session_token", "left_anti")
    return accepted, rejected


def active_sessions(sessions: DataFrame, admins: DataFrame) -> DataFrame:
    return (
        sessions.filter("is_active")
        .select("session_token", F.col("id").alias("session_id"), "admin_id")
        .join(admins.select(F.col("id").alias("admin_id"), "username", "display_name"), "admin_id")
    )


# feeds that need an active session; logins, logouts and security events come without one
WITH_SESSION = ("activity", "page_visit")
MALFORMED, INCOMPLETE, NO_SESSION = "malformed", "incomplete", "no active session"


def with_reason(feed: DataFrame, kind: str, sessions: DataFrame, admins: DataFrame) -> DataFrame:
    """Every request with ``reason``: why it is refused, or NULL, and its session and admin if it needs them.

    One pass over the feed: the parts that are accepted and refused always add up to it.
    """
    malformed = F.col("malformed").isNotNull() if "malformed" in feed.columns else F.lit(False)
    reason = F.when(malformed, MALFORMED).when(~is_complete(REQUIRED_FIELDS[kind]), INCOMPLETE)
    if kind not in WITH_SESSION:
        return feed.withColumn("reason", reason)
    active = active_sessions(sessions, admins).select("session_token", "session_id", "admin_id")
    found = feed.drop("session_id", "admin_id").join(active, "session_token", "left")
    return found.withColumn("reason", reason.when(F.col("session_id").isNull(), NO_SESSION))


def accepted_rows(judged: DataFrame, kind: str) -> DataFrame:
    """What accepted requests of a feed add to its table."""
    rows = {"activity": log_rows, "page_visit": page_visit_rows, "security_event": security_event_rows}[kind]
    return rows(judged.filter("reason IS NULL"))


def quarantined_rows(judged: DataFrame, kind: str) -> DataFrame:
    """Refused requests as they came, with the reason."""
    body = F.to_json(F.struct(*[F.col(c) for c in judged.columns if c not in ("reason", "session_id")]))
    return judged.filter("reason IS NOT NULL").select(
        "id", F.lit(kind).alias("feed"), "reason", body.alias("body"), "event_time"
    )


def _fitted(rows: DataFrame, table: str, values: dict[str, Column]) -> DataFrame:
    """Rows in the declared layout of a table: given values, else the column so named, else the default or NULL."""
    defaults = DEFAULTS.get(table, {})

    def value(field: T.StructField) -> Column:
        given = values.get(field.name)
        if given is None:
            given = F.col(field.name) if field.name in rows.columns else F.lit(None)
        given = given.cast(field.dataType)
        if field.name in defaults:
            given = F.coalesce(given, F.lit(defaults[field.name]).cast(field.dataType))
        return given.alias(field.name)

    return rows.select(*[value(field) for field in schema_of(table)])


def _sent(rows: DataFrame, name: str, otherwise: str | None = None) -> Column:
    """A column a client may leave out."""
    column = F.col(name) if name in rows.columns else F.lit(None).cast("string")
    return column if otherwise is None else F.coalesce(column, F.lit(otherwise))


def _client(rows: DataFrame) -> dict[str, Column]:
    return {
        "ip_address": _sent(rows, "ip_address", "unknown"),
        "user_agent": _sent(rows, "user_agent", "unknown"),
        "created_at": F.col("event_time"),
    }


def log_rows(accepted: DataFrame) -> DataFrame:
    """Authenticated requests in activity-log layout; the status is the event's own."""
    values = {"activity_description": F.col("description"), "request_url": _sent(accepted, "request_url", "")}
    texts = {name: F.nullif(_sent(accepted, name), F.lit("")) for name in ("old_values", "new_values", "additional_data")}
    return _fitted(accepted, "admin_activity_log", {**values, **texts, **_client(accepted)})


def page_visit_rows(accepted: DataFrame) -> DataFrame:
    """Authenticated visits; what the client does not say of itself is read from its agent and screen."""
    agent = _sent(accepted, "user_agent")
    width = client.screen_width(_sent(accepted, "screen_resolution"))
    facts = {
        "browser_name": F.coalesce(_sent(accepted, "browser_name"), F.when(agent.isNotNull(), client.browser_name(agent))),
        "browser_version": F.coalesce(_sent(accepted, "browser_version"), client.browser_version(agent)),
        "os_name": F.coalesce(_sent(accepted, "os_name"), F.when(agent.isNotNull(), client.os_name(agent))),
        "device_type": F.coalesce(_sent(accepted, "device_type"), F.when(width.isNotNull(), client.device_type(width))),
    }
    return _fitted(accepted, "admin_page_visits", {**facts, **_client(accepted)})


def security_event_rows(accepted: DataFrame) -> DataFrame:
    """Security events; they need no session and may name no admin."""
    extra = {"additional_data": F.nullif(_sent(accepted, "additional_data"), F.lit(""))}
    return _fitted(accepted, "admin_security_events", {**extra, **_client(accepted)})


# ---- login and logout -----------------------------------------------------
def login_sessions(logins: DataFrame) -> DataFrame:
    """The session a login opens, with a token derived from the login itself."""
    return logins.select(
        F.col("id").alias("session_id"),
        "admin_id",
        session_token(F.col("login_time"), F.col("admin_id"), F.col("id")).alias("session_token"),
        "ip_address",
        "login_time",
        F.lit(True).alias("is_active"),
    )


def login_log(logins: DataFrame) -> DataFrame:
    return logins.select(
        "admin_id",
        F.col("id").alias("session_id"),
        F.lit("LOGIN").alias("activity_type"),
        F.lit("AUTHENTICATION").alias("activity_category"),
        F.lit("Admin logged in successfully").alias("activity_description"),
        "ip_address",
        F.col("login_time").alias("created_at"),
    )


CLOSED, LOGGED, REJECTED = "closed", "logged", "rejected"


def match_logouts(logouts: DataFrame, sessions: DataFrame, admins: DataFrame) -> DataFrame:
    """Each logout with what becomes of it.

    ``closed``: the session is this admin's; it ends and a log row tells its seconds.
    ``logged``: the session is another admin's; it stays as it is, and a log row with 0 seconds
    and that session's address is written all the same. ``rejected``: no log row, since the
    session or the admin is unknown, or the session has no login time. An unknown
    admin's own session still closes (:func:`close_sessions`).
    """
    known = sessions.select(
        F.col("id").alias("session_id"), F.col("admin_id").alias("_owner"), "login_time", "ip_address"
    )
    named = admins.select(F.col("id").alias("admin_id"), F.lit(True).alias("_named"))
    own = F.col("_owner") == F.col("admin_id")
    seconds = F.when(own, seconds_between("login_time", "event_time")).otherwise(F.lit(0))
    valid = F.col("_named") & F.col("ip_address").isNotNull() & F.col("_seconds").isNotNull()
    outcome = F.when(F.coalesce(valid, F.lit(False)), F.when(own, CLOSED).otherwise(LOGGED)).otherwise(REJECTED)
    return (
        logouts.select("session_id", "admin_id", "event_time")
        .join(known, "session_id", "left")
        .join(named, "admin_id", "left")
        .withColumn("_seconds", F.when(F.col("_owner").isNotNull(), seconds))
        .withColumn("outcome", outcome)
        .select(
            "session_id",
            "admin_id",
            "outcome",
            F.when(own, F.col("login_time")).alias("login_time"),
            "event_time",
            "ip_address",
            F.col("_seconds").cast("long").alias("session_duration"),
            F.concat(F.lit("Admin logged out after "), F.col("_seconds").cast("string"), F.lit(" seconds")).alias(
                "description"
            ),
        )
    )


def close_sessions(logouts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions closed by a logout that names both session and admin."""
    known = sessions.select(F.col("id").alias("session_id"), "admin_id", "login_time")
    return logouts.join(known, ["session_id", "admin_id"]).select(
        "session_id",
        "admin_id",
        "login_time",
        F.col("event_time").alias("logout_time"),
        F.lit(False).alias("is_active"),
        seconds_between("login_time", "event_time").alias("session_duration"),
    )


def apply_logouts(sessions: DataFrame, logouts: DataFrame) -> DataFrame:
    """The session table after a batch of logouts; of several, the last one counts."""
    last = logouts.groupBy(F.col("session_id").alias("id"), "admin_id").agg(F.max("event_time").alias("_out"))
    closed = F.col("_out").isNotNull()
    updates = {
        "session_duration": F.when(closed, seconds_between("login_time", "_out")).otherwise(F.col("session_duration")),
        "logout_time": F.coalesce("_out", "logout_time"),
        "is_active": F.when(closed, False).otherwise(F.col("is_active")),
    }
    return sessions.join(last, ["id", "admin_id"], "left").select(
        *[updates[c].alias(c) if c in updates else F.col(c) for c in sessions.columns]
    )


def logout_log(logouts: DataFrame, sessions: DataFrame, admins: DataFrame) -> DataFrame:
    """The log rows that logouts write."""
    return match_logouts(logouts, sessions, admins).filter(F.col("outcome") != REJECTED).select(
        "admin_id",
        "session_id",
        F.lit("LOGOUT").alias("activity_type"),
        F.lit("AUTHENTICATION").alias("activity_category"),
        F.col("description").alias("activity_description"),
        "ip_address",
        F.col("event_time").alias("created_at"),
    )


def chat_session_rows(starts: DataFrame) -> DataFrame:
    """The row a chat session opens with; its id is derived from the start event."""
    return starts.select(
        stable_id(F.col("user_id"), F.col("started_at").cast("date"), F.col("id")).alias("session_id"),
        "user_id",
        "session_name",
        F.lit(True).alias("is_active"),
        "started_at",
        F.lit(None).cast("timestamp_ntz").alias("ended_at"),
        F.lit(0).alias("message_count"),
        F.lit(0).alias("total_tokens_used"),
    )


def remaining_retries(failed: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Failed requests that no retry completed."""
    return failed.join(succeeded, ["timestamp", "method", "endpoint"], "left_anti")


# ---- reference-table lookups ----------------------------------------------
def detection_points(detections: DataFrame, mapping: DataFrame, categories: DataFrame) -> DataFrame:
    """Scored detections to category points; class, threshold and both active flags."""
    rules = (
        mapping.filter("is_active")
        .join(
            categories.filter("is_active").select(F.col("category_name").alias("waste_category"), "points_value"),
            "waste_category",
        )
        .select("coco_class", "waste_category", "confidence_threshold", "points_value")
    )
    return detections.join(rules, "coco_class").filter(F.col("confidence") >= F.col("confidence_threshold"))


def affordable_rewards(profiles: DataFrame, rewards: DataFrame) -> DataFrame:
    """Per user: how many active rewards are within reach, and the dearest of them.

    Both sides are first reduced to distinct integers, so neither a points value
    shared by a third of the users nor a large catalogue meets in one task, and
    no user x reward rows are built.
    """
    steps = (
        rewards.filter("is_active")
        .groupBy(F.col("cost_points").alias("v"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct(F.col("cost_points").alias("cost"), F.col("id").alias("reward_id"))).alias("best"),
        )
    )
    values = profiles.select(F.col("eco_points").alias("v")).distinct()
    reach = steps_up_to(values, steps)
    return (
        profiles.select("user_id", name_or_id(F.col("display_name"), F.col("email"), F.col("user_id")).alias("name"),
                        "eco_points")
        .join(reach, F.col("eco_points") == F.col("v"))
        .select(
            "user_id",
            "name",
            "eco_points",
            F.col("n").alias("affordable_count"),
            F.col("best.reward_id").alias("best_reward_id"),
            F.col("best.cost").alias("best_cost"),
        )
    )


# ---- intents --------------------------------------------------------------
#: Words of 63 bits that mark which hashes occur; 32,256 bits whatever the number of keywords.
SIFT_SLOTS = 512


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SIFT_SLOTS)).cast("int")


def _mark(word: Column) -> Column:
    """One of 63 bits by another part of the hash."""
    place = F.pmod(F.shiftrightunsigned(F.xxhash64(word), 20), F.lit(63)).cast("int")
    return F.element_at(F.array(*[F.lit(1 << n).cast("long") for n in range(63)]), place + 1)


def _sift(words: DataFrame) -> Column:
    """Marks of all words as one array of fixed size, for use in any expression."""
    marks = words.groupBy(_slot(F.col("word")).alias("slot")).agg(F.bit_or(_mark(F.col("word"))).alias("bits"))
    held = marks.agg(F.map_from_entries(F.collect_list(F.struct("slot", "bits"))).alias("held"))
    every = F.transform(F.sequence(F.lit(0), F.lit(SIFT_SLOTS - 1)), lambda n: F.coalesce(F.element_at("held", n), F.lit(0).cast("long")))
    return held.select(every.alias("marks")).scalar()


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def intent_keywords(knowledge: DataFrame) -> DataFrame:
    """One row per (category, keyword phrase)."""
    listed = F.explode(F.from_json("keywords", "array<string>"))
    return (
        knowledge.filter("is_active")
        .select("category", "priority", listed.alias("keyword"))
        .select("category", "priority", F.array_join(_words(F.col("keyword")), " ").alias("phrase"))
        .distinct()
    )


def match_intents(messages: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Best intent per message: most keywords found, then the higher priority.

    A message's distinct words meet the first word of each keyword phrase in an equality join;
    only on those pairs is the whole phrase looked up in the message. Words whose mark no first word has go
    beforehand, so that a text is copied for hits and the few words that share a mark with one.
    """
    keywords = intent_keywords(knowledge).withColumn("word", F.substring_index("phrase", " ", 1))
    sifted = F.filter(F.array_distinct("_words"), lambda w: F.get("_marks", _slot(w)).bitwiseAND(_mark(w)) != 0)
    marked = messages.select("id", _words(F.col("message_content")).alias("_words"), _sift(keywords).alias("_marks"))
    words = marked.select(
        "id",
        F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")).alias("_text"),
        F.explode(sifted).alias("word"),
    )
    found = F.contains("_text", F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    hits = (
        words.join(keywords, "word")
        .filter(found)
        .groupBy("id", "category", "priority")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    best = F.min(F.struct((-F.col("hits")).alias("h"), (-F.col("priority")).alias("p"), F.col("category").alias("c")))
    return (
        hits.groupBy("id")
        .agg(best.alias("best"))
        .select("id", F.col("best.c").alias("category"), (-F.col("best.h")).alias("hits"))
    )
