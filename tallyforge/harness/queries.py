"""Every registered query: (session, data folder) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.functions import client
from tallyforge.functions.dates import in_days, preset_range, younger_than
from tallyforge.harness.fixtures import AS_OF, DAY, RANGE_END, RAW_SCHEMAS, SPLIT_DAY, Fixtures, literal_ts
from tallyforge.harness import fixtures as shapes
from tallyforge.operators import folds, lookups, merge, quality, sessions as sessioning
from tallyforge.plans import activity, catalog, chat, dashboard, reports, rewards, rollups
from tallyforge.session import scratch_path
from tallyforge.sources import readers, sinks
from tallyforge.sources.readers import stream_files
from tallyforge.sources.schemas import DEFAULTS, REQUIRED_FIELDS
from tallyforge.streaming import feeds, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END = preset_range("7d", RANGE_END)


def query(function: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    """Register a function of the fixtures under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(Fixtures(spark, sf_dir))

    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return function


def as_of() -> Column:
    return literal_ts(AS_OF.isoformat(sep=" "))


def usage_of(f: Fixtures) -> DataFrame:
    return folds.start_features(folds.feature_batch(f.activity_log))


def performance_of(f: Fixtures) -> DataFrame:
    return rollups.performance_rollup(f.sessions, f.activity_log, f.page_visits)


def system_of(f: Fixtures) -> DataFrame:
    return rollups.system_rollup(f.sessions, f.activity_log, f.page_visits, usage_of(f))


def tables_of(f: Fixtures) -> reports.Tables:
    return reports.Tables(
        sessions=f.sessions,
        log=f.activity_log,
        visits=f.page_visits,
        events=f.security_events,
        usage=usage_of(f),
        admins=f.admins,
        performance=performance_of(f),
        system=system_of(f),
    )


# ---- views ------------------------------------------------------------------
@query
def v_admin_activity_summary(f):
    return activity.admin_activity_summary(f.admins, f.sessions, f.activity_log)


@query
def v_admin_activity_summary_corrected(f):
    return activity.admin_activity_summary(f.admins, f.sessions, f.activity_log, fan_out=False)


@query
def v_daily_admin_activity(f):
    return activity.daily_admin_activity(f.activity_log, f.admins)


@query
def v_security_events_summary(f):
    return activity.security_summary(f.security_events)


@query
def v_feature_usage_analytics(f):
    return activity.feature_usage(usage_of(f))


@query
def v_user_chat_summary(f):
    return chat.user_summary(f.chat_users, f.chat_sessions, f.chat_messages)


@query
def v_daily_chat_analytics(f):
    return chat.daily_chat(f.chat_sessions, f.chat_messages, as_of())


@query
def v_daily_chat_analytics_corrected(f):
    return chat.daily_chat(f.chat_sessions, f.chat_messages, as_of(), message_weighted=False)


@query
def v_intent_performance(f):
    return chat.intent_performance(f.chat_messages)


@query
def v_transaction_summary_v1(f):
    return rewards.transaction_summary(f.transactions, f.profiles, with_sign=False)


@query
def v_transaction_summary_v2(f):
    return rewards.transaction_summary(f.transactions, f.profiles)


@query
def v_leaderboard_v1(f):
    return rewards.leaderboard_plain(f.profiles)


@query
def v_leaderboard_v2(f):
    return rewards.leaderboard(f.profiles)


@query
def leaderboard_top(f):
    """The first rows of the leaderboard, as the verification query shows them."""
    return rewards.leaderboard_top(f.profiles, 5)


@query
def leaderboard_rank(f):
    return rewards.leaderboard_cache(f.profiles)


@query
def leaderboard_refresh(f):
    """The rebuilt cache, written as a new version and read back."""
    root = scratch_path(f.spark, "leaderboard")
    return sinks.rebuild(rewards.leaderboard_cache(f.profiles), root)


@query
def v_daily_stats(f):
    return rewards.daily_stats(f.transactions)


@query
def v_category_stats_v1(f):
    return rewards.category_totals(f.transactions)


@query
def v_category_stats_v2(f):
    return rewards.category_stats(f.transactions, f.waste_categories)


@query
def points_reconcile(f):
    return rewards.points_reconcile(f.profiles, f.transactions)


# ---- dashboard and lists ------------------------------------------------------
@query
def dashboard_counters(f):
    return dashboard.day_counters(f.sessions, f.activity_log, f.page_visits, f.security_events, DAY)


@query
def daily_analytics(f):
    return activity.daily_analytics(f.activity_log, DAY, 7)


@query
def admin_analytics(f):
    """Every admin's day; a single admin is the same plan with one more filter."""
    return activity.admin_day(f.admins, f.sessions, f.activity_log, DAY)


@query
def security_day(f):
    return activity.security_counts(f.security_events, DAY, DAY)


@query
def performance_filtered(f):
    return dashboard.performance_of_day(performance_of(f), f.admins, DAY)


@query
def performance_banded(f):
    return dashboard.performance_banded(performance_of(f), f.admins, DAY)


@query
def sessions_filtered(f):
    return dashboard.sessions_list(f.sessions, f.admins, active=0)


@query
def activities_filtered(f):
    return dashboard.activities_list(f.activity_log, f.admins, activity_type="purchase")


@query
def security_filtered(f):
    return dashboard.security_list(f.security_events, severity="CRITICAL", resolved=0)


@query
def recent_activities(f):
    return dashboard.recent_activities(f.activity_log, f.admins)


@query
def recent_security(f):
    return dashboard.recent_security(f.security_events)


# ---- reports ------------------------------------------------------------------
@query
def report_overview(f):
    return reports.overview(
        f.sessions, f.activity_log, f.page_visits, f.security_events, usage_of(f), f.admins, START, END
    )


@query
def report_overview_long(f):
    return reports.overview_long(report_overview(f))


@query
def report_daily_trends(f):
    return activity.daily_trends(f.activity_log, START, END)


@query
def report_activity_breakdown(f):
    return activity.activity_breakdown(f.activity_log, START, END)


@query
def report_admin_summary(f):
    return reports.admin_summary(f.activity_log, f.admins, START, END)


@query
def report_security_events(f):
    return activity.security_counts(f.security_events, START, END)


@query
def report_recent_security(f):
    return dashboard.recent_security(f.security_events, 50, START, END)


@query
def report_security_trends(f):
    return activity.security_trends(f.security_events, START, END)


@query
def report_admin_performance(f):
    return reports.admin_performance(performance_of(f), f.admins, START, END)


@query
def report_system_trends(f):
    return reports.system_trends(system_of(f), START, END)


@query
def report_feature_usage(f):
    start, end = preset_range("30d", AS_OF.date())
    return activity.feature_usage_between(usage_of(f), start, end)


@query
def report_feature_trends(f):
    start, end = preset_range("30d", AS_OF.date())
    return activity.feature_trends(usage_of(f), start, end)


@query
def report_feature_trends_corrected(f):
    start, end = preset_range("30d", AS_OF.date())
    return activity.feature_trends_corrected(f.activity_log, start, end)


@query
def system_health(f):
    return reports.system_health(f.sessions, f.activity_log, START, END)


@query
def preset_ranges(f):
    """Activities inside each preset range, unknown preset included; one scan."""
    presets = ["1d", "7d", "30d", "90d", "1y", "other"]
    ranges = {p: preset_range(p, RANGE_END) for p in presets}
    counts = f.activity_log.agg(
        *[F.count_if(in_days("created_at", *ranges[p])).alias(p) for p in presets]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("preset"),
                F.lit(ranges[p][0]).alias("start_date"),
                F.lit(ranges[p][1]).alias("end_date"),
                F.col(p).alias("activities"),
            )
            for p in presets
        ]
    )
    return counts.select(F.inline(rows))


@query
def export_csv_roundtrip(f):
    """A report exported to CSV with a header and read back with its schema."""
    section = report_admin_summary(f)
    folder = scratch_path(f.spark, "export")
    paths = sinks.export_csv({"admin_summary": section}, folder, "admin_activity", "7d")
    return f.spark.read.schema(section.schema).option("header", True).csv(paths["admin_summary"])


@query
def export_json_roundtrip(f):
    section = activity.daily_trends(f.activity_log, START, END)
    folder = scratch_path(f.spark, "export")
    paths = sinks.export_json({"daily_trends": section}, folder, "admin_activity", "7d")
    return f.spark.read.schema(section.schema).json(paths["daily_trends"])


# ---- rollups ------------------------------------------------------------------
@query
def daily_rollup(f):
    return rollups.daily_rollup(f.sessions, f.activity_log, f.page_visits, usage_of(f))


@query
def performance_rollup(f):
    return performance_of(f)


@query
def system_rollup(f):
    return system_of(f)


@query
def peak_concurrency(f):
    return sessioning.peak_concurrency(f.sessions)


@query
def chat_rollup(f):
    return rollups.chat_rollup(f.chat_sessions, f.chat_messages, as_of())


@query
def intent_rollup(f):
    return rollups.intent_rollup(f.chat_messages)


@query
def waste_deposited(f):
    return rewards.waste_deposited(f.transactions)


@query
def period_change(f):
    return rollups.period_change(f.sessions, f.activity_log, START, END)


@query
def intraday_4h(f):
    return rollups.intraday(f.activity_log)


@query
def weekday_profile(f):
    return rollups.weekday_profile(f.sessions, f.activity_log)


@query
def security_share(f):
    return rollups.security_share(f.security_events)


@query
def feedback_summary(f):
    return rollups.feedback_summary(f.user_feedback)


@query
def preferences_pivot(f):
    return rollups.preferences_pivot(f.preferences, ["segment", "nation"])


@query
def table_counts(f):
    return catalog.table_counts(named_tables(f))


@query
def knowledge_listing(f):
    return catalog.knowledge_by_priority(f.knowledge_base)


@query
def rewards_catalog(f):
    return catalog.rewards_catalog(f.rewards)


@query
def users_sample(f):
    return catalog.sample_users(f.chat_users)


# ---- client facts ---------------------------------------------------------------
@query
def ua_classify(f):
    agent = F.col("user_agent")
    return (
        f.page_visits.groupBy(
            client.browser_name(agent).alias("browser_name"),
            client.browser_version(agent).alias("browser_version"),
            client.os_name(agent).alias("os_name"),
        )
        .agg(F.count(F.lit(1)).alias("visits"))
    )


@query
def ua_classify_corrected(f):
    agent = F.col("user_agent")
    return f.page_visits.groupBy(
        client.browser_name(agent, corrected=True).alias("browser_name"),
        client.os_name(agent, corrected=True).alias("os_name"),
    ).agg(F.count(F.lit(1)).alias("visits"))


@query
def device_mix(f):
    device = client.device_type(client.screen_width(F.col("screen_resolution")))
    return f.page_visits.groupBy(device.alias("device_type")).agg(
        F.count(F.lit(1)).alias("visits"), F.sum("visit_duration").alias("total_seconds")
    )


@query
def tagged_clicks(f):
    """``action:category`` tags split and described."""
    tagged = f.ev.select(
        F.col("event_id").alias("id"),
        F.concat_ws(":", F.upper("event_type"), F.when(F.col("k") % 2 == 0, F.lit("INTERACTION"))).alias("tag"),
        F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("label"),
        (F.col("value") * 1000).cast("long").alias("ms"),
    )
    action, category = client.tag_parts(F.col("tag"))
    return tagged.select(
        "id",
        action.alias("activity_type"),
        category.alias("activity_category"),
        client.click_description(F.col("label")).alias("description"),
        client.visit_seconds(F.col("ms")).alias("visit_seconds"),
    )


@query
def valid_sessions(f):
    """Sessions still inside their 24 hours at the end of the range."""
    cutoff = datetime.combine(RANGE_END, time.min)
    return f.sessions.filter(younger_than("login_time", cutoff, 24)).select("id", "admin_id", "login_time")


# ---- ingest ---------------------------------------------------------------------
@query
def ingest_required_fields(f):
    complete = lookups.is_complete(REQUIRED_FIELDS["activity"])
    return lookups.normalise_requests(f.request_feed).select(
        F.when(complete, "accepted").otherwise("quarantined").alias("outcome"),
        "id",
        "activity_type",
        "activity_category",
        "description",
    )


@query
def ingest_json_requests(f):
    """Request bodies as JSON text, some of them broken."""
    body = F.to_json(F.struct(F.col("event_type").alias("activity_type"), F.col("value").alias("amount"), "k"))
    broken = F.when(F.col("k") % 10 == 3, F.concat(F.lit("{"), body)).otherwise(body)
    parsed = readers.parse_requests(
        f.ev.select(F.col("event_id").alias("id"), broken.alias("value")), "activity_type STRING, amount DOUBLE, k INT"
    )
    outcome = F.when(F.col("malformed").isNull(), "parsed").otherwise("malformed")
    return parsed.select("id", outcome.alias("outcome"), "activity_type", "k")


@query
def ingest_defaults(f):
    """Absent values replaced by the table's defaults."""
    visits = f.ev.select(
        F.col("event_id").alias("id"),
        F.when(F.col("k") % 5 != 0, F.floor("value").cast("int")).alias("visit_duration"),
    )
    ledger = f.transactions.select("id", F.when(F.col("points") < 0, F.col("type")).alias("type"))
    filled_visits = lookups.with_defaults(visits, DEFAULTS["admin_page_visits"])
    filled_ledger = lookups.with_defaults(ledger, DEFAULTS["transactions"])
    return filled_visits.groupBy(F.lit("visit").alias("feed"), F.col("visit_duration").cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("row_count")
    ).unionByName(
        filled_ledger.groupBy(F.lit("ledger").alias("feed"), F.col("type").alias("value")).agg(
            F.count(F.lit(1)).alias("row_count")
        )
    )


@query
def ingest_auth_inner(f):
    accepted, _ = lookups.authenticate(f.request_feed, f.sessions, f.admins)
    return accepted.select("id", "session_token", "session_id", "admin_id", "username")


@query
def ingest_auth_anti(f):
    _, rejected = lookups.authenticate(f.request_feed, f.sessions, f.admins)
    return rejected.select("id", "session_token")


@query
def retry_remaining(f):
    return lookups.remaining_retries(f.failed_requests, f.retried_requests)


@query
def login_events(f):
    """Sessions opened and log rows written by the same logins."""
    logins = f.sessions.select("id", "admin_id", "ip_address", "login_time")
    opened = lookups.login_sessions(logins).select(
        F.lit("session").alias("target"), "admin_id", "session_id", F.col("session_token").alias("detail"),
        F.col("login_time").alias("at"),
    )
    logged = lookups.login_log(logins).select(
        F.lit("log").alias("target"), "admin_id", "session_id", F.col("activity_description").alias("detail"),
        F.col("created_at").alias("at"),
    )
    return opened.unionByName(logged)


@query
def chat_session_start(f):
    """A session row per opening turn of a conversation."""
    starts = f.raw("conversations").filter("turn = 0").selectExpr(
        "conv_id AS id",
        "CAST(conv_id % 10 AS STRING) AS user_id",
        "concat('Chat ', conv_id) AS session_name",
        f"{shapes.CHAT_START} AS started_at",
    )
    return lookups.chat_session_rows(starts).drop("ended_at")


@query
def logout_events(f):
    """What becomes of each logout: closed, only logged, or rejected."""
    matched = lookups.match_logouts(f.logout_feed, f.sessions, f.admins)
    return matched.select(
        F.col("outcome").alias("target"),
        "admin_id",
        "session_id",
        "ip_address",
        F.col("description").alias("detail"),
        F.col("session_duration"),
        F.col("event_time").alias("at"),
    )


@query
def logout_sessions(f):
    """The session table after those logouts."""
    return lookups.apply_logouts(f.sessions, f.logout_feed)


# ---- lookups ----------------------------------------------------------------------
@query
def detection_points(f):
    return (
        lookups.detection_points(f.detections, f.detection_mapping, f.waste_categories)
        .groupBy("coco_class", "waste_category")
        .agg(F.count(F.lit(1)).alias("detections"), F.sum("points_value").alias("total_points"))
    )


@query
def affordable_rewards(f):
    return lookups.affordable_rewards(f.profiles, f.rewards)


@query
def intent_match(f):
    return lookups.match_intents(f.chat_messages, f.knowledge_base)


# ---- upserts ------------------------------------------------------------------------
@query
def points_upsert(f):
    return state.points_fold(f.profiles, f.points_feed)


@query
def points_ledger(f):
    """The ledger rows appended by the points feed."""
    return folds.ledger_rows(f.points_feed)


@query
def daily_upsert(f):
    """Deposits fold onto the figures of the redemptions; touched days are recomputed."""
    earlier = f.transactions.filter(F.col("type") == "redeem")
    batch = f.transactions.filter(F.col("type") == "waste_deposit")
    return folds.daily_upsert(rewards.daily_stats(earlier), f.transactions, batch)


def _halves(frame: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    early = F.col(ts) < F.lit(SPLIT_DAY)
    return frame.filter(early), frame.filter(~early)


@query
def feature_upsert(f):
    """Two consecutive batches; equals the fold over all events."""
    first, second = _halves(f.activity_log, "created_at")
    snapshot = folds.start_features(folds.feature_batch(first))
    return state.feature_fold(snapshot, second)


@query
def performance_counter(f):
    first, second = _halves(f.activity_log, "created_at")
    return state.performance_fold(folds.performance_counter(first), second)


@query
def intent_upsert(f):
    first, second = _halves(f.chat_messages, "created_at")
    return state.intent_fold(folds.intent_batch(first), second)


@query
def session_counter(f):
    fresh = f.chat_sessions.select("session_id", "user_id", F.lit(0).cast("long").alias("message_count"))
    first, second = _halves(f.chat_messages, "created_at")
    return folds.count_messages(folds.count_messages(fresh, first), second)


@query
def user_upsert(f):
    return folds.merge_users(f.chat_users, folds.user_batch(f.user_feed))


def _seed(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    """An active catalogue and a price list for every part."""
    dearer = f.rewards.select(
        "id",
        F.concat(F.lit("New "), F.col("title")).alias("title"),
        (F.col("cost_points") + 5).alias("cost_points"),
        F.lit(True).alias("is_active"),
    )
    return f.rewards.filter("is_active"), dearer


@query
def seed_upsert_keep(f):
    existing, seed = _seed(f)
    return merge.seed_keep(existing, seed, ["id"])


@query
def seed_upsert_overwrite(f):
    existing, seed = _seed(f)
    return merge.seed_overwrite(existing, seed, ["id"], ["cost_points"])


@query
def changed_profiles(f):
    return merge.changed_keys(f.profiles, points_upsert(f), "user_id", "eco_points")


@query
def data_change_log(f):
    rich = (F.col("eco_points") > 5000).alias("is_rich")
    return merge.change_log(
        f.profiles.select("*", rich),
        points_upsert(f).select("*", rich),
        "user_id",
        ["display_name", "email", "eco_points", "is_rich"],
        "profiles",
    )


# ---- quality --------------------------------------------------------------------------
def named_tables(f: Fixtures) -> dict[str, DataFrame]:
    """The test frames under the names of the tables they stand for."""
    return {
        "admins": f.admins,
        "admin_sessions": f.sessions,
        "admin_activity_log": f.activity_log,
        "admin_page_visits": f.page_visits,
        "admin_security_events": f.security_events,
        "feature_usage_tracking": usage_of(f),
        "admin_performance_metrics": performance_of(f),
        "profiles": f.profiles,
        "transactions": f.transactions,
        "waste_categories": f.waste_categories,
        "ai_detection_mapping": f.detection_mapping,
        "rewards": f.rewards,
        "daily_analytics": rewards.daily_stats(f.transactions),
        "chatbot_users": f.chat_users,
        "user_preferences": f.preferences,
        "chat_sessions": f.chat_sessions,
        "chat_messages": f.chat_messages,
        "user_feedback": f.user_feedback,
        "ai_knowledge_base": f.knowledge_base,
    }


def unchecked_tables(f: Fixtures) -> dict[str, DataFrame]:
    """Rows as they come before any gate, with values that the declarations forbid."""
    messages = f.raw("conversations").selectExpr(
        "conv_id * 1000 + turn AS id",
        "concat('c', conv_id) AS session_id",
        "CAST(conv_id % 10 AS STRING) AS user_id",
        "role AS message_type",
        "CASE WHEN turn % 7 <> 3 THEN text END AS message_content",
        "substr(text, 1, 150) AS intent_category",
    )
    security = shapes.security_from(f.ev).withColumn("event_severity", F.initcap("event_severity"))
    return {"chat_messages": messages, "admin_security_events": security, "admin_activity_log": f.activity_log}


@query
def dq_unique(f):
    """Every declared key, and ``id``, of every table at hand."""
    return quality.declared_keys({**named_tables(f), "admin_security_events": f.security_events.unionByName(f.security_events)})


@query
def dq_orphans(f):
    """Every declared reference between the tables at hand."""
    return quality.declared_links(named_tables(f))


@query
def dq_enum(f):
    return quality.declared_domains(unchecked_tables(f))


@query
def dq_nulls_len(f):
    return quality.declared_columns(unchecked_tables(f))


@query
def delete_cascade(f):
    """Log rows that survive deleting the inactive admins."""
    gone = f.admins.filter(~F.col("is_active"))
    return merge.delete_cascade(f.activity_log, "admin_id", gone, "id").select("id", "admin_id", "activity_type")


@query
def delete_set_null(f):
    gone = f.admins.filter(~F.col("is_active"))
    return merge.delete_set_null(f.security_events, "admin_id", gone, "id").select("id", "admin_id", "event_type")


@query
def dq_registration(f):
    return quality.registration_violations(f.registrations)


# ---- time-based grouping -----------------------------------------------------------------
@query
def sessionize(f):
    return sessioning.sessionize(
        f.ev.select(F.col("user_id").alias("admin_id"), "ts"), "admin_id", "ts", gap_seconds=8 * 3600
    )


@query
def page_visits(f):
    return sessioning.page_visits(sessioning.visit_rows(f.page_visits))


@query
def page_visits_corrected(f):
    return sessioning.page_visits_corrected(sessioning.visit_rows(f.page_visits))


@query
def dedup_double_fire(f):
    """Clicks recorded by two listeners a few milliseconds apart."""
    log = f.activity_log.select("id", "admin_id", "activity_type", "target_resource", "execution_time_ms", "created_at")
    copies = F.array(F.lit(0), F.when(F.col("activity_type") == "click", 1))
    doubled = log.withColumn("copy", F.explode(F.array_compact(copies))).select(
        (F.col("id") * 2 + F.col("copy")).alias("id"),
        "admin_id",
        "activity_type",
        "target_resource",
        "execution_time_ms",
        F.timestamp_add("MICROSECOND", F.col("copy") * (F.col("id") % 9 + 1) * 1000, "created_at").alias("created_at"),
    )
    return sessioning.drop_close_fire(doubled)


@query
def dedup_same_second(f):
    """One row a second of the clock for each admin, type and target."""
    log = f.activity_log.select("id", "admin_id", "activity_type", "target_resource", "created_at")
    return sessioning.drop_double_fire(log)


# ---- streaming -------------------------------------------------------------------------------
DELAY = "40 days"


def raw_stream(f: Fixtures, table: str, ts: str, cuts: list[str], last: list[DataFrame] | None = None) -> DataFrame:
    """A test table as a stream of as many files as ``cuts`` part it into, one a micro-batch, oldest first.

    ``last`` adds files at the end, for instance of events that let the watermark pass all others.
    """
    folder = scratch_path(f.spark, f"feed-{table}")
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = f.raw(table)
        if low:
            part = part.filter(F.col(ts) >= F.lit(low).cast("timestamp_ntz"))
        if high:
            before = F.col(ts) < F.lit(high).cast("timestamp_ntz")
            part = part.filter(before if low else before | F.col(ts).isNull())  # rows without a time come first
        part.coalesce(1).write.mode("append").parquet(folder)
    for part in last or []:
        part.coalesce(1).write.mode("append").parquet(folder)
    return stream_files(f.spark, folder, RAW_SCHEMAS[table], files_per_batch=1)


def order_stream(f: Fixtures) -> DataFrame:
    """Three batches of orders after one without any."""
    return raw_stream(f, "orders", "o_orderdate", ["1994-06-01", "1997-01-01", "1999-01-01"])


def _event_stream(f: Fixtures) -> DataFrame:
    return shapes.with_k(raw_stream(f, "events", "ts", ["2024-01-11", "2024-01-21"]))


def _ingested(f: Fixtures, kind: str, requests: DataFrame) -> str:
    root = scratch_path(f.spark, f"ingest-{kind}")
    feeds.ingest(requests, kind, f.sessions, f.admins, root, f"{root}/checkpoint").awaitTermination()
    return root


@query
def stream_ingest_append(f):
    """Activity requests through the gates into the whole log layout."""
    root = _ingested(f, "activity", lookups.normalise_requests(shapes.requests_from(_event_stream(f))))
    return feeds.ingested(f.spark, root).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query
def stream_ingest_visits(f):
    """Page visits; client facts and defaults fill what was not sent."""
    root = _ingested(f, "page_visit", shapes.visits_from(_event_stream(f)))
    return feeds.ingested(f.spark, root).select(
        "id", "admin_id", "session_id", "page_name", "page_url", "visit_duration", "ip_address", "user_agent",
        "screen_resolution", "device_type", (F.col("browser_name") == "Own Browser").alias("named_browser"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@query
def stream_ingest_security(f):
    """Security events need no session."""
    root = _ingested(f, "security_event", shapes.security_from(_event_stream(f)))
    return feeds.ingested(f.spark, root).drop("resolved_at", "resolved_by").withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz")
    )


@query
def stream_quarantine(f):
    """Requests of two feeds that were refused, with the reason, and how many were accepted."""
    broken = shapes.requests_from(_event_stream(f)).withColumn(
        "malformed", F.when(F.col("id") % 10 == 3, F.lit("{"))
    )
    out = None
    for kind, requests in (
        ("activity", lookups.normalise_requests(broken)),
        ("security_event", shapes.security_from(_event_stream(f))),
    ):
        root = _ingested(f, kind, requests)
        refused = feeds.ingested(f.spark, root, "quarantine").select("feed", "reason", "id")
        accepted = feeds.ingested(f.spark, root).select(F.lit(kind).alias("feed"), F.lit("accepted").alias("reason"), "id")
        both = refused.union(accepted)
        out = both if out is None else out.union(both)
    return out


@query
def stream_ingested_activities(f):
    """The activity list of the dashboard over the log that ingest writes."""
    root = _ingested(f, "activity", lookups.normalise_requests(shapes.requests_from(_event_stream(f))))
    log = feeds.ingested(f.spark, root).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return dashboard.activities_list(log, f.admins).select("id", "activity_type", "target_id")


@query
def stream_upsert_points(f):
    """The order feed folded onto the profiles, one version per micro-batch."""
    root = scratch_path(f.spark, "profiles")
    feed = shapes.points_from(order_stream(f))
    state.keep_table(feed, state.points_fold, f.profiles, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return state.current_table(f.spark, f"{root}/table", f.profiles)


@query
def stream_points_deltas(f):
    """The same feed kept as deltas, then compacted into a base."""
    root = scratch_path(f.spark, "deltas")
    state.keep_deltas(shapes.points_from(order_stream(f)), state.POINTS, root, f"{root}/cp").awaitTermination()
    initial = f.profiles.withColumn("eco_points", F.col("eco_points").cast("long"))
    state.compact(f.spark, root, state.POINTS, initial)
    return state.folded_table(f.spark, root, state.POINTS, initial)


@query
def stream_sessions(f):
    """Sessions that a live feed of logins and logouts opens and closes, and the log it writes."""
    root = scratch_path(f.spark, "sessions")
    empty = f.spark.createDataFrame(
        [], "id BIGINT, admin_id BIGINT, session_token STRING, ip_address STRING, login_time TIMESTAMP_NTZ, "
        "logout_time TIMESTAMP_NTZ, is_active BOOLEAN, session_duration BIGINT"
    )
    feed = shapes.session_events_from(_event_stream(f))
    state.keep_sessions(feed, empty, f.admins, root, f"{root}/cp").awaitTermination()
    table = state.current_table(f.spark, f"{root}/table", empty)
    log = feeds.ingested(f.spark, root, "log")
    return table.select(
        F.lit("session").alias("part"), F.col("id").alias("session_id"), "admin_id", F.col("logout_time").alias("moment"),
        F.col("is_active").cast("string").alias("detail"), F.col("session_duration").alias("seconds"),
    ).union(
        log.select(F.lit("log"), "session_id", "admin_id", "created_at", "activity_description", F.lit(None).cast("long"))
    )


@query
def stream_points_job(f):
    """Profiles, ledger, days and leaderboard kept by one job over three micro-batches."""
    root = scratch_path(f.spark, "points-job")
    initial = f.profiles.withColumn("eco_points", F.col("eco_points").cast("long"))
    state.keep_points_job(shapes.points_from(order_stream(f)), initial, root, f"{root}/cp").awaitTermination()
    tables = state.points_tables(f.spark, root, initial)
    text = lambda c: F.col(c).cast("string")
    return (
        tables["profiles"].select(F.lit("profile").alias("part"), F.col("user_id").alias("key"), F.col("eco_points").alias("value"),
                                  F.coalesce("display_name", "email").alias("detail"))
        .union(tables["ledger"].select(F.lit("ledger"), "id", F.col("points").cast("long"), "waste_category"))
        .union(tables["days"].select(F.lit("day"), text("date"), F.col("total_transactions"), text("unique_users")))
        .union(tables["leaderboard"].select(F.lit("rank"), text("rank_position"), F.col("points").cast("long"), "name"))
    )


@query
def stream_daily_counts(f):
    """The per-admin day counter kept in update mode."""
    root = scratch_path(f.spark, "day-counts")
    log = feeds.event_time(shapes.activity_from(_event_stream(f)), "created_at")
    counts = feeds.daily_counts(log, "created_at", DELAY)
    feeds.write_updates(counts, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return (
        f.spark.read.schema("admin_id BIGINT, date DATE, total_activities BIGINT")
        .parquet(f"{root}/table/v=*")
        .groupBy("admin_id", "date")
        .agg(F.max("total_activities").alias("total_activities"))
    )


@query
def stream_sessionize(f):
    """Live sessions with pauses of up to eight hours, cut at 24 hours; equal to the batch answer."""
    root = scratch_path(f.spark, "live-sessions")
    marker = f.spark.sql(
        "SELECT -1L AS event_id, TIMESTAMP_NTZ '2034-01-01 00:00:00' AS ts, -1L AS user_id, 'end' AS event_type, "
        "0D AS value, '' AS props"
    )
    raw = raw_stream(f, "events", "ts", ["2024-01-11", "2024-01-21"], [marker, marker])
    feed = feeds.event_time(raw.withColumnRenamed("user_id", "admin_id"), "ts")
    # a window ends where its gap does, so a pause of just eight hours needs a microsecond more
    live = feeds.activity_sessions(feed, "ts", "8 hours 1 microsecond", "1 hour")
    feeds.run(
        live.writeStream.format("parquet").option("path", f"{root}/closed").option("checkpointLocation", f"{root}/cp")
    ).awaitTermination()
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    closed = f.spark.read.parquet(f"{root}/closed").select("admin_id", ntz("session_start"), ntz("session_end"), "event_count")
    return feeds.cut_long_sessions(closed, f.ev.withColumnRenamed("user_id", "admin_id"), "ts")


@query
def stream_dedup(f):
    """A feed that repeats every purchase; each event is counted once."""
    root = scratch_path(f.spark, "dedup")
    again = F.when(F.col("event_type") == "purchase", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    repeated = feeds.event_time(_event_stream(f), "ts").withColumn("attempt", F.explode(again)).drop("attempt")
    unique = feeds.drop_repeats(repeated, "ts", "event_id", DELAY).select(
        "event_id", "event_type", F.to_date("ts").alias("date")
    )
    feeds.run(
        unique.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/events")
        .option("checkpointLocation", f"{root}/checkpoint")
    ).awaitTermination()
    return (
        f.spark.read.schema("event_id BIGINT, event_type STRING, date DATE")
        .parquet(f"{root}/events")
        .groupBy("date", "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
    )
