"""Hand-derived answers on the sample rows every installation starts with."""

from datetime import date, datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallyforge.operators import folds, lookups
from tallyforge.plans import activity, catalog, rewards
from tallyforge.sources.schemas import schema_of

AS_OF = datetime(2024, 1, 31, 12)


def table(spark, name, records):
    schema = schema_of(name)
    frame = spark.createDataFrame(
        [tuple(r.get(f.name) for f in schema) for r in records],
        "STRUCT<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema) + ">",
    )
    return frame


@pytest.fixture(scope="module")
def profiles(spark):
    people = [("guest", "guest@local", "Guest", 0), ("user1", "ava@example.com", "Ava", 120),
              ("user2", "liam@example.com", "Liam", 95), ("user3", "noah@example.com", "Noah", 80)]
    return table(spark, "profiles", [
        {"id": i, "user_id": u, "email": e, "display_name": n, "eco_points": p, "joined_at": AS_OF}
        for i, (u, e, n, p) in enumerate(people)
    ])


@pytest.fixture(scope="module")
def ledger(spark):
    entries = [("user1", 10, "waste_deposit", "plastic"), ("user1", 5, "waste_deposit", "paper"),
               ("user2", 15, "waste_deposit", "steel"), ("user3", 8, "waste_deposit", "organic"),
               ("user1", -100, "redeem", "Redeem: Free Coffee")]
    return table(spark, "transactions", [
        {"id": str(i), "user_id": u, "points": p, "type": t, "waste_category": c, "timestamp": AS_OF}
        for i, (u, p, t, c) in enumerate(entries)
    ])


def test_leaderboard_versions(profiles):
    assert rows(rewards.leaderboard(profiles), "rank_position", "name", "points") == [
        (1, "Ava", 120), (2, "Liam", 95), (3, "Noah", 80)
    ]
    assert rows(rewards.leaderboard_plain(profiles), "name", "points") == [
        ("Ava", 120), ("Guest", 0), ("Liam", 95), ("Noah", 80)
    ]
    assert rows(rewards.leaderboard_top(profiles, 2), "rank_position", "name") == [(1, "Ava"), (2, "Liam")]


def test_daily_stats(ledger):
    assert rows(rewards.daily_stats(ledger)) == [(date(2024, 1, 31), 5, 38, 100, 3, 4, 1)]


def test_category_stats(spark, ledger):
    categories = table(spark, "waste_categories", [
        {"id": i, "category_name": c, "points_value": v}
        for i, (c, v) in enumerate([("plastic", 10), ("paper", 5), ("steel", 15), ("organic", 8)])
    ])
    got = rows(rewards.category_stats(ledger, categories), "waste_category", "total_points", "category_points_value")
    assert got == [
        ("Redeem: Free Coffee", -100, None), ("organic", 8, 8), ("paper", 5, 5), ("plastic", 10, 10), ("steel", 15, 15)
    ]


def test_transaction_summary(spark, ledger, profiles):
    orphan = ledger.unionByName(ledger.filter("points = 8").withColumn("user_id", F.lit("nobody")))
    got = rows(rewards.transaction_summary(orphan, profiles), "user_id", "user_name", "points", "sign_display")
    assert ("nobody", "nobody", 8, "+") in got and ("user1", "Ava", -100, "") in got and len(got) == 6


def test_reconcile(ledger, profiles):
    got = rows(rewards.points_reconcile(profiles, ledger), "user_id", "difference")
    assert got == [("user1", 205), ("user2", 80), ("user3", 72)]


@pytest.fixture(scope="module")
def admin_tables(spark):
    admins = table(spark, "admins", [{"id": 1, "username": "admin", "password_hash": "-", "display_name": "Admin"}])
    sessions = table(spark, "admin_sessions", [
        {"id": 1, "admin_id": 1, "session_token": "a", "ip_address": "-", "login_time": AS_OF - timedelta(hours=2),
         "is_active": True, "session_duration": 0},
        {"id": 2, "admin_id": 1, "session_token": "b", "ip_address": "-", "login_time": AS_OF - timedelta(days=1),
         "is_active": False, "session_duration": 0},
    ])
    log = table(spark, "admin_activity_log", [
        {"id": i, "admin_id": 1, "session_id": 1, "activity_type": t, "activity_category": c, "activity_description": "-",
         "target_resource": r, "ip_address": "-", "response_status": 200, "execution_time_ms": ms, "created_at": AS_OF}
        for i, (t, c, r, ms) in enumerate([("VIEW", "DASHBOARD", "dashboard", 150),
                                           ("EXPORT", "DATA", "users_export", 2500), ("UPDATE", "USER", "user_profile", 300)])
    ])
    return admins, sessions, log


def test_admin_summary_fan_out(admin_tables):
    faithful = activity.admin_activity_summary(*admin_tables).first()
    corrected = activity.admin_activity_summary(*admin_tables, fan_out=False).first()
    assert (faithful.total_sessions, faithful.total_activities, faithful.unique_activity_types) == (2, 6, 3)
    assert corrected.total_activities == 3
    assert faithful.active_days == 2


def test_single_admin_day(admin_tables):
    got = activity.admin_day(*admin_tables, day=AS_OF.date(), admin_id=1).first()
    assert (got.total_sessions, got.total_activities) == (1, 3)
    quiet = activity.admin_day(*admin_tables, day=date(2020, 1, 1)).first()
    assert (quiet.total_sessions, quiet.total_activities, quiet.avg_session_duration) == (0, 0, None)


def test_performance_counter(admin_tables):
    assert rows(folds.performance_counter(admin_tables[2])) == [(1, date(2024, 1, 31), 3)]


def test_rewards_and_reach(spark, profiles):
    offers = table(spark, "rewards", [
        {"id": i, "title": i, "cost_points": c, "is_active": True}
        for i, c in [("r-5off", 100), ("r-coffee", 80), ("r-bus", 120), ("r-plant", 60)]
    ])
    assert [r.cost_points for r in catalog.rewards_catalog(offers).collect()] == [60, 80, 100, 120]
    got = rows(lookups.affordable_rewards(profiles, offers), "user_id", "affordable_count", "best_reward_id")
    assert got == [("guest", 0, None), ("user1", 4, "r-bus"), ("user2", 2, "r-coffee"), ("user3", 2, "r-coffee")]


def test_detection_threshold(spark):
    mapping = spark.sql("SELECT 'bottle' coco_class, 'plastic' waste_category, CAST(0.35 AS DECIMAL(3,2)) confidence_threshold, true is_active")
    categories = spark.sql("SELECT 'plastic' category_name, 10 points_value, true is_active")
    seen = spark.sql("SELECT * FROM VALUES ('bottle', 0.35), ('bottle', 0.34), ('chair', 0.99) AS t(coco_class, confidence)")
    assert rows(lookups.detection_points(seen, mapping, categories), "waste_category", "points_value") == [("plastic", 10)]
    off = categories.withColumn("is_active", F.lit(False))
    assert lookups.detection_points(seen, mapping, off).count() == 0


def test_knowledge_order(spark):
    kb = spark.sql("SELECT * FROM VALUES ('a', 7), ('b', 10), ('c', 10) AS t(category, priority)")
    assert [tuple(r) for r in catalog.knowledge_by_priority(kb).collect()] == [("b", 10), ("c", 10), ("a", 7)]
