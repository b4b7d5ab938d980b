"""Batch folds against a row-by-row replay of the update rules."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallyforge.operators import folds
from tallyforge.streaming import state

T0 = datetime(2024, 1, 1)
LOG = (
    "id BIGINT, admin_id BIGINT, activity_category STRING, target_resource STRING, response_status INT, "
    "execution_time_ms INT, created_at TIMESTAMP_NTZ"
)
FEED = "id BIGINT, user_id STRING, points_delta INT, display_name STRING, email STRING, event_time TIMESTAMP_NTZ"


def log_events(n, seed):
    rng = random.Random(seed)
    events = []
    for i in range(n):
        admin = 1 if rng.random() < 0.4 else rng.randint(2, 5)
        events.append(
            (i, admin, rng.choice("AB"), rng.choice(["f1", "f2", None]), rng.choice([200, 302, 404, None]),
             rng.choice([None, 5, 70]), T0 + timedelta(seconds=rng.randint(0, 40)))
        )
    return events


def replay_features(events):
    table = {}
    for _, admin, category, feature, status, ms, ts in sorted(events, key=lambda e: (e[6], e[0])):
        if feature is None:
            continue
        ok, bad = int(status == 200), int(status == 404)
        key = (admin, feature)
        if key not in table:
            table[key] = [category, 1, ts, 0, ok, bad]
        else:
            row = table[key]
            row[1] += 1
            row[2] = ts
            row[3] += ms or 0
            row[4] += ok
            row[5] += bad
    return sorted((k + tuple(v) for k, v in table.items()), key=repr)


FEATURE_COLUMNS = [
    "admin_id", "feature_name", "feature_category", "usage_count", "last_used_at", "total_time_spent", "success_count",
    "error_count",
]


def test_feature_golden(spark):
    events = [
        (1, 1, "A", "f", 200, 150, T0), (2, 1, "B", "f", 404, 40, T0 + timedelta(seconds=1)),
        (3, 1, "B", "f", None, 10, T0 + timedelta(seconds=2)), (4, 1, "B", "f", 302, None, T0 + timedelta(seconds=3)),
    ]
    got = folds.start_features(folds.feature_batch(spark.createDataFrame(events, LOG))).first()
    assert (got.usage_count, got.total_time_spent, got.success_count, got.error_count, got.feature_category) == (4, 50, 1, 1, "A")


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_feature_fold_equals_replay(spark, batches):
    events = sorted(log_events(300, batches), key=lambda e: (e[6], e[0]))
    size = -(-len(events) // batches)
    table = folds.start_features(folds.feature_batch(spark.createDataFrame([], LOG)))
    for i in range(0, len(events), size):
        table = state.feature_fold(table, spark.createDataFrame(events[i : i + size], LOG))
    assert rows(table, *FEATURE_COLUMNS) == replay_features(events)


def feed_events(n, seed):
    rng = random.Random(seed)
    return [
        (i, "u1" if rng.random() < 0.4 else f"u{rng.randint(2, 6)}", rng.randint(-20, 20),
         rng.choice([None, None, f"n{i}"]), rng.choice([None, f"e{i}"]), T0 + timedelta(seconds=rng.randint(0, 50)))
        for i in range(n)
    ]


def replay_points(events, profiles):
    table = dict(profiles)
    for _, user, delta, name, email, ts in sorted(events, key=lambda e: (e[5], e[0])):
        old = table.get(user, (None, None, 0, ts))
        table[user] = (email or old[0], name or old[1], old[2] + delta, old[3])
    return sorted(((k,) + v for k, v in table.items()), key=repr)


def test_points_golden(spark):
    events = [(1, "u", 10, "X", None, T0), (2, "u", -4, None, "e", T0 + timedelta(seconds=1)),
              (3, "u", 1, None, None, T0 + timedelta(seconds=2))]
    got = folds.points_batch(spark.createDataFrame(events, FEED)).first()
    assert (got.eco_points, got.display_name, got.email) == (7, "X", "e")


@pytest.mark.parametrize("batches", [1, 3])
def test_points_fold_equals_replay(spark, batches):
    start = {"u1": ("old@e", "Old", 5, T0 - timedelta(days=9)), "idle": (None, None, 1, T0)}
    profiles = spark.createDataFrame(
        [(k,) + v for k, v in start.items()],
        "user_id STRING, email STRING, display_name STRING, eco_points BIGINT, joined_at TIMESTAMP_NTZ",
    )
    events = sorted(feed_events(200, batches), key=lambda e: (e[5], e[0]))
    size = -(-len(events) // batches)
    table = profiles
    for i in range(0, len(events), size):
        table = state.points_fold(table, spark.createDataFrame(events[i : i + size], FEED))
    got = rows(table, "user_id", "email", "display_name", "eco_points", "joined_at")
    assert got == replay_points(events, start)


def test_daily_upsert_keeps_untouched_days(spark):
    ledger = spark.createDataFrame(
        [("1", "a", 5, "waste_deposit", T0), ("2", "a", -3, "redeem", T0), ("3", "b", 2, "waste_deposit", T0)],
        "id STRING, user_id STRING, points INT, type STRING, timestamp TIMESTAMP_NTZ",
    )
    stale = spark.sql(
        "SELECT * FROM VALUES (DATE '2024-01-01', 9L, 9L, 9L, 9L, 9L, 9L), (DATE '2023-12-31', 1L, 2L, 3L, 4L, 5L, 6L) AS "
        "t(date, total_transactions, total_points_earned, total_points_redeemed, unique_users, waste_deposits, redemptions)"
    )
    got = rows(folds.daily_upsert(stale, ledger, ledger.filter("id = '3'")))
    assert [r[1:] for r in got] == [(1, 2, 3, 4, 5, 6), (3, 7, 3, 2, 2, 1)]


def test_user_first_event_leaves_activity_unset(spark):
    feed = spark.createDataFrame(
        [(1, "new", "e", None, None, None, None, T0), (2, "twice", None, "A", None, None, None, T0),
         (3, "twice", None, None, "F", None, None, T0 + timedelta(hours=1)), (4, "known", None, "B", None, None, None, T0)],
        "id BIGINT, user_id STRING, email STRING, display_name STRING, first_name STRING, last_name STRING, phone STRING, "
        "event_time TIMESTAMP_NTZ",
    )
    users = spark.createDataFrame(
        [("known", "k@e", "K", None, None, None, None)],
        "user_id STRING, email STRING, display_name STRING, first_name STRING, last_name STRING, phone STRING, "
        "last_active_at TIMESTAMP_NTZ",
    )
    got = {r.user_id: r for r in folds.merge_users(users, folds.user_batch(feed)).collect()}
    assert got["new"].last_active_at is None and got["new"].email == "e"
    assert got["twice"].last_active_at == T0 + timedelta(hours=1) and got["twice"].first_name == "F"
    assert got["known"].last_active_at == T0 and got["known"].display_name == "B" and got["known"].email == "k@e"


def test_unknown_session_is_ignored(spark):
    sessions = spark.sql("SELECT 's1' session_id, 2L message_count")
    messages = spark.sql("SELECT * FROM VALUES ('s1'), ('s1'), ('ghost') AS t(session_id)")
    assert rows(folds.count_messages(sessions, messages)) == [("s1", 4)]


def test_intent_fold(spark):
    first = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-01'), (null, TIMESTAMP_NTZ '2024-01-02') AS t(intent_category, created_at)")
    second = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-03'), ('b', TIMESTAMP_NTZ '2024-01-04') AS t(intent_category, created_at)")
    table = state.intent_fold(folds.intent_batch(first), second)
    assert rows(table, "intent_name", "intent_category", "trigger_count", F.to_date("last_triggered_at").cast("string")) == [
        ("a", "a", 2, "2024-01-03"), ("b", "b", 1, "2024-01-04")
    ]
