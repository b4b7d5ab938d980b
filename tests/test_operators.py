"""Operators against brute force, on data where one key holds much of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import Window, functions as F

from tallyforge.operators import lookups, merge, quality, sessions
from tallyforge.operators.ranking import global_row_number, steps_up_to
from tallyforge.plans.rewards import transaction_summary
from tallyforge.sources.readers import parse_requests

T0 = datetime(2024, 1, 1)


def test_global_rank_with_hot_values(spark):
    rng = random.Random(1)
    points = [(i, 50 if i % 3 == 0 else rng.randint(0, 99), T0 + timedelta(days=i % 2)) for i in range(2000)]
    df = spark.createDataFrame(points, "user_id BIGINT, points INT, joined_at TIMESTAMP_NTZ").repartition(5)
    keys = [F.desc("points"), F.asc("joined_at"), F.asc("user_id")]
    ranked = global_row_number(df, keys, "rank", partitions=7)
    naive = df.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))
    assert rows(ranked, "user_id", "rank") == rows(naive, "user_id", "rank")


def test_global_rank_of_nothing(spark):
    df = spark.createDataFrame([], "user_id BIGINT")
    assert global_row_number(df, [F.asc("user_id")], "rank").count() == 0


@pytest.mark.parametrize("span", [1, 7, 4096])
def test_running_steps(spark, span):
    rng = random.Random(span)
    asked = sorted({rng.randint(-50, 200) for _ in range(60)})
    costs = sorted({rng.randint(-40, 150) for _ in range(25)})
    steps = spark.createDataFrame([(c, c % 3 + 1, f"r{c}") for c in costs], "v INT, n BIGINT, best STRING")
    values = spark.createDataFrame([(v,) for v in asked], "v INT")
    got = rows(steps_up_to(values, steps, span))
    want = []
    for v in asked:
        below = [c for c in costs if c <= v]
        want.append((v, sum(c % 3 + 1 for c in below), f"r{below[-1]}" if below else None))
    assert got == sorted(want, key=repr)


def brute_sessions(events, gap, longest):
    out = []
    for key in sorted({k for k, _ in events}):
        times = sorted(t for k, t in events if k == key)
        groups = []
        for t in times:
            if groups and (t - groups[-1][-1]).total_seconds() <= gap:
                groups[-1].append(t)
            else:
                groups.append([t])
        for group in groups:
            pieces = {}
            for t in group:
                pieces.setdefault(int((t - group[0]).total_seconds() // longest), []).append(t)
            out += [(key, p[0], p[-1], len(p)) for p in pieces.values()]
    return sorted(out, key=repr)


@pytest.mark.parametrize("gap, longest", [(10, 60), (60, 45), (7, 1000)])
def test_sessionize(spark, gap, longest):
    rng = random.Random(gap)
    events = []
    for _ in range(800):
        key = 1 if rng.random() < 0.5 else rng.randint(2, 6)
        events.append((key, T0 - timedelta(seconds=500) + timedelta(milliseconds=rng.randint(0, 3_000_000))))
    df = spark.createDataFrame(events, "admin_id BIGINT, ts TIMESTAMP_NTZ")
    got = sessions.sessionize(df, "admin_id", "ts", gap, longest)
    assert rows(got, "admin_id", "session_start", "session_end", "event_count") == brute_sessions(events, gap, longest)


def test_sessionize_before_epoch(spark):
    events = [(1, datetime(1969, 12, 31, 23, 59, s)) for s in (0, 8, 30)] + [(1, datetime(1970, 1, 1, 0, 0, 1))]
    df = spark.createDataFrame(events, "admin_id BIGINT, ts TIMESTAMP_NTZ")
    got = sessions.sessionize(df, "admin_id", "ts", 10, 3600)
    assert rows(got, "admin_id", "session_start", "session_end", "event_count") == brute_sessions(events, 10, 3600)


def test_peak_concurrency(spark):
    rng = random.Random(5)
    spans = []
    for _ in range(300):
        start = T0 + timedelta(seconds=rng.randint(0, 3 * 86400))
        spans.append((start, None if rng.random() < 0.1 else start + timedelta(seconds=rng.randint(0, 90000))))
    df = spark.createDataFrame(spans, "login_time TIMESTAMP_NTZ, logout_time TIMESTAMP_NTZ")
    spans.append((T0 + timedelta(days=9), T0 + timedelta(days=12)))  # days without an edge
    spans += [(T0 + timedelta(days=20, seconds=5),) * 2] * 3  # sessions of one second
    df = spark.createDataFrame(spans, "login_time TIMESTAMP_NTZ, logout_time TIMESTAMP_NTZ")
    edges = sorted({s for s, _ in spans} | {e for _, e in spans if e})
    want = {}
    day = edges[0].date()
    while day <= edges[-1].date():
        start = datetime(day.year, day.month, day.day)
        want[day] = sum(1 for s, e in spans if s < start and (e is None or e >= start))
        for at in {s for s, _ in spans if s.date() == day}:
            want[day] = max(want[day], sum(1 for s, e in spans if s <= at and (e is None or e >= at)))
        day += timedelta(days=1)
    assert rows(sessions.peak_concurrency(df)) == sorted(want.items(), key=repr)


def test_visits_count_twice(spark):
    visits = spark.sql("SELECT 1L id, 1L admin_id, 'p' page_name, '/p' page_url, 30 visit_duration")
    both = sessions.visit_rows(visits)
    assert rows(sessions.page_visits(both), "visits", "avg_seconds") == [(2, 15.0)]
    assert rows(sessions.page_visits_corrected(both), "visits", "avg_seconds") == [(1, 30.0)]


def test_double_fire(spark):
    log = spark.createDataFrame(
        [(1, 1, "c", None, T0), (2, 1, "c", None, T0 + timedelta(milliseconds=5)), (3, 1, "c", None, T0 + timedelta(seconds=1)),
         (4, 1, "c", "r", T0)],
        "id BIGINT, admin_id BIGINT, activity_type STRING, target_resource STRING, created_at TIMESTAMP_NTZ",
    )
    kept = sessions.drop_double_fire(log)
    assert rows(kept, "id") == [(1,), (3,), (4,)] and kept.columns == log.columns
    late = timedelta(milliseconds=999)
    log = log.union(spark.createDataFrame([(5, 2, "c", None, T0 + late), (6, 2, "c", None, T0 + late + timedelta(milliseconds=2))], log.schema))
    assert rows(sessions.drop_double_fire(log), "id") == [(1,), (3,), (4,), (5,), (6,)]
    assert rows(sessions.drop_close_fire(log, 500_000), "id") == [(1,), (3,), (4,), (5,)]
    assert rows(sessions.drop_close_fire(log, 2_000_000), "id") == [(1,), (4,), (5,)]


def test_merge_rules(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", None, 2)], "k STRING, s STRING, n INT")
    seed = spark.createDataFrame([("b", "new", 9), ("c", "c", 3)], "k STRING, s STRING, n INT")
    assert rows(merge.seed_keep(old, seed, ["k"])) == [("a", "x", 1), ("b", None, 2), ("c", "c", 3)]
    assert rows(merge.seed_overwrite(old, seed, ["k"], ["n"])) == [("a", "x", 1), ("b", None, 9), ("c", "c", 3)]
    assert rows(merge.changed_keys(old, seed, "k", "n")) == [("b", 2, 9)]
    assert rows(merge.changed_keys(old, seed, "k", "s")) == []


def test_change_log(spark):
    old = spark.createDataFrame([("a", "x", 1), ("gone", "g", 0), ("same", "s", 5)], "k STRING, s STRING, n INT")
    new = spark.createDataFrame([("a", "", 2), ("add", "d", 0), ("same", "s", 5)], "k STRING, s STRING, n INT")
    got = rows(merge.change_log(old, new, "k", ["s", "n"], "t"), "record_id", "operation_type", "field_name", "old_value", "new_value", "new_values")
    assert got == sorted([
        ("a", "UPDATE", "s", "x", None, None), ("a", "UPDATE", "n", "1", "2", '{"n":2}'),
        ("gone", "DELETE", "s", "g", None, None), ("gone", "DELETE", "n", None, None, None),
        ("add", "INSERT", "s", None, "d", '{"s":"d"}'), ("add", "INSERT", "n", None, None, None),
    ], key=repr)


def test_change_log_of_booleans(spark):
    old = spark.createDataFrame([(1, True), (2, False)], "k INT, b BOOLEAN")
    new = spark.createDataFrame([(1, False), (2, True)], "k INT, b BOOLEAN")
    got = merge.change_log(old, new, "k", ["b"], "t")
    assert rows(got, "record_id", "old_value", "new_value", "old_values", "new_values") == [
        (1, "true", None, '{"b":true}', None), (2, None, "true", None, '{"b":true}'),
    ]


def test_delete_rules(spark):
    child = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id INT, parent INT")
    gone = spark.createDataFrame([(10,), (10,)], "pid INT")
    assert rows(merge.delete_cascade(child, "parent", gone, "pid")) == [(2, 20), (3, None)]
    assert rows(merge.delete_set_null(child, "parent", gone, "pid")) == [(1, None), (2, 20), (3, None)]


def test_quality_rules(spark):
    users = spark.createDataFrame(
        [(1, "ok_1", "a@b.c", "Al", "Bo"), (2, "a!", "a@b", " A ", None), (3, "bad name", None, "Al", "Bo"), (4, None, "a@b.c", "Al", "Bo")],
        "id INT, username STRING, email STRING, first_name STRING, last_name STRING",
    )
    assert rows(quality.registration_violations(users)) == sorted([
        (2, "username", "too short"), (2, "email", "invalid address"), (2, "first_name", "too short"), (2, "last_name", "too short"),
        (3, "username", "invalid characters"), (3, "email", "invalid address"), (4, "username", "too short"),
    ], key=repr)
    dup = quality.duplicate_keys({"users": (users.select(F.lit(1).alias("k")), ["k"])})
    assert rows(dup) == [("users", "k", 1, 3)]
    lost = quality.orphans([("users", users, "id", "p", users.filter("id > 1").select("id"), "id")])
    assert rows(lost) == [("users", "id", "p", 1, 1)]
    assert rows(quality.null_and_length("u", users, {"email": (True, 4), "username": (False, None)})) == [
        ("u", "email", 1, 2), ("u", "username", 0, 0)
    ]


def test_ingest_gates(spark):
    raw = spark.createDataFrame([(1, '{"a": "x", "n": 1}'), (2, '{"a": '), (3, '{"a": "y", "n": "zz"}'), (4, None)], "id INT, value STRING")
    got = rows(parse_requests(raw, "a STRING, n INT"), "id", "a", "n", F.col("malformed").isNotNull())
    assert got == [(1, "x", 1, False), (2, None, None, True), (3, None, None, True), (4, None, None, False)]
    feed = spark.createDataFrame([("t", None, "d"), ("t", "d", None), (None, "d", None)], "activity_type STRING, description STRING, activity_description STRING")
    accepted, rest = lookups.split_required(lookups.normalise_requests(feed), ["activity_type", "description"])
    assert (accepted.count(), rest.count()) == (2, 1)


def test_retry_keys(spark):
    failed = spark.createDataFrame([(1, "POST", "/a"), (1, "GET", "/a"), (2, "POST", "/a")], "timestamp INT, method STRING, endpoint STRING")
    done = spark.createDataFrame([(1, "POST", "/a"), (9, "POST", "/a")], "timestamp INT, method STRING, endpoint STRING")
    assert rows(lookups.remaining_retries(failed, done)) == [(1, "GET", "/a"), (2, "POST", "/a")]


def test_intent_phrases(spark):
    kb = spark.createDataFrame(
        [("earn", '["points", "get points now"]', 5), ("reward", '["points", "prize"]', 9), ("off", '["prize"]', 99)],
        "category STRING, keywords STRING, priority INT",
    ).withColumn("is_active", F.col("category") != "off")
    texts = ["Points!", "How to GET points, now?", "a prize", "pointsman", "", "prize points points"]
    messages = spark.createDataFrame(list(enumerate(texts)), "id INT, message_content STRING")
    assert rows(lookups.match_intents(messages, kb)) == [(0, "reward", 1), (1, "earn", 2), (2, "reward", 1), (5, "reward", 2)]


def test_login_logout(spark):
    logins = spark.createDataFrame([(7, 1, "ip", T0)], "id BIGINT, admin_id BIGINT, ip_address STRING, login_time TIMESTAMP_NTZ")
    opened = lookups.login_sessions(logins).first()
    assert opened.session_token.startswith(f"sess_1704067200_1_") and opened.is_active
    assert lookups.login_log(logins).first().activity_description == "Admin logged in successfully"
    outs = spark.createDataFrame([(7, 1, T0 + timedelta(seconds=90)), (7, 2, T0), (8, 1, T0)], "session_id BIGINT, admin_id BIGINT, event_time TIMESTAMP_NTZ")
    closed = lookups.close_sessions(outs, logins).collect()
    assert len(closed) == 1 and closed[0].session_duration == 90 and not closed[0].is_active
    admins = spark.createDataFrame([(1,), (2,)], "id BIGINT")
    logged = rows(lookups.logout_log(outs, logins, admins), "admin_id", "activity_description", "ip_address")
    assert logged == [(1, "Admin logged out after 90 seconds", "ip"), (2, "Admin logged out after 0 seconds", "ip")]
    outcomes = rows(lookups.match_logouts(outs, logins, admins.filter("id = 1")), "session_id", "admin_id", "outcome")
    assert outcomes == [(7, 1, "closed"), (7, 2, "rejected"), (8, 1, "rejected")]


def test_hot_user_is_split_in_the_ledger_join(spark):
    """A third of the ledger on one user: the join splits that user's partition."""
    ledger = spark.range(0, 300_000, 1, 4).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("user_id"),
        F.lit(1).alias("points"),
        F.lit("waste_deposit").alias("type"),
        F.lit("plastic").alias("waste_category"),
        F.lit(T0.isoformat(sep=" ")).cast("timestamp_ntz").alias("timestamp"),
    )
    profiles = spark.range(0, 100_000, 1, 4).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("user_id"),
        F.lit("n").alias("display_name"),
        F.lit("e").alias("email"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = transaction_summary(ledger, profiles)
        joined.write.format("noop").mode("overwrite").save()
        assert joined.count() == 300_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
