"""Order-safe folds, late rows, live sessions, boards, deletes, intervals and payloads on rows that the given tables lack."""

import random
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from helpers import SF, rows
from pyspark.sql import functions as F

from tallyforge.functions import payloads
from tallyforge.operators import board, cascade, intervals, quality, registers, sessions
from tallyforge.session import scratch_path
from tallyforge.sources.readers import stream_files
from tallyforge.streaming import feeds, ordered
from tallyforge.streaming import sessions as live

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check_oracle  # noqa: E402

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


POINTS = "id long, user_id string, points_delta int, display_name string, email string, event_time timestamp_ntz"


@pytest.fixture(scope="module")
def feed(spark):
    rng = random.Random(1)
    given = [
        (i, f"u{rng.randrange(12)}", rng.choice([None, 1, 5, -2]), rng.choice([None, "a", "b", "c"]), rng.choice([None, "x@", "y@"]),
         rng.choice([None, at(rng.randrange(9))]))
        for i in range(400)
    ]
    return spark.createDataFrame(given, POINTS)


def test_any_split_and_order_gives_one_state(spark, feed):
    whole = rows(registers.state_of(feed, registers.POINTS))
    profiles = spark.createDataFrame(
        [("u1", "old@", "Old", 7, at(-99)), ("u99", None, None, 3, at(-5))],
        "user_id string, email string, display_name string, eco_points int, joined_at timestamp_ntz",
    )
    seen = rows(registers.points_view(profiles, registers.state_of(feed, registers.POINTS)))
    for seed in range(4):
        rng = random.Random(seed)
        cut = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(3 + seed))
        states = [registers.state_of(feed.filter(cut == i), registers.POINTS) for i in range(3 + seed)]
        rng.shuffle(states)
        left = registers.folded(states[:2], registers.POINTS)
        merged = registers.folded([left, *states[2:]], registers.POINTS)
        assert rows(merged) == whole
        assert rows(registers.points_view(profiles, merged)) == seen
    assert rows(registers.folded([registers.state_of(feed.limit(0), registers.POINTS), merged], registers.POINTS)) == whole


def test_latest_value_by_brute_force(feed):
    last = {}
    for r in feed.collect():
        if r["display_name"] is not None:
            order = (r["event_time"] is not None, r["event_time"] or START, r["id"])
            last[r["user_id"]] = max(last.get(r["user_id"], ((False,),)), (order, r["display_name"]))
    got = {r["user_id"]: r["display_name"]["value"] for r in registers.state_of(feed, registers.POINTS).collect() if r["display_name"]}
    assert got == {user: name for user, (_, name) in last.items()}


def test_distinct_users_of_ranges(spark):
    rng = random.Random(2)
    given = [(str(rng.choice([1, 2, 32_768, 70_000, 2**40, rng.randrange(200)])), at(24 * rng.randrange(15))) for _ in range(900)]
    given += [("no number", at(0)), (None, at(0))]
    log = spark.createDataFrame(given, "user_id string, timestamp timestamp_ntz")
    days = registers.folded([registers.state_of(part, registers.DAY_USERS) for part in log.randomSplit([1.0, 1.0, 1.0], 7)], registers.DAY_USERS)
    want = {}
    for day in {t.date() for _, t in given}:
        want[day] = len({u for u, t in given if u and u.isdigit() and timedelta(0) <= day - t.date() < timedelta(4)})
    assert {r["date"]: r["users"] for r in registers.rolling_users(days, 4).collect()} == want
    many = spark.range(40_000).select(F.col("id").cast("string").alias("user_id"), F.lit(at(0)).cast("timestamp_ntz").alias("timestamp"))
    (estimate,) = registers.rolling_estimates(registers.state_of(many, registers.DAY_SKETCHES), 1).collect()
    assert abs(estimate["users"] - 40_000) <= registers.SKETCH_BOUND * 40_000


EVENTS = "event_id long, ts timestamp_ntz, event_type string"


def feed_in_turn(spark, slices, schema, start):
    folder = scratch_path(spark, "turns")
    for part in slices:
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(folder)
        start(stream_files(spark, folder, schema)).awaitTermination()


def test_late_repeated_and_untimed_rows_are_kept(spark):
    root = scratch_path(spark, "late-test")
    slices = [
        [(1, at(0), "a"), (1, at(0), "a"), (2, at(5), "a"), (3, None, "a")],
        [(1, at(0), "a"), (4, at(30), "b"), (4, at(30), "b"), (4, at(30), "b")],
        [(2, at(5), "a"), (5, at(21), "c"), (6, at(19), "c"), (4, at(30), "b")],
        [],
    ]
    feed_in_turn(spark, slices, EVENTS, lambda raw: ordered.keep_with_late(raw, "ts", "event_id", timedelta(hours=10), root, f"{root}/cp"))
    assert rows(ordered.parted(spark, root, "accepted"), "event_id") == [(1,), (2,), (4,), (5,)]
    assert rows(ordered.parted(spark, root, "late"), "event_id") == [(2,), (3,), (6,)]
    again = ordered.parted(spark, root, "repeated").groupBy("event_id").agg(F.sum("copies").cast("long"))
    assert rows(again) == [(1, 2), (4, 3)]


def test_cut_sessions_equal_the_batch(spark):
    rng = random.Random(6)
    moments = sorted(rng.choice([0, 1, 2, 5, 9]) + rng.random() for _ in range(1))
    hour = 0.0
    for _ in range(160):
        hour += rng.choice([0.1, 1, 3, 7.9, 8, 8.1, 30])
        moments.append(hour)
    given = [(rng.choice([1, 1, 2, None]), START + timedelta(seconds=round(h * 3600))) for h in moments]
    cuts = [given[:60], given[60:110], given[110:], [(-1, at(50_000))]]
    root = scratch_path(spark, "cut-test")
    schema = "admin_id long, ts timestamp_ntz"

    def start(raw):
        cut = live.cut_sessions(feeds.event_time(raw, "ts"), "admin_id", "ts", 8 * 3600, "2 hours")
        return feeds.run(cut.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp"))

    feed_in_turn(spark, [random.Random(i).sample(c, len(c)) for i, c in enumerate(cuts)], schema, start)
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")]
    got = spark.read.parquet(f"{root}/out").select("admin_id", *ntz, "session_seconds", "event_count")
    timed = spark.createDataFrame([g for g in given if g[0] is not None], schema)
    want = sessions.sessionize(timed, "admin_id", "ts", gap_seconds=8 * 3600)
    assert rows(got) == rows(want.select(got.columns))


def test_cut_sessions_run_in_a_session_with_another_state_store(spark):
    """As in a session that was not built here; its own store comes back."""
    plain, key = spark.newSession(), "spark.sql.streaming.stateStore.providerClass"
    plain.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    assert check_oracle.compare(plain, check_oracle.connect(SF), "stream_cut_sessions", SF).startswith("ok ")
    assert plain.conf.get(key).endswith("HDFSBackedStateStoreProvider")


def test_logouts_join_their_logins_only(spark):
    schema = "kind string, session_id long, admin_id long, event_time timestamp_ntz"
    slices = [
        [("logout", 1, 10, at(2)), ("login", 2, 10, at(0)), ("login", 3, 11, at(0)), ("logout", 9, 9, at(1))],
        [("login", 1, 10, at(1)), ("logout", 2, 11, at(3)), ("logout", 3, 11, at(25)), ("login", 4, 12, at(5)), ("logout", 4, 12, at(5))],
        [("login", -1, -1, at(9_000)), ("logout", -1, -1, at(9_000))],
    ]
    root = scratch_path(spark, "ends-test")

    def start(raw):
        feed = feeds.event_time(raw, "event_time")
        ends = live.session_ends(feed.filter("kind = 'login'"), feed.filter("kind = 'logout'"), "48 hours")
        return feeds.run(ends.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp"))

    feed_in_turn(spark, slices, schema, start)
    got = spark.read.parquet(f"{root}/out").filter("session_id > 0").select("session_id", "session_duration", F.col("logout_time").isNull())
    assert rows(got) == [(1, 3600, False), (2, 0, True), (3, 0, True), (4, 0, False)]


def test_board_touches_only_the_buckets_of_a_batch(spark):
    root = scratch_path(spark, "board-test")
    given = [(f"u{i:03}", None, f"name {i}" if i % 3 else None, i * 7 % 1_000, at(i % 5)) for i in range(300)]
    schema = "user_id string, email string, display_name string, eco_points int, joined_at timestamp_ntz"
    board.start_board(spark.createDataFrame(given, schema), root, width=100)
    points = {r[0]: r for r in given}
    changed = {"u001": 950, "u002": 0, "new": 955, "u010": 71}
    entry = lambda u, p: (u, None, points[u][2] if u in points else "N", p, points[u][4] if u in points else at(1))
    after = {**points, **{u: entry(u, p) for u, p in changed.items()}}
    changes = board.entries(spark.createDataFrame([after[u] for u in changed], schema)).join(
        spark.createDataFrame([(u, points[u][3]) for u in changed if u in points], "user_id string, old_points long"), "user_id", "left"
    )
    for _ in range(2):  # a batch sent again changes nothing
        assert board.update_board(changes, root, 1, width=100) == [0, 9]
        order = sorted((r for r in after.values() if r[3] > 0), key=lambda r: (-r[3], r[4], r[0]))
        want = [(r[0], r[2] or r[0], r[3], n) for n, r in enumerate(order, 1)]
        assert sorted((tuple(r) for r in board.read_board(spark, root).collect()), key=lambda r: r[3]) == want


def test_deletes_follow_references_through_tables(spark):
    tables = {
        "leaf": spark.createDataFrame([(1, 10, 100), (2, 11, 101), (3, None, None), (4, 12, 101)], "id long, mid_id long, other_id long"),
        "top": spark.createDataFrame([(1,), (2,)], "id long"),
        "mid": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, top_id long"),
        "other": spark.createDataFrame([(100, 1), (101, 2)], "id long, top_id long"),
    }
    links = [
        ("mid", "top_id", "top", "id", "cascade"), ("leaf", "mid_id", "mid", "id", "set null"), ("other", "top_id", "top", "id", "cascade"),
        ("leaf", "other_id", "other", "id", "cascade"), ("leaf", "none", "top", "id", "cascade"),
    ]
    left = cascade.delete_graph(tables, {"top": spark.createDataFrame([(2,), (2,), (None,)], "id long")}, links)
    assert list(left) == list(tables)
    assert {name: rows(frame) for name, frame in left.items()} == {
        "top": [(1,)], "mid": [(10, 1), (12, None)], "other": [(100, 1)], "leaf": [(1, 10, 100), (3, None, None)],
    }
    cleared = cascade.delete_graph(tables, {"mid": spark.createDataFrame([(11,)], "id long")}, links)["leaf"]
    assert rows(cleared) == [(1, 10, 100), (2, None, 101), (3, None, None), (4, 12, 101)]
    with pytest.raises(ValueError):
        cascade.delete_graph({"top": tables["top"]}, {}, [("top", "id", "top", "id", "cascade")])


def test_events_meet_only_the_intervals_around_them(spark):
    rng = random.Random(8)
    spans = [(i, rng.choice([1, 1, 1, 2, 3, None]), at(s := rng.randrange(200)), rng.choice([None, at(s + rng.randrange(-1, 60))])) for i in range(90)]
    events = [(rng.choice([1, 1, 1, 1, 2, 3, None]), START + timedelta(minutes=rng.randrange(15_000))) for _ in range(1_500)]
    events += [(1, at(s)) for s in range(0, 200, 7)]
    left = spark.createDataFrame(spans, "span long, admin_id long, a timestamp_ntz, b timestamp_ntz")
    right = spark.createDataFrame(events, "admin_id long, ts timestamp_ntz")
    got = intervals.events_in_intervals(left, right, ["admin_id"], "a", "b", "ts", 5 * 3600)
    want = sorted((i, t) for i, key, a, b in spans for other, t in events if key is not None and key == other and b and a <= t <= b)
    assert rows(got, "span", "ts") == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_stretch" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_payloads_keep_what_is_malformed(spark):
    given = [
        (1, '{"a": 1, "b": "x", "d": null}', '{"a": 2, "b": "x", "c": [1]}'), (2, "{", '{"a": 1}'), (3, None, '{"a": 5}'), (4, "[1]", "7"),
        (5, '{"a": "1"}', '{"a": 1}'),
    ]
    log = payloads.parsed(spark.createDataFrame(given, "id long, old string, new string"), ["old", "new"])
    assert rows(log.filter("malformed"), "id", "old_text") == [(2, "{")]
    assert rows(log.select("id", payloads.typed(F.col("new"), "$.a", "int"))) == [(1, 2), (2, 1), (3, 5), (4, None), (5, 1)]
    changed = payloads.changed_fields(log.filter("NOT malformed"), "id", "old", "new")
    assert rows(changed, "id", "field", "old_value", "new_value") == [(1, "a", "1", "2"), (1, "c", None, "[1]"), (3, "a", None, "5")]


def test_keys_and_references_read_a_table_once(spark):
    path = scratch_path(spark, "quality")
    given = [(1, "a", None), (1, "a", "x"), (2, "a", None), (None, "1:a", "x"), (None, None, None)]
    spark.createDataFrame(given, "k long, p string, q string").write.parquet(path)
    table = spark.read.parquet(path)
    checked = quality.duplicate_keys({"t": (table, [["k"], ["k", "p"], ["p", "q"]]), "none": (table.limit(0), ["k"])})
    assert rows(checked) == sorted([("none", "k", 0, 0), ("t", "k", 2, 2), ("t", "k,p", 1, 1), ("t", "p,q", 1, 1)], key=repr)
    one = quality.duplicate_keys({"t": (table, [["k"], ["k", "p"], ["p", "q"]])})
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    links = [("t", table, "k", "p", spark.range(1, 2).toDF("id"), "id"), ("t", table, "q", "p2", table.filter("k = 1"), "q")]
    assert rows(quality.orphans(links)) == [("t", "k", "p", 1, 1), ("t", "q", "p2", 0, 0)]
