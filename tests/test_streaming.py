import json
import os
import re
import time
from datetime import datetime, timedelta
from pathlib import Path

from helpers import rows
from pyspark.sql import Window, functions as F

from tallyforge.operators import folds, lookups, sessions as sessioning
from tallyforge.sources import sinks
from tallyforge.sources.readers import parse_requests, stream_files
from tallyforge.sources.schemas import schema_of
from tallyforge.streaming import feeds, state

T0 = datetime(2024, 1, 1)
SEEN: set[Path] = set()
EVENT = "event_id BIGINT, admin_id BIGINT, ts TIMESTAMP"


def add_file(df, folder, age):
    """Add one file and date it ``age`` steps after now, so files keep their order."""
    df.coalesce(1).write.mode("append").parquet(str(folder))
    for path in Path(folder).glob("*.parquet"):
        if path not in SEEN:
            SEEN.add(path)
            os.utime(path, (time.time() + 2 * age,) * 2)


def write_files(spark, folder, batches, schema):
    """One file per batch, in arrival order."""
    for i, batch in enumerate(batches):
        add_file(spark.createDataFrame(batch, schema), folder, i)


def events(ids, start=0):
    return [(i, 1 + i % 3, T0 + timedelta(minutes=start + i)) for i in ids]


def dedup_to(spark, source, out, delay):
    feed = stream_files(spark, str(source), EVENT, files_per_batch=1)
    unique = feeds.drop_repeats(feed, "ts", "event_id", delay)
    query = feeds.run(
        unique.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp")
    )
    query.awaitTermination()
    return query


def test_dedup_across_batches_and_restart(spark, tmp_path):
    source = tmp_path / "in"
    write_files(spark, source, [events(range(0, 20)), events(range(10, 30))], EVENT)
    dedup_to(spark, source, tmp_path, "40 days")
    write_files(spark, source, [events(range(5, 35))], EVENT)
    dedup_to(spark, source, tmp_path, "40 days")
    dedup_to(spark, source, tmp_path, "40 days")
    got = rows(spark.read.parquet(f"{tmp_path}/rows"), "event_id")
    assert got == sorted([(i,) for i in range(35)], key=repr)


def test_late_events_are_counted_as_dropped(spark, tmp_path):
    source = tmp_path / "in"
    far = [(1000, 1, T0 + timedelta(days=3))]
    write_files(spark, source, [events(range(0, 5)), far, [(1001, 1, T0 + timedelta(days=3, minutes=1))], events([50])], EVENT)
    query = dedup_to(spark, source, tmp_path, "1 hour")
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 1
    assert (50,) not in rows(spark.read.parquet(f"{tmp_path}/rows"), "event_id")


def test_daily_counts_equal_batch(spark, tmp_path):
    source = tmp_path / "in"
    everything = [events(range(0, 2000, 7)), events(range(3, 3000, 11)), events(range(1, 4000, 13))]
    write_files(spark, source, everything, EVENT)
    feed = stream_files(spark, str(source), EVENT, files_per_batch=1)
    counts = feeds.daily_counts(feed, "ts", "40 days")
    for _ in range(2):  # the second run finds nothing new
        feeds.write_updates(counts, f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination()
    got = (
        spark.read.schema("admin_id BIGINT, date DATE, total_activities BIGINT")
        .parquet(f"{tmp_path}/table/v=*")
        .groupBy("admin_id", "date")
        .agg(F.max("total_activities"))
    )
    flat = spark.createDataFrame([e for batch in everything for e in batch], EVENT)
    assert rows(got) == rows(flat.groupBy("admin_id", F.to_date("ts").alias("date")).count())


FEED = "id BIGINT, user_id STRING, points_delta INT, display_name STRING, email STRING, event_time TIMESTAMP_NTZ"
PROFILE = "user_id STRING, email STRING, display_name STRING, eco_points BIGINT, joined_at TIMESTAMP_NTZ"


PROFILE_COLUMNS = ["user_id", "email", "display_name", "eco_points", "joined_at"]


def deltas(n, first=0):
    return [
        (i, f"u{i % 4}", i % 9 - 3, f"n{i}" if i % 5 == 0 else None, f"e{i}" if i % 3 == 0 else None, T0 + timedelta(seconds=i))
        for i in range(first, first + n)
    ]


def test_running_table_is_exact_over_restarts(spark, tmp_path):
    source, root, checkpoint = tmp_path / "in", f"{tmp_path}/table", f"{tmp_path}/cp"
    initial = spark.createDataFrame([("u0", None, "first", 100, T0)], PROFILE)
    write_files(spark, source, [deltas(10), deltas(10, 10)], FEED)

    def run():
        feed = stream_files(spark, str(source), FEED, files_per_batch=1)
        state.keep_table(feed, state.points_fold, initial, root, checkpoint).awaitTermination()

    run()
    write_files(spark, source, [deltas(10, 20)], FEED)
    run()
    run()
    assert sinks.latest_version(spark, root) == 2
    got = sinks.read_version(spark, root, 2)
    whole = state.points_fold(initial, spark.createDataFrame(deltas(30), FEED))
    assert rows(got, *whole.columns) == rows(whole)


def test_deltas_with_compaction_equal_one_fold(spark, tmp_path):
    source, root, checkpoint = tmp_path / "in", f"{tmp_path}/table", f"{tmp_path}/cp"
    initial = spark.createDataFrame([("u0", None, "first", 100, T0)], PROFILE)

    def run():
        feed = stream_files(spark, str(source), FEED, files_per_batch=1)
        state.keep_deltas(feed, state.POINTS, root, checkpoint).awaitTermination()

    assert rows(state.folded_table(spark, root, state.POINTS, initial)) == rows(initial)
    for first in (0, 20, 40):
        write_files(spark, source, [deltas(10, first), deltas(10, first + 10)], FEED)
        run()
        whole = state.points_fold(initial, spark.createDataFrame(deltas(first + 20), FEED))
        assert rows(state.folded_table(spark, root, state.POINTS, initial), *PROFILE_COLUMNS) == rows(whole, *PROFILE_COLUMNS)
        if first == 20:
            assert state.compact(spark, root, state.POINTS, initial) == 3
    # what the base of version 3 holds is gone but for its newest delta, which a restart may repeat
    assert sinks.committed_versions(spark, f"{root}/delta") == [3, 4, 5]
    assert sinks.committed_versions(spark, f"{root}/base") == [3]


def test_combined_deltas_equal_one_batch(spark, data):
    log = data.activity_log
    messages = data.chat_messages
    for rule, frame, columns in (
        (state.FEATURES, log, ["admin_id", "feature_name", "feature_category", "usage_count", "last_used_at", "spent",
                               "first_spent", "success_count", "error_count"]),
        (state.PERFORMANCE, log, ["admin_id", "date", "total_activities"]),
        (state.INTENTS, messages, ["intent_name", "intent_category", "trigger_count", "last_triggered_at"]),
    ):
        middle = frame.agg(F.expr("percentile(id, 0.5)")).first()[0]
        halves = [frame.filter(F.col("id") <= middle), frame.filter(F.col("id") > middle)]
        parts = [rule.batch(h).withColumn("batch_id", F.lit(i)) for i, h in enumerate(halves)]
        assert rows(rule.combine(parts[0].unionByName(parts[1])), *columns) == rows(rule.batch(frame), *columns)


def test_replayed_batch_replaces_its_version(spark, tmp_path):
    root = f"{tmp_path}/table"
    initial = spark.createDataFrame([], PROFILE)
    batch = spark.createDataFrame(deltas(5), FEED)
    for _ in range(2):
        sinks.write_version(state.points_fold(initial, batch), root, 0)
    assert rows(sinks.read_version(spark, root, 0), "eco_points") == rows(state.points_fold(initial, batch), "eco_points")


def test_json_requests_to_log_and_quarantine(spark, tmp_path):
    bodies = [
        {"id": 1, "session_token": "t1", "activity_type": "VIEW", "activity_category": "NAV", "activity_description": "d",
         "target_resource": "f", "execution_time_ms": 5, "event_time": "2024-01-01 10:00:00"},
        {"id": 2, "session_token": "t1", "activity_type": "VIEW", "activity_category": "NAV", "description": "d",
         "event_time": "2024-01-02 10:00:00"},
        {"id": 3, "session_token": "closed", "activity_type": "VIEW", "activity_category": "NAV", "description": "d",
         "event_time": "2024-01-02 10:00:00"},
        {"id": 4, "session_token": "t1", "activity_type": "VIEW", "activity_category": "NAV", "event_time": "2024-01-02 10:00:00"},
    ]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(json.dumps(b) for b in bodies) + "\n{broken\n")
    raw = stream_files(spark, str(source), "value STRING", file_format="text")
    requests = parse_requests(
        raw,
        "id BIGINT, session_token STRING, activity_type STRING, activity_category STRING, description STRING, "
        "activity_description STRING, target_resource STRING, execution_time_ms INT, event_time TIMESTAMP",
    )
    requests = lookups.normalise_requests(requests)
    sessions = spark.sql("SELECT * FROM VALUES (10L, 1L, 't1', true), (11L, 1L, 'closed', false) AS t(id, admin_id, session_token, is_active)")
    admins = spark.sql("SELECT 1L id, 'a' username, 'A' display_name")
    for _ in range(2):  # a restart finds nothing new
        feeds.ingest(requests, "activity", sessions, admins, str(tmp_path / "out"), f"{tmp_path}/cp").awaitTermination()
    log = feeds.ingested(spark, f"{tmp_path}/out")
    assert rows(log, "id", "session_id", "execution_time_ms", "ip_address") == [(1, 10, 5, "unknown"), (2, 10, 0, "unknown")]
    declared = schema_of("admin_activity_log")
    assert [(f.name, f.dataType) for f in log.schema] == [(f.name, f.dataType) for f in declared]
    refused = rows(feeds.ingested(spark, f"{tmp_path}/out", "quarantine"), "id", "reason")
    assert refused == [(3, "no active session"), (4, "incomplete"), (None, "malformed")]


def test_stream_sessions_equal_batch(spark, tmp_path):
    source = tmp_path / "in"
    times = [0, 4, 9, 30, 33, 60, 70, 71, 200]
    batch = [(i, 1 + i % 2, T0 + timedelta(minutes=m)) for i, m in enumerate(times)]
    sentinel = [(99, 9, T0 + timedelta(days=100))]
    write_files(spark, source, [batch, sentinel, sentinel], EVENT)
    feed = stream_files(spark, str(source), EVENT, files_per_batch=1)
    live = feeds.activity_sessions(feed, "ts", "10 minutes", "1 hour")
    feeds.run(
        live.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/cp")
    ).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/rows").filter("admin_id < 9")
    flat = spark.createDataFrame(batch, EVENT).select("admin_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    want = sessioning.sessionize(flat, "admin_id", "ts", 600)
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    assert rows(got, "admin_id", ntz("session_start"), ntz("session_end"), "event_count") == rows(
        want, "admin_id", "session_start", "session_end", "event_count"
    )


def test_feature_table_by_micro_batch(spark, tmp_path, data):
    log = data.activity_log.drop("additional_data")
    source = tmp_path / "in"
    part = F.ntile(3).over(Window.orderBy("created_at", "id"))
    for i in (1, 2, 3):
        add_file(log.withColumn("part", part).filter(F.col("part") == i).drop("part"), source, i)
    initial = folds.start_features(folds.feature_batch(log.limit(0)))
    feed = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", "1").parquet(str(source))
    state.keep_table(feed, state.feature_fold, initial, f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    got = sinks.read_version(spark, f"{tmp_path}/t", sinks.latest_version(spark, f"{tmp_path}/t"))
    columns = ["admin_id", "feature_name", "usage_count", "total_time_spent", "feature_category"]
    assert rows(got, *columns) == rows(folds.start_features(folds.feature_batch(log)), *columns)


def test_running_tables_stay_bounded(spark, tmp_path):
    """Many batches, restarts and compactions: neither versions nor deltas pile up."""
    source, root = tmp_path / "in", str(tmp_path / "t")
    profile = "user_id STRING, email STRING, display_name STRING, eco_points LONG, joined_at TIMESTAMP_NTZ"
    initial = spark.createDataFrame([], profile)
    for i in range(4):
        write_files(spark, source, [deltas(5, 10 * i), deltas(5, 10 * i + 5)], FEED)
        feed = stream_files(spark, str(source), FEED, files_per_batch=1)
        state.keep_table(feed, state.points_fold, initial, f"{root}/whole", f"{root}/cp1").awaitTermination()
        state.keep_deltas(feed, state.POINTS, f"{root}/deltas", f"{root}/cp2").awaitTermination()
        state.compact(spark, f"{root}/deltas", state.POINTS, initial)
        assert len(sinks.committed_versions(spark, f"{root}/whole")) <= 2
        assert len(sinks.committed_versions(spark, f"{root}/deltas/delta")) == 1
        assert len(sinks.committed_versions(spark, f"{root}/deltas/base")) <= 2
    want = rows(state.points_fold(initial, spark.createDataFrame(deltas(40), FEED)), "user_id", "eco_points")
    assert rows(state.current_table(spark, f"{root}/whole", initial), "user_id", "eco_points") == want
    assert rows(state.folded_table(spark, f"{root}/deltas", state.POINTS, initial), "user_id", "eco_points") == want


def test_day_upsert_reads_touched_folders_only(spark, tmp_path, data):
    sinks.append_by_day(data.transactions, str(tmp_path / "ledger"), "timestamp")
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    batch = data.transactions.filter(F.to_date("timestamp") == "1995-03-15")
    after = folds.daily_upsert(folds.daily_stats(data.transactions), ledger, batch)
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*date[^\]]*1995-03-15", plan)
    assert rows(after) == rows(folds.daily_stats(data.transactions))


def test_page_triggers():
    class Writer:
        def trigger(self, **kind):
            self.kind = kind
            return self

        def start(self):
            return self.kind

    assert feeds.run(Writer(), "dashboard") == {"processingTime": "30 seconds"}
    assert feeds.run(Writer(), "report") == {"processingTime": "5 minutes"}
    assert feeds.run(Writer()) == {"availableNow": True}
