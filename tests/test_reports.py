from datetime import date
from types import SimpleNamespace

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallyforge.harness.queries import tables_of
from tallyforge.plans import reports, rollups
from tallyforge.plans.activity import daily_trends
from tallyforge.plans.views import VIEWS, create_views
from tallyforge.sources import sinks
from tallyforge.sources.schemas import DDL, DEFAULTS, ENUMS, FOREIGN_KEYS, UNIQUE_KEYS, schema_of

AS_OF = date(2024, 1, 20)

SECTIONS = {
    "overview": {"overview"},
    "admin_activity": {"daily_trends", "activity_breakdown", "admin_summary"},
    "security": {"security_events", "recent_events", "security_trends"},
    "performance": {"admin_performance", "system_trends"},
    "feature_usage": {"feature_usage", "feature_trends"},
    "system_health": {"system_health"},
}


def test_schemas_are_consistent(spark):
    assert len(DDL) == 26
    for table, keys in UNIQUE_KEYS.items():
        assert all(set(k) <= set(schema_of(table).names) for k in keys)
    for child, column, parent, parent_column, _ in FOREIGN_KEYS:
        assert column in schema_of(child).names and parent_column in schema_of(parent).names
    for table, column in ENUMS:
        assert column in schema_of(table).names
    for table, values in DEFAULTS.items():
        assert set(values) <= set(schema_of(table).names)


@pytest.mark.parametrize("report", sorted(SECTIONS))
def test_sections(data, report):
    got = reports.generate_report(tables_of(data), report, "7d", AS_OF)
    assert set(got) == SECTIONS[report]
    for frame in got.values():
        assert frame.count() > 0


def test_unknown_names(data):
    with pytest.raises(ValueError):
        reports.generate_report(tables_of(data), "nope", "7d", AS_OF)
    with pytest.raises(ValueError):
        reports.generate_analytics(tables_of(data), "nope", AS_OF)
    with pytest.raises(ValueError):
        reports.generate_analytics(tables_of(data), "admin", AS_OF)


@pytest.mark.parametrize("kind", reports.ANALYTICS)
def test_analytics_kinds(data, kind):
    assert reports.generate_analytics(tables_of(data), kind, date(2024, 1, 15), admin_id=1).count() >= 0


def test_empty_range_keeps_one_record(data):
    t = tables_of(data)
    far = date(2030, 1, 1)
    got = reports.overview(t.sessions, t.log, t.visits, t.events, t.usage, t.admins, far, far).collect()
    assert len(got) == 1
    assert got[0].total_sessions == 0 and got[0].total_activities == 0
    assert got[0].most_active_admin is None and got[0].avg_session_duration is None
    long = {r.metric: r.value for r in reports.overview_long(
        reports.overview(t.sessions, t.log, t.visits, t.events, t.usage, t.admins, far, far)).collect()}
    assert long["most_used_feature"] is None and long["total_sessions"] == '{"count":0}'
    health = reports.system_health(t.sessions, t.log, far, far).collect()
    assert len(health) == 1 and health[0].error_rate is None and health[0].uptime_days == 0


def test_every_report_exports(spark, data, tmp_path):
    t = tables_of(data)
    for report in reports.REPORTS:
        sections = reports.generate_report(t, report, "7d", AS_OF)
        expected = {name: frame.count() for name, frame in sections.items()}
        for paths, read in (
            (sinks.export_csv(sections, str(tmp_path), report, "7d"), lambda p: spark.read.option("header", True).csv(p)),
            (sinks.export_json(sections, str(tmp_path), report, "7d"), spark.read.json),
        ):
            assert set(paths) == set(sections)
            for section, path in paths.items():
                assert f"admin_analytics_{report}_7d." in path
                assert read(path).count() == expected[section]


def test_rebuild_switches_versions(spark, data, tmp_path):
    root = f"{tmp_path}/board"
    first = sinks.rebuild(data.profiles, root)
    second = sinks.rebuild(first.filter("eco_points > 0"), root)
    assert sinks.latest_version(spark, root) == 1
    assert second.count() < first.count() == data.profiles.count()


def test_day_folders_are_pruned(spark, data, tmp_path):
    path = f"{tmp_path}/log"
    sinks.append_by_day(data.activity_log, path, "created_at")
    log = spark.read.parquet(path)
    pruned = daily_trends(log, date(2024, 1, 13), date(2024, 1, 20))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual" in plan
    assert rows(pruned) == rows(daily_trends(data.activity_log, date(2024, 1, 13), date(2024, 1, 20)))


def test_replace_days_rewrites_only_those(spark, data, tmp_path):
    t = tables_of(data)
    path = f"{tmp_path}/rollup"
    whole = rollups.daily_rollup(t.sessions, t.log, t.visits, t.usage)
    sinks.replace_days(whole.withColumn("total_activities", F.lit(-1).cast("long")), path)
    start, end = date(2024, 1, 10), date(2024, 1, 12)
    sinks.replace_days(rollups.daily_rollup_of(t.sessions, t.log, t.visits, t.usage, start, end), path)
    stored = spark.read.parquet(path)
    fresh = stored.filter("total_activities >= 0")
    assert stored.count() == whole.count() and fresh.count() == 3
    columns = ["date", "total_admin_logins", "total_activities", "total_page_views", "most_active_admin", "most_used_feature"]
    assert rows(fresh, *columns) == rows(whole.filter(F.col("date").between(start, end)), *columns)


def test_sections_come_in_display_order(data):
    got = reports.generate_report(tables_of(data), "admin_activity", "7d", AS_OF)
    days = [r.date for r in got["daily_trends"].collect()]
    assert days == sorted(days)
    counts = [r["count"] for r in got["activity_breakdown"].collect()]
    assert counts == sorted(counts, reverse=True)


def test_views_answer_sql(spark, data):
    tables = SimpleNamespace(
        admins=data.admins, sessions=data.sessions, log=data.activity_log, events=data.security_events,
        usage=tables_of(data).usage, chat_users=data.chat_users, chat_sessions=data.chat_sessions,
        chat_messages=data.chat_messages, transactions=data.transactions, profiles=data.profiles,
        waste_categories=data.waste_categories,
    )
    for name in create_views(tables, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")):
        assert spark.sql(f"SELECT * FROM {name} LIMIT 5").count() > 0
    top = spark.sql("SELECT rank_position FROM v_leaderboard ORDER BY rank_position LIMIT 5")
    assert [r[0] for r in top.collect()] == [1, 2, 3, 4, 5]
    assert set(VIEWS) <= set(spark_views(spark))


def spark_views(spark):
    return [t.name for t in spark.catalog.listTables()]
