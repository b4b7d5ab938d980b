"""Run a report or a day's analytics over stored tables.

    python -m tallyforge report --tables DIR --type security --range 30d --format csv --out DIR
    python -m tallyforge analytics --tables DIR --type daily --date 2024-01-15

Without ``--format`` all rows are printed, one partition at a time; ``--limit`` prints fewer
and says how many were left out.
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans import reports
from tallyforge.session import build_session
from tallyforge.sources import sinks
from tallyforge.sources.readers import read_table

# report frame -> stored table
STORED = {
    "sessions": "admin_sessions",
    "log": "admin_activity_log",
    "visits": "admin_page_visits",
    "events": "admin_security_events",
    "usage": "feature_usage_tracking",
    "admins": "admins",
    "performance": "admin_performance_metrics",
    "system": "system_usage_stats",
}


def stored_tables(spark: SparkSession, folder: str) -> reports.Tables:
    return reports.Tables(**{name: read_table(spark, f"{folder}/{t}", t) for name, t in STORED.items()})


def print_rows(frame: DataFrame, limit: int | None = None) -> None:
    """Tab-separated rows under a header; the driver holds one partition at a time."""
    print("\t".join(frame.columns))
    shown = 0
    for row in frame.toLocalIterator():
        if limit is not None and shown == limit:
            print(f"({frame.count() - limit} more rows)")
            return
        print("\t".join("" if value is None else str(value) for value in row))
        shown += 1


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyforge")
    commands = parser.add_subparsers(dest="command", required=True)
    report = commands.add_parser("report")
    report.add_argument("--type", default="overview", choices=sorted(reports.REPORTS))
    report.add_argument("--range", default="7d")
    report.add_argument("--as-of", type=date.fromisoformat, default=date.today())
    analytics = commands.add_parser("analytics")
    analytics.add_argument("--type", default="summary", choices=reports.ANALYTICS)
    analytics.add_argument("--date", type=date.fromisoformat, default=date.today())
    analytics.add_argument("--admin-id", type=int)
    analytics.add_argument("--days", type=int, default=7)
    for command in (report, analytics):
        command.add_argument("--tables", required=True)
        command.add_argument("--format", default="show", choices=["show", "csv", "json"])
        command.add_argument("--out")
        command.add_argument("--limit", type=int)
    args = parser.parse_args(arguments)
    spark = build_session()
    tables = stored_tables(spark, args.tables)
    if args.command == "analytics":
        answer = reports.generate_analytics(tables, args.type, args.date, args.admin_id, args.days)
        sections, span = {args.type: answer}, args.date.isoformat()
    else:
        sections, span = reports.generate_report(tables, args.type, args.range, args.as_of), args.range
    if args.format == "show":
        for name, frame in sections.items():
            print(name)
            print_rows(frame, args.limit)
        return 0
    if not args.out:
        parser.error("--out is needed to export")
    export = sinks.export_csv if args.format == "csv" else sinks.export_json
    for path in export(sections, args.out, args.type, span).values():
        print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
