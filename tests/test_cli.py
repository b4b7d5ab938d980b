import pytest
from pyspark.sql import functions as F

from tallyforge.__main__ import STORED, main, print_rows
from tallyforge.harness.queries import tables_of
from tallyforge.sources.schemas import schema_of


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """The test frames stored under their declared schemas."""
    root = tmp_path_factory.mktemp("tables")
    frames = vars(tables_of(data))
    for name, table in STORED.items():
        frame = frames[name]
        columns = [
            (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema_of(table)
        ]
        frame.select(*columns).write.parquet(f"{root}/{table}")
    return str(root)


@pytest.mark.parametrize("report", ["overview", "admin_activity", "security", "performance", "feature_usage", "system_health"])
def test_reports_over_stored_tables(folder, tmp_path, spark, capsys, report):
    base = ["report", "--tables", folder, "--type", report, "--as-of", "2024-01-20"]
    assert main([*base, "--format", "csv", "--out", str(tmp_path)]) == 0
    for path in capsys.readouterr().out.split():
        assert spark.read.option("header", True).csv(path).count() > 0


def test_show_and_analytics(folder, capsys):
    assert main(["report", "--tables", folder, "--as-of", "2024-01-20"]) == 0
    assert "most_active_admin" in capsys.readouterr().out
    assert main(["analytics", "--tables", folder, "--type", "admin", "--admin-id", "1", "--date", "2024-01-15"]) == 0
    assert "total_activities" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["report", "--tables", folder, "--format", "csv"])


def test_all_rows_are_printed_and_exported(folder, tmp_path, spark, capsys):
    print_rows(spark.range(250))
    assert len(capsys.readouterr().out.splitlines()) == 251
    print_rows(spark.range(250), 2)
    assert capsys.readouterr().out.splitlines() == ["id", "0", "1", "(248 more rows)"]
    daily = ["analytics", "--tables", folder, "--type", "daily", "--date", "2024-01-15"]
    assert main([*daily, "--format", "json", "--out", str(tmp_path)]) == 0
    assert spark.read.json(capsys.readouterr().out.split()[0]).count() > 0
