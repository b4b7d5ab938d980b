from datetime import date, datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallyforge.functions import client, formats, labels
from tallyforge.functions.dates import preset_range, rows_of_days, seconds_between, younger_than
from tallyforge.functions.ids import session_token, stable_id
from tallyforge.harness.fixtures import USER_AGENTS


@pytest.mark.parametrize(
    "preset, start",
    [
        ("1d", date(2024, 2, 28)),
        ("7d", date(2024, 2, 22)),
        ("30d", date(2024, 1, 30)),
        ("90d", date(2023, 12, 1)),
        ("1y", date(2023, 3, 1)),
        ("whatever", date(2024, 2, 22)),
    ],
)
def test_presets(preset, start):
    assert preset_range(preset, date(2024, 2, 29)) == (start, date(2024, 2, 29))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_day_range_is_inclusive(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 00:00:00'), (TIMESTAMP_NTZ '2024-01-02 23:59:59.9'), "
        "(TIMESTAMP_NTZ '2024-01-03 00:00:00'), (TIMESTAMP_NTZ '2023-12-31 23:59:59') AS t(ts)"
    )
    assert rows_of_days(df, "ts", date(2024, 1, 1), date(2024, 1, 2)).count() == 2


def test_seconds_truncate(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00.9' a, TIMESTAMP_NTZ '2024-01-01 00:00:02.1' b")
    assert df.select(seconds_between("a", "b")).first()[0] == 1


def test_younger_than(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 12:00:00'), (TIMESTAMP_NTZ '2024-01-01 12:00:01') AS t(ts)"
    )
    assert df.filter(younger_than("ts", datetime(2024, 1, 2, 12))).count() == 1


def test_truthy_fallback(spark):
    df = spark.createDataFrame([("A", "u"), ("", "u"), ("0", "u"), (None, "u")], "d STRING, u STRING")
    assert [r[0] for r in df.select(labels.truthy_or(F.col("d"), F.col("u"))).collect()] == ["A", "u", "u", "u"]


def test_status_classes(spark):
    df = spark.createDataFrame([(s,) for s in (None, 100, 200, 299, 302, 400, 500)], "s INT")
    got = df.agg(F.count_if(labels.http_success(F.col("s"))), F.count_if(labels.http_error(F.col("s")))).first()
    assert tuple(got) == (2, 2)


def test_rates_with_zero_denominator(spark):
    assert one(spark, labels.percentage(F.lit(0), F.lit(0))) is None
    assert one(spark, labels.percentage_or_zero(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, labels.percentage_or_zero(F.lit(2), F.lit(3))) == 66.67


def test_bands_and_labels(spark):
    df = spark.createDataFrame([(90.1,), (90.0,), (70.1,), (70.0,)], "r DOUBLE")
    assert [r[0] for r in df.select(labels.rate_band(F.col("r"))).collect()] == ["green", "yellow", "yellow", "red"]
    df = spark.createDataFrame([(True,), (False,), (None,)], "f BOOLEAN")
    assert [r[0] for r in df.select(labels.resolved_label(F.col("f"))).collect()] == ["Resolved", "Pending", "Pending"]
    df = spark.createDataFrame([(1,), (0,), (-1,)], "p INT")
    assert [r[0] for r in df.select(labels.sign_label(F.col("p"))).collect()] == ["+", "+", ""]


def test_user_agents(spark):
    df = spark.createDataFrame([(u,) for u in USER_AGENTS], "ua STRING")
    ua = F.col("ua")
    faithful = [tuple(r) for r in df.select(client.browser_name(ua), client.browser_version(ua), client.os_name(ua)).collect()]
    assert faithful == [
        ("Chrome", "119", "Windows"),
        ("Firefox", "120", "Linux"),
        ("Chrome", "118", "Linux"),
        ("Safari", "604", "macOS"),
        ("Edge", "18", "Windows"),
        ("Unknown", "Unknown", "Unknown"),
    ]
    corrected = [tuple(r) for r in df.select(client.browser_name(ua, True), client.os_name(ua, True)).collect()]
    assert corrected == [
        ("Edge", "Windows"),
        ("Firefox", "Linux"),
        ("Chrome", "Android"),
        ("Safari", "iOS"),
        ("Edge", "Windows"),
        ("Unknown", "Unknown"),
    ]


def test_device_and_tags(spark):
    df = spark.createDataFrame([("767x1",), ("768x1",), ("1023x1",), ("1024x1",)], "r STRING")
    device = client.device_type(client.screen_width(F.col("r")))
    assert [r[0] for r in df.select(device).collect()] == ["mobile", "tablet", "tablet", "desktop"]
    df = spark.createDataFrame([("SAVE:DATA",), ("SAVE",)], "t STRING")
    assert [tuple(r) for r in df.select(*client.tag_parts(F.col("t"))).collect()] == [("SAVE", "DATA"), ("SAVE", None)]


def test_descriptions(spark):
    assert one(spark, client.change_description(F.lit("UPDATE"), F.lit("profiles"))) == "UPDATE operation on profiles"
    assert one(spark, client.feature_description(F.lit("export"))) == "Used feature: export"
    assert one(spark, client.error_description(F.lit("E"), F.lit("m"))) == "E: m"
    assert one(spark, client.click_description(F.lit("  Save "))) == "Clicked on Save"
    assert one(spark, client.visit_seconds(F.lit(2999))) == 2
    assert one(spark, client.execution_ms(F.lit(0.0129))) == 12


def test_formats(spark):
    assert one(spark, formats.clock_of(F.lit(3661))) == "01:01:01"
    assert one(spark, formats.clock_of(F.lit(90061))) == "01:01:01"
    ts = F.lit("2024-01-05 07:08:09").cast("timestamp_ntz")
    assert one(spark, formats.hour_minute(ts)) == "07:08"
    assert one(spark, formats.day_and_time(ts)) == "Jan 5, 07:08"
    assert one(spark, formats.one_decimal(F.lit(98.76))) == "98.8"


def test_ids_are_stable(spark):
    df = spark.range(3).withColumn("ts", F.lit("1970-01-01 00:01:00").cast("timestamp_ntz"))
    token = session_token(F.col("ts"), F.lit(7), F.col("id"))
    first, second = df.select(token.alias("t")), df.repartition(3).select(token.alias("t"))
    assert rows(first) == rows(second)
    assert all(t.startswith("sess_60_7_") and len(t) == len("sess_60_7_") + 16 for (t,) in rows(first))
    assert df.select(stable_id(F.col("id"))).distinct().count() == 3


def test_case_blind_keys(spark):
    df = spark.createDataFrame([("Login",), ("LOGIN",), ("lógin",), ("view",)], "t STRING")
    assert df.groupBy(labels.case_blind(F.col("t")).alias("t")).count().count() == 2
    assert df.groupBy("t").count().count() == 4
