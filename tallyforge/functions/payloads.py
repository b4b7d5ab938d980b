"""JSON payloads of the log as VARIANT: read without a declared schema, malformed text kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def typed(payload: Column, path: str, data_type: str) -> Column:
    """A value of a parsed payload, NULL if it is absent or of another kind."""
    return F.try_variant_get(payload, path, data_type)


def parsed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with each payload column parsed, and ``malformed``: whether one has text that is no JSON.

    The text of a malformed payload stays in ``<column>_text``; its VARIANT is NULL.
    """
    bad = F.lit(False)
    for column in columns:
        rows = rows.withColumn(f"{column}_text", F.col(column)).withColumn(column, F.try_parse_json(f"{column}_text"))
        bad = bad | (F.col(column).isNull() & F.col(f"{column}_text").isNotNull())
    return rows.withColumn("malformed", bad)


def fields_of(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, field, value): one row for each field of an object, its value as text. Rows without an object have none."""
    return rows.sparkSession.sql(
        f"SELECT r.`{key}`, f.key AS field, try_variant_get(f.value, '$', 'string') AS value "
        f"FROM {{rows}} r, LATERAL variant_explode(r.`{column}`) f WHERE f.key IS NOT NULL",
        rows=rows.select(key, column),
    )


def changed_fields(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, field, old_value, new_value) of the fields that differ between two payloads of a row; an absent field is NULL.

    ``key`` is unique. Both payloads are taken apart and meet by (key, field) in one shuffle.
    """
    sides = fields_of(rows, key, old).withColumn("side", F.lit("old")).unionByName(fields_of(rows, key, new).withColumn("side", F.lit("new")))
    value = lambda side: F.max(F.when(F.col("side") == side, F.col("value"))).alias(f"{side}_value")
    both = sides.groupBy(key, "field").agg(value("old"), value("new"))
    return both.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
