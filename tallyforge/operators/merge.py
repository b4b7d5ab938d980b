"""Bringing one table version onto another: upserts, diffs, delete rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def _same_key(keys: list[str]) -> list[Column]:
    return [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]


def merge(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Full outer join on unique keys; ``rules`` combine ``old.x`` and ``new.x``."""
    joined = old.alias("old").join(new.alias("new"), _same_key(keys), "full_outer")
    return joined.select(
        *[F.coalesce(f"new.{k}", f"old.{k}").alias(k) for k in keys],
        *[rule.alias(name) for name, rule in rules.items()],
    )


def seed_keep(existing: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """Insert seed rows whose key is new; existing rows win."""
    fresh = seed.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def seed_overwrite(existing: DataFrame, seed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Insert new keys and overwrite the listed columns of known ones."""
    known = F.col(f"new.{keys[0]}").isNotNull()
    unknown = F.col(f"old.{keys[0]}").isNull()
    rules = {}
    for name in existing.columns:
        if name in keys:
            continue
        take_new = known if name in columns else unknown
        rules[name] = F.when(take_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
    return merge(existing, seed, keys, rules).select(*existing.columns)


def changed_keys(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose value differs; NULL on either side does not count."""
    return (
        old.select(key, F.col(column).alias("old_value"))
        .join(new.select(key, F.col(column).alias("new_value")), key)
        .filter(F.col("old_value") != F.col("new_value"))
    )


def _shown(column: Column, data_type: T.DataType) -> Column:
    """Text of a value; empty, zero and false values are recorded as NULL."""
    kinds = {T.StringType: "", T.BooleanType: False}
    empty = F.lit(kinds.get(type(data_type), 0))
    if isinstance(data_type, (T.StringType, T.BooleanType, T.NumericType)):
        return F.when(column != empty, column.cast("string"))
    return column.cast("string")


def change_log(old: DataFrame, new: DataFrame, key: str, fields: list[str], table: str) -> DataFrame:
    """One row per changed field between two versions of a table."""
    joined = old.alias("old").join(new.alias("new"), _same_key([key]), "full_outer")
    operation = F.when(F.col(f"old.{key}").isNull(), "INSERT").when(F.col(f"new.{key}").isNull(), "DELETE").otherwise(
        "UPDATE"
    )
    changes = [
        F.struct(
            F.lit(f).alias("field_name"),
            (~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}"))).alias("changed"),
            _shown(F.col(f"old.{f}"), old.schema[f].dataType).alias("old_value"),
            _shown(F.col(f"new.{f}"), new.schema[f].dataType).alias("new_value"),
            F.to_json(F.struct(F.col(f"old.{f}").alias(f))).alias("old_json"),
            F.to_json(F.struct(F.col(f"new.{f}").alias(f))).alias("new_json"),
        )
        for f in fields
    ]
    # the value itself, numbers and booleans unquoted
    as_json = lambda side: F.when(F.col(f"{side}_value").isNotNull(), F.col(f"{side}_json"))
    return (
        joined.select(
            F.coalesce(f"new.{key}", f"old.{key}").alias("record_id"),
            operation.alias("operation_type"),
            F.inline(F.array(*changes)),
        )
        .filter("changed")
        .select(
            F.lit(table).alias("table_name"),
            "record_id",
            "operation_type",
            "field_name",
            "old_value",
            "new_value",
            as_json("old").alias("old_values"),
            as_json("new").alias("new_values"),
            F.concat("operation_type", F.lit(f" operation on {table}")).alias("activity_description"),
        )
    )


def delete_cascade(child: DataFrame, column: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """Child rows that survive the deletion of their parents."""
    gone = deleted.select(F.col(deleted_key).alias(column))
    return child.join(gone, column, "left_anti").select(*child.columns)


def delete_set_null(child: DataFrame, column: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """All child rows, with references to deleted parents cleared."""
    gone = deleted.select(F.col(deleted_key).alias("_gone")).distinct()
    joined = child.join(gone, F.col(column) == F.col("_gone"), "left")
    cleared = F.when(F.col("_gone").isNull(), F.col(column)).alias(column)
    return joined.select(*[cleared if c == column else F.col(c) for c in child.columns])
