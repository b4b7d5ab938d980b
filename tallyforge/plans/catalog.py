"""Catalogue listings and table counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def rewards_catalog(rewards: DataFrame) -> DataFrame:
    """Active rewards, cheapest first."""
    return rewards.filter("is_active").orderBy("cost_points", "id")


def knowledge_by_priority(knowledge: DataFrame) -> DataFrame:
    return knowledge.select("category", "priority").orderBy(F.desc("priority"), "category")


def sample_users(users: DataFrame, limit: int = 5) -> DataFrame:
    """A few users, in key order so the answer is repeatable."""
    return users.orderBy("user_id").limit(limit).select("user_id", "display_name", "email")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("table_name"), "count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
