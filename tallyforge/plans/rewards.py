"""Points ledger summaries and the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.functions.labels import count_where, name_or_id, sign_label
from tallyforge.operators.ranking import global_row_number, top_rows


def _named(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        name_or_id(F.col("display_name"), F.col("email"), F.col("user_id")).alias("name"),
        F.col("eco_points").alias("points"),
        "user_id",
        "joined_at",
    )


def leaderboard_plain(profiles: DataFrame) -> DataFrame:
    """Every profile, unranked (version 1)."""
    return _named(profiles)


def _rank_keys() -> list:
    return [F.desc("points"), F.asc("joined_at"), F.asc("user_id")]


def leaderboard(profiles: DataFrame) -> DataFrame:
    """Profiles with points, ranked over the whole table (version 2)."""
    return global_row_number(_named(profiles).filter(F.col("points") > 0), _rank_keys(), "rank_position")


def leaderboard_top(profiles: DataFrame, k: int) -> DataFrame:
    """First ``k`` places only: a top-k, with no global ranking."""
    return top_rows(_named(profiles).filter(F.col("points") > 0), _rank_keys(), k, "rank_position")


def leaderboard_cache(profiles: DataFrame) -> DataFrame:
    return leaderboard(profiles).select(
        "user_id",
        F.col("name").alias("display_name"),
        F.col("points").alias("eco_points"),
        "rank_position",
    )


def transaction_summary(transactions: DataFrame, profiles: DataFrame, with_sign: bool = True) -> DataFrame:
    """Ledger rows with a display name; users without a profile keep their id."""
    names = profiles.select("user_id", F.coalesce("display_name", "email").alias("known_as"))
    columns = [
        F.col("id"),
        F.col("user_id"),
        F.coalesce("known_as", "user_id").alias("user_name"),
        F.col("points"),
        F.col("type"),
        F.col("waste_category"),
        F.col("timestamp"),
        F.to_date("timestamp").alias("date_only"),
    ]
    if with_sign:
        columns.append(sign_label(F.col("points")).alias("sign_display"))
    return transactions.join(names, "user_id", "left").select(*columns)


def daily_stats(transactions: DataFrame) -> DataFrame:
    """Redeemed points are reported positive; zero rows count as transactions only."""
    points = F.col("points")
    return transactions.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(F.when(points > 0, points).otherwise(0)).alias("total_points_earned"),
        F.sum(F.when(points < 0, F.abs(points)).otherwise(0)).alias("total_points_redeemed"),
        F.count_distinct("user_id").alias("unique_users"),
        count_where(F.col("type") == "waste_deposit").alias("waste_deposits"),
        count_where(F.col("type") == "redeem").alias("redemptions"),
    )


def category_totals(transactions: DataFrame, count_name: str = "count") -> DataFrame:
    return (
        transactions.filter(F.col("waste_category").isNotNull())
        .groupBy("waste_category")
        .agg(
            F.count(F.lit(1)).alias(count_name),
            F.sum("points").alias("total_points"),
            F.round(F.avg("points"), 4).alias("avg_points"),
            F.count_distinct("user_id").alias("unique_users"),
        )
    )


def category_stats(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Category names are unique, so joining after the aggregate gives the same rows."""
    values = categories.select(
        F.col("category_name").alias("waste_category"), F.col("points_value").alias("category_points_value")
    )
    return category_totals(transactions, "transaction_count").join(values, "waste_category", "left")


def points_reconcile(profiles: DataFrame, transactions: DataFrame) -> DataFrame:
    """Users whose profile disagrees with the sum of their ledger rows."""
    ledger = transactions.groupBy("user_id").agg(F.sum("points").alias("ledger_points"))
    return (
        profiles.select("user_id", F.col("eco_points").alias("profile_points"))
        .join(ledger, "user_id", "full_outer")
        .select(
            "user_id",
            "profile_points",
            "ledger_points",
            (F.coalesce("profile_points", F.lit(0)) - F.coalesce("ledger_points", F.lit(0))).alias("difference"),
        )
        .filter(F.col("difference") != 0)
    )


def waste_deposited(transactions: DataFrame) -> DataFrame:
    """Declared ``total_waste_deposited``: deposits per user."""
    return transactions.groupBy("user_id").agg(
        count_where(F.col("type") == "waste_deposit").alias("total_waste_deposited")
    )
