"""Aggregation shapes that stay cheap when one group holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def one_record(*frames: DataFrame) -> DataFrame:
    """Put one-row frames side by side without a join.

    Each frame fills its own columns; ``max`` skips the NULLs of the others.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def one_record_per(keys: list[str], *frames: DataFrame) -> DataFrame:
    """Same, per key: rollups of several fact tables that share ``keys``."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in keys])


def top_of(value: Column, weight: Column, tie: Column, descending_tie: bool = False) -> Column:
    """Arg-max of ``value`` by ``weight``; the smallest (or largest) ``tie`` wins."""
    order = F.struct(weight.alias("w"), (tie if descending_tie else -tie).alias("t"))
    return F.max_by(value, order)


def top_name(name: Column, weight: Column) -> Column:
    """Arg-max of a string by ``weight``, the alphabetically first on a tie."""
    best = F.min(F.struct((-weight).alias("w"), name.alias("n")))
    return best["n"]
