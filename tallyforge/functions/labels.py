"""Fallbacks, status classes and display labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def name_or_id(display_name: Column, email: Column, user_id: Column) -> Column:
    return F.coalesce(display_name, email, user_id)


def truthy_or(value: Column, fallback: Column) -> Column:
    """Fall back on NULL, on the empty string and on ``'0'``."""
    return F.when(value.isNotNull() & ~value.isin("", "0"), value).otherwise(fallback)


def sign_label(points: Column) -> Column:
    return F.when(points >= 0, F.lit("+")).otherwise(F.lit(""))


def http_success(status: Column) -> Column:
    return (status >= 200) & (status < 300)


def http_error(status: Column) -> Column:
    return status >= 400


def resolved_label(flag: Column) -> Column:
    """NULL counts as pending on screen, although no counter includes it."""
    return F.when(flag, F.lit("Resolved")).otherwise(F.lit("Pending"))


def rate_band(rate: Column) -> Column:
    return F.when(rate > 90, F.lit("green")).when(rate > 70, F.lit("yellow")).otherwise(F.lit("red"))


def percentage(part: Column, whole: Column, scale: int = 4) -> Column:
    """``part / whole * 100``; NULL when the denominator is zero."""
    return F.round(F.try_divide(part, whole) * 100, scale)


def percentage_or_zero(part: Column, whole: Column, scale: int = 2) -> Column:
    return F.when(whole > 0, F.round(F.try_divide(part, whole) * 100, scale)).otherwise(F.lit(0.0))


def mean_of(total: Column, n: Column, scale: int = 4) -> Column:
    """Mean from an additive pair, at the scale integer averages are reported with."""
    return F.round(F.try_divide(total, n), scale)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def all_of(conditions: list[Column]) -> Column:
    """AND of the supplied filters; no filter at all keeps every row."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def case_blind(column: Column) -> Column:
    """Opt-in case- and accent-insensitive key for joins and grouping."""
    return F.collate(column, "UNICODE_CI_AI")
