"""Identifiers derived from the event itself, so a retried task repeats them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def session_token(login_time: Column, admin_id: Column, *key: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("date").cast("timestamp_ntz"), login_time)
    return F.concat(
        F.lit("sess_"),
        seconds.cast("string"),
        F.lit("_"),
        admin_id.cast("string"),
        F.lit("_"),
        F.substring(stable_id(*key), 1, 16),
    )
