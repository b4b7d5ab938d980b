"""Update rules whose batches commute: any split of a feed, in any order, gives the state of one sorted batch.

A state has one row a key and one register a field. A register only ever adds up, or keeps the greatest or the least of
what it saw: counters are sums, "the last value given" is the greatest (time, id, value), "the first event" the least one.
Such registers merge by their own rule, so a client that was offline and sends late changes nothing that a later
event has set. What a state means for a table is decided when it is read, in the ``*_view`` functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.labels import http_error, http_success
from tallyforge.operators.folds import USER_FIELDS, merge_points, merge_users

#: How a register takes in events, and how it takes in other states.
REDUCE = {
    "sum": (F.sum, F.sum),
    "max": (F.max, F.max),
    "min": (F.min, F.min),
    "bits": (F.bitmap_construct_agg, F.bitmap_or_agg),
    "sketch": (F.hll_sketch_agg, F.hll_union_agg),
}


class Registers(NamedTuple):
    """``keys`` and ``fields`` are functions since columns need a session; a field is (name in REDUCE, expression)."""

    keys: Callable[[], dict[str, Column]]
    fields: Callable[[], dict[str, tuple[str, Column]]]
    where: Callable[[], Column] = lambda: F.lit(True)


def latest(column: str, ts: str, event_id: str = "id") -> tuple[str, Column]:
    """The value of the latest event that carries one; events without a time come before all others, equal events
    are told apart by their value."""
    value = F.col(column)
    return "max", F.when(value.isNotNull(), F.struct(F.col(ts).alias("at"), F.col(event_id).alias("id"), value.alias("value")))


def earliest(ts: str, event_id: str, **kept: Column) -> tuple[str, Column]:
    """What the first event held; events without a time come after all others."""
    order = (F.col(ts).isNull().alias("untimed"), F.col(ts).alias("at"), F.col(event_id).alias("id"))
    return "min", F.struct(*order, *(column.alias(name) for name, column in kept.items()))


def state_of(feed: DataFrame, rule: Registers) -> DataFrame:
    """The state of one batch; a hot key's events are combined before the shuffle."""
    keys = [column.alias(name) for name, column in rule.keys().items()]
    fields = [REDUCE[kind][0](column).alias(name) for name, (kind, column) in rule.fields().items()]
    return feed.filter(rule.where()).groupBy(*keys).agg(*fields)


def combine(states: DataFrame, rule: Registers) -> DataFrame:
    """Several states, stacked, as one."""
    fields = [REDUCE[kind][1](name).alias(name) for name, (kind, _) in rule.fields().items()]
    return states.groupBy(*rule.keys()).agg(*fields)


def folded(states: list[DataFrame], rule: Registers) -> DataFrame:
    return combine(reduce(DataFrame.unionByName, states), rule)


def _one() -> Column:
    return F.lit(1).cast("long")


POINTS = Registers(
    keys=lambda: {"user_id": F.col("user_id")},
    fields=lambda: {
        "eco_points": ("sum", F.col("points_delta").cast("long")),
        "display_name": latest("display_name", "event_time"),
        "email": latest("email", "event_time"),
        "joined_at": ("min", F.col("event_time")),
    },
)


def points_view(profiles: DataFrame, state: DataFrame) -> DataFrame:
    """The profiles with a state of the points feed: points added, name and email as last given, new users created."""
    batch = state.select(
        "user_id", "eco_points", F.col("display_name.value").alias("display_name"), F.col("email.value").alias("email"), "joined_at"
    )
    return merge_points(profiles, batch)


FEATURES = Registers(
    keys=lambda: {"admin_id": F.col("admin_id"), "feature_name": F.col("target_resource")},
    fields=lambda: {
        "usage_count": ("sum", _one()),
        "last_used_at": ("max", F.col("created_at")),
        "spent": ("sum", F.coalesce("execution_time_ms", F.lit(0)).cast("long")),
        "success_count": ("sum", F.coalesce(http_success(F.col("response_status")), F.lit(False)).cast("long")),
        "error_count": ("sum", F.coalesce(http_error(F.col("response_status")), F.lit(False)).cast("long")),
        "first": earliest(
            "created_at", "id", spent=F.coalesce("execution_time_ms", F.lit(0)).cast("long"), category=F.col("activity_category")
        ),
    },
    where=lambda: F.col("target_resource").isNotNull(),
)


def features_view(state: DataFrame) -> DataFrame:
    """Feature usage: the first event of all, whenever it came, sets the category and is not timed."""
    return state.select(
        "admin_id",
        "feature_name",
        F.col("first.category").alias("feature_category"),
        "usage_count",
        "last_used_at",
        (F.col("spent") - F.col("first.spent")).alias("total_time_spent"),
        "success_count",
        "error_count",
    )


USERS = Registers(
    keys=lambda: {"user_id": F.col("user_id")},
    fields=lambda: {
        **{field: latest(field, "event_time") for field in USER_FIELDS},
        "_events": ("sum", _one()),
        "_last": ("max", F.col("event_time")),
    },
)


def users_view(users: DataFrame, state: DataFrame) -> DataFrame:
    values = [F.col(f"{field}.value").alias(field) for field in USER_FIELDS]
    return merge_users(users, state.select("user_id", *values, "_events", "_last"))


# ---- distinct users ---------------------------------------------------------
#: A sketch of 2**12 registers: three standard errors are under this share of the count.
SKETCH_BOUND = 0.05

DAY_USERS = Registers(
    keys=lambda: {"date": F.to_date("timestamp"), "bucket": F.bitmap_bucket_number(F.col("user_id").cast("long"))},
    fields=lambda: {"users": ("bits", F.bitmap_bit_position(F.col("user_id").cast("long")))},
    where=lambda: F.col("user_id").try_cast("long").isNotNull(),
)
DAY_SKETCHES = Registers(keys=lambda: {"date": F.to_date("timestamp")}, fields=lambda: {"users": ("sketch", F.col("user_id"))})


def _spread(days: DataFrame, span: int) -> DataFrame:
    """Each day's rows for every day whose last ``span`` days hold it; only days that have rows ask."""
    later = F.explode(F.sequence("date", F.date_add("date", span - 1))).alias("_until")
    asked = days.select(F.col("date").alias("_until")).distinct()
    return days.select(later, *[c for c in days.columns if c != "date"]).join(asked, "_until", "left_semi")


def rolling_users(days: DataFrame, span: int) -> DataFrame:
    """(date, users): different users of the ``span`` days up to each day, from the bitmaps of ``DAY_USERS``. Exact.

    A row is the bitmap of 32,768 neighbouring ids on a day, so a day costs the ids in use, not its events.
    """
    held = _spread(days, span).groupBy("_until", "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return held.groupBy(F.col("_until").alias("date")).agg(F.sum(F.bitmap_count("users")).alias("users"))


def rolling_estimates(days: DataFrame, span: int) -> DataFrame:
    """(date, users) from the sketches of ``DAY_SKETCHES``: within ``SKETCH_BOUND`` of the count, whatever an id is."""
    held = _spread(days, span).groupBy(F.col("_until").alias("date")).agg(F.hll_union_agg("users").alias("users"))
    return held.select("date", F.hll_sketch_estimate("users").alias("users"))
