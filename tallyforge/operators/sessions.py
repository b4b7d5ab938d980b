"""Time-based grouping: concurrency, activity sessions, visits, double events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MICROS = 1_000_000


def _epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _at_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def peak_concurrency(sessions: DataFrame) -> DataFrame:
    """Most sessions open at once, for every day from the first login or logout to the last.

    Within a second logins come before logouts, so a session counts in the second it opens even
    if it closes in it. Logins and logouts are netted per second first, so the running sum of a day
    covers at most 86,400 rows however many sessions fall on it. The level a day
    starts with is the sum of all earlier days (one row per day).
    """
    edges = F.array(
        F.struct(F.col("login_time").alias("ts"), F.lit(1).alias("step")),
        F.struct(F.col("logout_time").alias("ts"), F.lit(-1).alias("step")),
    )
    seconds = (
        sessions.select(F.inline(edges))
        .filter(F.col("ts").isNotNull())
        .groupBy(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("second"))
        .agg(F.sum("step").alias("step"), F.count_if(F.col("step") > 0).alias("opened"))
        .withColumn("date", F.to_date("second"))
    )
    running = F.sum("step").over(Window.partitionBy("date").orderBy("second"))
    daily = (
        seconds.withColumn("level", running - F.col("step") + F.col("opened"))
        .groupBy("date")
        .agg(F.sum("step").alias("net"), F.max("level").alias("top"))
    )
    span = daily.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = span.select(F.explode(F.sequence("first", "last")).alias("date"))
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum("net").over(earlier), F.lit(0))
    return days.join(daily, "date", "left").select(
        "date", (carried + F.greatest(F.coalesce("top", F.lit(0)), F.lit(0))).alias("peak_concurrent_users")
    )


def sessionize(
    events: DataFrame, key: str, ts: str, gap_seconds: int = 600, max_seconds: int = 86400
) -> DataFrame:
    """Group a key's events into sessions with pauses of at most ``gap_seconds``.

    A session longer than ``max_seconds`` is cut at multiples of that length from
    its start. Events are first reduced to slots one gap wide: two events in a
    slot are always in the same session, so the ordered pass per key covers at
    most (time span / gap) rows instead of all its events. Only slots that a cut
    passes through go back to their events.
    """
    gap, longest = gap_seconds * MICROS, max_seconds * MICROS
    timed = events.select(F.col(key), _epoch_micros(F.col(ts)).alias("_t"))
    slotted = timed.withColumn("_slot", F.col("_t") - F.pmod("_t", F.lit(gap)))
    slots = slotted.groupBy(key, "_slot").agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    in_order = Window.partitionBy(key).orderBy("_slot")
    pause = F.col("_lo") - F.lag("_hi").over(in_order)
    opens = F.when(pause.isNull() | (pause > gap), F.col("_lo"))
    started = slots.withColumn("_opens", opens).withColumn(
        "_start", F.last("_opens", ignorenulls=True).over(in_order)
    )

    def piece(t: Column) -> Column:
        since = t - F.col("_start")
        return since - F.pmod(since, F.lit(longest))

    cut = (F.col("_n") > 1) & (piece(F.col("_lo")) != piece(F.col("_hi")))
    whole = started.filter(~cut).select(key, "_start", piece(F.col("_lo")).alias("_piece"), "_lo", "_hi", "_n")
    # null-safe equality adds no filters, so both uses of the slots share one shuffle
    at_cut = started.filter(cut).select(F.col(key).alias("_key"), F.col("_slot").alias("_cut"), "_start")
    apart = slotted.join(
        at_cut, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slot").eqNullSafe(F.col("_cut"))
    ).select(
        key,
        "_start",
        piece(F.col("_t")).alias("_piece"),
        F.col("_t").alias("_lo"),
        F.col("_t").alias("_hi"),
        F.lit(1).cast("long").alias("_n"),
    )
    return (
        whole.unionByName(apart)
        .groupBy(key, "_start", "_piece")
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_n").alias("event_count"))
        .select(
            key,
            _at_micros(F.col("_lo")).alias("session_start"),
            _at_micros(F.col("_hi")).alias("session_end"),
            F.floor((F.col("_hi") - F.col("_lo")) / MICROS).alias("session_seconds"),
            "event_count",
        )
    )


def visit_rows(visits: DataFrame) -> DataFrame:
    """The two rows the client sends per visit: zero seconds on entry, then the stay."""
    stays = F.array(F.lit(0), F.col("visit_duration"))
    return visits.select(
        F.col("id").alias("visit_id"), "admin_id", "page_name", "page_url", F.explode(stays).alias("visit_duration")
    )


def page_visits(rows: DataFrame) -> DataFrame:
    """Per page, every row counted: a visit counts twice and halves the mean."""
    return rows.groupBy("page_name", "page_url").agg(
        F.count(F.lit(1)).alias("visits"),
        F.sum("visit_duration").alias("total_seconds"),
        F.round(F.avg("visit_duration"), 4).alias("avg_seconds"),
    )


def page_visits_corrected(rows: DataFrame) -> DataFrame:
    """Per page, the two rows of a visit folded into one."""
    folded = rows.groupBy("visit_id", "admin_id", "page_name", "page_url").agg(
        F.max("visit_duration").alias("visit_duration")
    )
    return page_visits(folded)


_FIRED = ["admin_id", "activity_type", "target_resource"]


def drop_double_fire(log: DataFrame) -> DataFrame:
    """Keep the first row, by id, of events two listeners recorded in the same second.

    The seconds are those of the clock: a pair on both sides of a full second stays. Where that
    matters use :func:`drop_close_fire`.
    """
    second = F.date_trunc("second", "created_at").cast("timestamp_ntz")
    first = F.row_number().over(Window.partitionBy(*_FIRED, "_second").orderBy("id"))
    return log.withColumn("_second", second).withColumn("_n", first).filter("_n = 1").drop("_second", "_n")


def drop_close_fire(log: DataFrame, within_micros: int = MICROS) -> DataFrame:
    """Keep a row only if no row of its kind came at most ``within_micros`` before it.

    Rows are first reduced to slots of that width, of which only the first row can stay, so the
    ordered pass over a kind covers one row a slot.
    """
    at = _epoch_micros(F.col("created_at"))
    slot = Window.partitionBy(*_FIRED, "_slot")
    before = F.lag("_last").over(Window.partitionBy(*_FIRED).orderBy("_slot"))
    return (
        log.withColumn("_at", at)
        .withColumn("_slot", F.col("_at") - F.pmod(F.col("_at"), F.lit(within_micros)))
        .withColumn("_n", F.row_number().over(slot.orderBy("_at", "id")))
        .withColumn("_last", F.max("_at").over(slot))
        .filter("_n = 1")
        .withColumn("_before", before)
        .filter(F.col("_before").isNull() | (F.col("_at") - F.col("_before") > within_micros))
        .select(log.columns)
    )
