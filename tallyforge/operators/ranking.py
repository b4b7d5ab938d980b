"""Row numbers over a whole table without pulling it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.session import materialise

# monotonically_increasing_id() holds the partition in the high bits and the
# position inside the partition in the low 33 bits.
_POSITION_BITS = 33


def global_row_number(df: DataFrame, keys: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY keys)`` in one range shuffle.

    Rows are range-partitioned and sorted, and each row's (partition, position)
    is written out with it by a reliable checkpoint, so a lost executor cannot
    change it. One count per partition gives the offsets; that table has as many
    rows as there are partitions, hence the broadcast. ``keys`` must end in a
    unique column; equal leading keys then still spread over partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", _POSITION_BITS)
    position = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + position + 1)
        .drop("_part", "_at", "_offset")
    )


def top_rows(df: DataFrame, keys: list[Column], k: int, name: str | None = None) -> DataFrame:
    """``ORDER BY keys LIMIT k``: each task keeps its best k rows."""
    top = df.orderBy(*keys).limit(k)
    return top if name is None else top.withColumn(name, F.row_number().over(Window.orderBy(*keys)))


def steps_up_to(values: DataFrame, steps: DataFrame, span: int = 4096) -> DataFrame:
    """Running totals of ``steps`` at each integer in ``values``.

    ``values(v)`` and ``steps(v, n, best)`` hold integers with at most one row per
    ``v``. The integer range is cut into spans of fixed width, so a window holds
    at most ``2 * span`` rows; what lies before a span comes from span totals.
    Returns ``(v, n, best)`` with the count of steps at or below ``v`` and the
    ``best`` of the highest such step.
    """
    merged = values.select("v", F.lit(0).cast("long").alias("n"), F.lit(None).alias("best"), F.lit(1).alias("asked"))
    merged = merged.unionByName(steps.select("v", "n", "best", F.lit(0).alias("asked")))
    merged = merged.groupBy("v").agg(
        F.sum("n").alias("n"), F.max("best").alias("best"), F.max("asked").alias("asked")
    ).withColumn("_span", F.floor(F.col("v") / span))
    inside = Window.partitionBy("_span").orderBy("v")
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = merged.groupBy("_span").agg(
        F.sum("n").alias("_n"), F.max_by("best", F.when(F.col("best").isNotNull(), F.col("v"))).alias("_best")
    ).select(
        F.col("_span").alias("_from"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
        F.last("_best", ignorenulls=True).over(earlier).alias("_best"),
    )
    return (
        merged.withColumn("n", F.sum("n").over(inside))
        .withColumn("best", F.last("best", ignorenulls=True).over(inside))
        .filter(F.col("asked") == 1)
        .join(spans, F.col("_span").eqNullSafe(F.col("_from")))
        .select("v", (F.col("n") + F.col("_n")).alias("n"), F.coalesce("best", "_best").alias("best"))
    )
