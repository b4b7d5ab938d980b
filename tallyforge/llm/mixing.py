"""Mix sources to target weights by systematic sampling, in DataFrame operations only.

A source's documents stand in a row; each is expected ``target / source size`` times, so
their prefix sum is that rate times the position. One random offset a source is added and
a document is emitted once for each integer that its step of the prefix sum crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
CAP = 3
#: Positions are counted within a source in slots of (size class, one of SPLITS), so that
#: a hot source spreads over many tasks and only one row a slot meets in its window.
SPLITS = 64
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def _slotted(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.col("size")
    octave = F.length(F.bin(size)) - 1
    return (
        docs.drop(*ADDED)
        .withColumn("size", word_count(F.col(text_col)))
        .withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~")))
        .withColumn(
            "_class", F.when(size == 0, -1).otherwise(octave * 16 + F.expr("shiftright(size * 16, length(bin(size)) - 1)") - 16)
        )
        .withColumn("_split", _hex(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 4) % SPLITS)
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``target`` for each (_key, source_size): weighted shares of the total, none above ``cap`` times its size.

    Sources stand in the order of what stops them, ``cap * size / weight``. With all before
    one stopped, the rest of the total over the rest of the weights is its level; it is
    stopped if its own level is not above. The first that isn't stopped sets the level of all others.
    """
    by_name = Window.orderBy("_key")
    by_stop = Window.orderBy(F.lit(cap) * F.col("source_size") / F.col("_weight"), "_key")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    limit = F.lit(cap) * F.col("source_size")
    return (
        sizes.withColumn("_weight", weight)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_before", F.coalesce(F.sum(limit).over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_left", F.sum("_weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_left"))
        .withColumn("_stopped", limit <= F.col("_level") * F.col("_weight"))
        .withColumn("_shared", F.max(F.when(~F.col("_stopped"), F.col("_level"))).over(everything))
        .withColumn("target", F.when(F.col("_stopped"), limit.cast("double")).otherwise(F.col("_shared") * F.col("_weight")))
        .select("_key", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (columns so named are replaced).

    Each row counts, repeated ones too. Null text has size 0, null source is a source of its
    own and the last. Within a source rows stand by size class, then a hash of the id, id and
    text, which keeps the words taken within about one document of the target. Copies of a
    row never exceed ``cap``; a source of size 0 has target 0 and takes nothing. Reruns agree:
    the offset is a hash of ``seed`` and the source.
    """
    rows = _slotted(docs, id_col, text_col, source_col)
    slots = rows.groupBy("_key", "_class", "_split").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size"))
    before = Window.partitionBy("_key").orderBy("_class", "_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select("_key", "_class", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    targets = source_targets(slots.groupBy("_key").agg(F.sum("_size").alias("source_size")), weights, cap)
    offset = _hex(F.concat(F.lit(seed), F.col("_key")), 5) / F.lit(1 << 20)
    place = F.row_number().over(
        Window.partitionBy("_key", "_class", "_split").orderBy(F.col(id_col), F.xxhash64(F.col(text_col)))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        rows.withColumn("_place", place)
        .join(starts.join(targets, "_key"), ["_key", "_class", "_split"])
        .withColumn("_at", F.col("_start") + F.col("_place"))
        .withColumn("_rate", rate)
        .withColumn("_offset", offset)
        .withColumn(
            "copies",
            F.least(
                F.lit(cap).cast("long"),
                F.floor(F.col("_offset") + F.col("_rate") * F.col("_at"))
                - F.floor(F.col("_offset") + F.col("_rate") * (F.col("_at") - 1)),
            ),
        )
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_key", "_class", "_split", "_place", "_start", "_at", "_rate", "_offset")
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row for each copy that :func:`mix_sources` takes."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
