"""A leaderboard kept in buckets of points, so that a batch of changes costs the buckets it touches.

``root/members/v=N/bucket=B`` holds the users of a bucket with their place inside it, written by batch N; ``root/counts/v=N`` says
for each bucket how many users it has and which batch wrote it. A rank is the users of all higher buckets (a sum over
one row a bucket) and the place. No batch sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge.functions.labels import name_or_id
from tallyforge.sources.sinks import keep_newest, latest_version, read_version, write_version

#: Points of a bucket. There are as many buckets as the range of points has such parts.
WIDTH = 512
_MEMBER = "user_id STRING, display_name STRING, eco_points LONG, joined_at TIMESTAMP_NTZ, place LONG, bucket LONG"


def entries(profiles: DataFrame) -> DataFrame:
    name = name_or_id(F.col("display_name"), F.col("email"), F.col("user_id"))
    return profiles.select("user_id", name.alias("display_name"), F.col("eco_points").cast("long").alias("eco_points"), "joined_at")


def _write(spark: SparkSession, root: str, members: DataFrame, counts: DataFrame | None, width: int, version: int, keep: int) -> None:
    """Place users within their buckets, write these and the counts of all."""
    order = Window.partitionBy("bucket").orderBy(F.desc("eco_points"), F.asc("joined_at"), F.asc("user_id"))
    ranked = members.withColumn("bucket", F.floor(F.col("eco_points") / width)).withColumn("place", F.row_number().over(order).cast("long"))
    path = f"{root}/members/v={version}"
    ranked.write.mode("overwrite").partitionBy("bucket").parquet(path)
    written = spark.read.schema(_MEMBER).parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("members"))
    written = written.withColumn("writer", F.lit(version).cast("long"))
    write_version(written if counts is None else counts.unionByName(written), f"{root}/counts", version)
    keep_newest(spark, f"{root}/counts", keep)


def start_board(profiles: DataFrame, root: str, width: int = WIDTH) -> None:
    """Version 0: all profiles with points."""
    _write(profiles.sparkSession, root, entries(profiles).filter("eco_points > 0"), None, width, 0, 1)


def update_board(changes: DataFrame, root: str, version: int, width: int = WIDTH, keep: int = 2) -> list[int]:
    """Apply a batch: ``changes`` hold the entry of each changed user and ``old_points`` (null if new); returns the touched buckets.

    Read are the buckets that a changed user leaves or enters. Boards of the newest ``keep`` versions stay readable. A batch that is sent again rewrites its own version.
    """
    spark = changes.sparkSession
    bucket = lambda c: F.when(F.col(c) > 0, F.floor(F.col(c) / width))
    moves = changes.select(F.explode(F.array_compact(F.array(bucket("old_points"), bucket("eco_points")))).alias("bucket")).distinct()
    touched = sorted(row["bucket"] for row in moves.collect())  # one value a bucket at most
    counts = read_version(spark, f"{root}/counts", version - 1)
    stay = _members(spark, root, counts.filter(F.col("bucket").isin(touched))).drop("place", "bucket")
    stay = stay.join(changes.select("user_id"), "user_id", "left_anti")
    fresh = changes.filter("eco_points > 0").select(stay.columns)
    _write(spark, root, stay.unionByName(fresh), counts.filter(~F.col("bucket").isin(touched)), width, version, keep)
    return touched


def _members(spark: SparkSession, root: str, counts: DataFrame) -> DataFrame:
    """Users of the buckets that ``counts`` names, each from the folder of the batch that wrote it last."""
    paths = [f"{root}/members/v={row['writer']}/bucket={row['bucket']}" for row in counts.collect()]  # one row a bucket
    if not paths:
        return spark.createDataFrame([], _MEMBER)
    reader = spark.read.schema(f"{_MEMBER}, v LONG").option("basePath", f"{root}/members")
    return reader.parquet(*paths).drop("v")


def read_board(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """user_id, display_name, eco_points and rank_position as of a version that is kept."""
    version = latest_version(spark, f"{root}/counts") if version is None else version
    counts = read_version(spark, f"{root}/counts", version)
    sums = counts.groupBy("bucket").agg(F.sum("members").alias("members"))
    higher = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("bucket", F.coalesce(F.sum("members").over(higher), F.lit(0)).alias("_before"))
    # one row a bucket: bounded by the range of points
    ranked = _members(spark, root, counts).join(F.broadcast(before), "bucket")
    return ranked.select("user_id", "display_name", "eco_points", (F.col("_before") + F.col("place")).alias("rank_position"))
