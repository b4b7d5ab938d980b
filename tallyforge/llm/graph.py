"""Connected components of large edge lists, a few joins a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import scratch_path


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: later steps read it and don't compute it again."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): each node of ``edges`` with the smallest node it is linked to, itself included.

    Large star and small star in turn: every node hands its larger neighbours, then its
    smaller ones, to the smallest neighbour, until the edges stay the same. A node with very many
    neighbours only meets them as rows of a grouped minimum and of a join, never as one list.
    """
    links = written(_directed(edges.select(F.col(left).alias("u"), F.col(right).alias("v"))), "links")
    before = None
    while True:
        links = written(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            break
        before = now
    # each node is left with one edge, to the smallest of its component
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller end."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    links = _directed(links)
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _directed(moved.union(least.select("u", "m")))
