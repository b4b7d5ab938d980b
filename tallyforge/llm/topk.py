"""Exact top-k by inner product over a vector-approximation file.

Rows stay in their partitions. For each block of queries a task scans the quantised cells of
its rows for upper and lower bounds of every score, then reads exact vectors in the order of the
bound until no further bound can reach the k-th score so far. The best k of each task meet at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.graph import written

#: Cells in each dimension: one byte a component.
CELLS = 32
#: Queries a pass holds on every executor, rows whose cells a task scans at once, and queries whose
#: bounds with these rows it holds (two tables of 16 MB).
QUERY_BLOCK = 4096
ROW_BLOCK = 8192
QUERY_TILE = 256
SCALE = 256.0


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): components as floor(256 * x); vectors null, empty or with a null or non-finite component fall out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
        .filter(F.coalesce(whole, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))
    )


class CellFile:
    """Quantised rows: for each dimension equal cells between the least and the largest component."""

    def __init__(self, rows: np.ndarray):
        low, high = rows.min(axis=0), rows.max(axis=0)
        step = np.maximum((high - low + CELLS) // CELLS, 1)
        self.cells = ((rows - low) // step).astype(np.uint8)
        self.low, self.wide = low.astype(np.float64), step.astype(np.float64)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each query's score with each row, from the cells alone."""
        exact = queries.astype(np.float64)
        middle = (exact * self.wide) @ self.cells.astype(np.float64).T + (exact @ self.low)[:, None]
        # a component lies from its cell's floor up to one less than the next
        below = (np.minimum(exact, 0) @ (self.wide - 1))[:, None]
        above = (np.maximum(exact, 0) @ (self.wide - 1))[:, None]
        slack = 1e-12 * (np.abs(exact) @ (np.abs(self.low) + CELLS * self.wide))[:, None]  # of rounding, beyond 53 bits
        return middle + (below - slack), middle + (above + slack)


def _best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def search_rows(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query the best k (score, id) of these rows, the query's own id left out."""
    file = CellFile(rows)
    out = []
    for at in range(0, len(queries), QUERY_TILE):
        out += _search_tile(file, ids, rows, query_ids[at : at + QUERY_TILE], queries[at : at + QUERY_TILE], k)
    return out


def _search_tile(file: CellFile, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    lower, upper = file.bounds(queries)
    own = query_ids[:, None] == ids[None, :]
    lower[own], upper[own] = -np.inf, -np.inf
    out = []
    for q in range(len(queries)):
        # a row whose upper bound is below the k-th lower bound cannot be among the best k
        floor = np.partition(lower[q], -k)[-k] if len(ids) > k else -np.inf
        open_rows = np.flatnonzero((upper[q] >= floor) & ~own[q])
        order = open_rows[np.argsort(-upper[q][open_rows], kind="stable")]
        found: list[tuple[int, int]] = []
        for at in range(0, len(order), 4 * k):
            if len(found) == k and found[-1][0] > upper[q][order[at]]:
                break
            part = order[at : at + 4 * k]
            scores = rows[part] @ queries[q]
            found = _best(found + list(zip(scores.tolist(), ids[part].tolist())), k)
        out.append(found)
    return out


def _scan(block, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, by_width = block.value
        best: dict[int, list[tuple[int, int]]] = {}
        held: dict[int, tuple[list, list]] = {}

        def flush(width: int) -> None:
            ids, rows = held.pop(width)
            if width in by_width:
                at, queries = by_width[width]
                found = search_rows(np.array(ids), np.concatenate(rows), query_ids[at], queries, k)
                for q, new in zip(at.tolist(), found):
                    best[q] = _best(best.get(q, []) + new, k)

        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for width in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == width)
                for at in range(0, len(mine), ROW_BLOCK):
                    some = mine[at : at + ROW_BLOCK]
                    into = held.setdefault(width, ([], []))
                    into[0].extend(ids[some].tolist())
                    into[1].append(values[starts[some][:, None] + np.arange(width)])
                    if len(into[0]) >= ROW_BLOCK:
                        flush(width)
        for width in list(held):
            flush(width)
        rows = [(int(query_ids[q]), one, score) for q, found in best.items() for score, one in found]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return scan


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products, ties to the smaller vec_id.

    A query meets all rows but those of its own id, of its own width only; with fewer rows it gets
    all. Vectors without a finite value in every component take no part on either side, rows
    repeated under one id count each. Scores are exact while they fit 64 bits. Queries are held
    ``query_block`` at a time, so many queries mean many passes, not larger tasks; what a pass finds is
    written to the shared folder and its queries leave the executors before the next.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col)
    asked = integer_vectors(queries, id_col, vector_col)
    blocks = int(asked.count() // query_block) + 1
    found = None
    for number in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).collect()
        ids = np.array([row["id"] for row in part], np.int64)
        widths = np.array([len(row["v"]) for row in part], np.int64)
        by_width = {
            width: (np.flatnonzero(widths == width), np.array([row["v"] for row in part if len(row["v"]) == width], np.int64))
            for width in set(widths.tolist())
        }
        held = spark.sparkContext.broadcast((ids, by_width))
        one = written(rows.mapInArrow(_scan(held, k), "query_id long, vec_id long, score long"), "best")
        held.unpersist()
        found = one if found is None else found.union(one)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
