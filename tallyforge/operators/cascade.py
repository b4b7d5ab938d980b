"""Deletes along declared references, through as many tables as they lead."""

from __future__ import annotations

from collections.abc import Iterable
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, functions as F

from tallyforge.sources.schemas import FOREIGN_KEYS

Reference = tuple[str, str, str, str, str]


def _usable(tables: dict[str, DataFrame], references: Iterable[Reference]) -> list[Reference]:
    return [
        r for r in references if r[0] in tables and r[2] in tables and r[1] in tables[r[0]].columns and r[3] in tables[r[2]].columns
    ]


def delete_graph(
    tables: dict[str, DataFrame], deleted: dict[str, DataFrame], references: Iterable[Reference] = tuple(FOREIGN_KEYS)
) -> dict[str, DataFrame]:
    """All tables after rows of some are deleted.

    ``deleted`` holds, for a table, the rows to delete by a key column (a frame with that one column). Parents come before their children: a
    child row goes if any ``cascade`` reference of it leads to a deleted row, and is then itself a deleted parent; otherwise its
    ``set null`` references to deleted rows are cleared. A null reference leads nowhere. Each table is joined
    once with the deleted keys of each of its references. References that close a circle are an error.
    """
    usable = _usable(tables, references)
    try:
        order = list(TopologicalSorter({t: {r[2] for r in usable if r[0] == t} for t in tables}).static_order())
    except CycleError as error:
        raise ValueError(f"references close a circle: {error.args[1]}") from None
    left: dict[str, DataFrame] = {}
    gone: dict[str, DataFrame | None] = {}
    for name in order:
        rows, marks, cleared = tables[name], [], {}
        if name in deleted:
            (key,) = deleted[name].columns
            rows = _marked(rows, key, deleted[name], key, "_gone")
            marks.append("_gone")
        for number, (_, column, parent, parent_column, action) in enumerate(r for r in usable if r[0] == name):
            if gone[parent] is None:
                continue
            mark = f"_gone{number}"
            rows = _marked(rows, column, gone[parent], parent_column, mark)
            if action == "cascade":
                marks.append(mark)
            else:
                cleared.setdefault(column, []).append(mark)
        columns = tables[name].columns
        falls = F.lit(False)
        for mark in marks:
            falls = falls | F.col(mark).isNotNull()
        gone[name] = rows.filter(falls).select(columns) if marks else None
        values = []
        for column in columns:
            value = F.col(column)
            for mark in cleared.get(column, []):
                value = F.when(F.col(mark).isNull(), value)
            values.append(value.alias(column))
        left[name] = rows.filter(~falls).select(values)
    return {name: left[name] for name in tables}


def _marked(rows: DataFrame, column: str, gone: DataFrame, key: str, mark: str) -> DataFrame:
    keys = gone.select(F.col(key).alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    return rows.join(keys.withColumn(mark, F.lit(1)), F.col(column) == F.col("_key"), "left").drop("_key")
