"""Spans of text: (kind, start, end, value) in code points, end exclusive."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``base`` tells matches of the given patterns from what a trained method adds.
SPANS = "array<struct<kind: string, start: bigint, end: bigint, value: string, base: boolean>>"
_FIELDS = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_())]


def span_columns(spans: list[list[tuple[str, int, int, str, bool]]]) -> pa.Array:
    rows = [[{name: part for (name, _), part in zip(_FIELDS, span)} for span in found] for found in spans]
    return pa.array(rows, pa.list_(pa.struct(_FIELDS)))


def overlaps(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    return any(a < end and start < b for _, a, b in spans)


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_of(spans: Column, kind: str) -> Column:
    """Number of base matches of one kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )
