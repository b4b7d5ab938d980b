"""Repeated byte strings across a corpus, found by bounded interval expansion on block transforms.

Equal strings of ``LENGTH`` bytes have the same least K-byte hash at the same place. So each string goes
to its anchor, the place of that hash; the strings of neighbouring places with one anchor form a piece of up
to 2 * LENGTH - K bytes, and equal strings only ever meet under one anchor hash. Pieces whose anchor
occurs once are dropped at once, equal pieces are one, and where the pieces of an anchor differ their texts
come together in blocks: a block's Burrows-Wheeler transform tells which strings of ``LENGTH`` bytes recur.
An anchor with very many different pieces is split by the place of the anchor in the string until
its pieces are few or equal, so no block grows with the number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bwt import repeated_runs
from tallyforge.llm.graph import written
from tallyforge.llm.textbatch import SLICE_BYTES, mix, prefix_sums, slices, span_hash

LENGTH = 400
K = 48
#: Bytes of texts that one transform holds, and different pieces that an anchor may bring to it.
BLOCK_BYTES = 1 << 20
CROWD = 1_000
TASK_BLOCKS = 4

_SPANS = "array<struct<start: long, end: long>>"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, piece hash, first start, last start, anchor place) of the pieces of each row.

    The least hash of a string's k-byte parts is its anchor, the first of equal ones.
    """
    none = np.zeros(0, np.int64)
    size = len(data)
    if size < length:
        return (none, none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    sums = prefix_sums(data)
    at = np.arange(size - k + 1)
    hashes = span_hash(sums, at, at + k)
    width = length - k + 1
    blocks = -(-len(hashes) // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(hashes)] = hashes
    grid = grid.reshape(blocks, width)
    index = np.arange(blocks * width).reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1)
    news = np.ones(grid.shape, bool)
    news[:, 1:] = left[:, 1:] < left[:, :-1]
    left_at = np.maximum.accumulate(np.where(news, index, -1), axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    right_at = np.minimum.accumulate(np.where(grid == right, index, index.size)[:, ::-1], axis=1)[:, ::-1].ravel()
    left, right = left.ravel(), right.ravel()
    starts = []
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if end - begin >= length:
            starts.append((row, begin, end - length + 1))
    if not starts:
        return (none, none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    begin = np.concatenate([np.arange(a, b) for _, a, b in starts])
    row = np.repeat([r for r, _, _ in starts], [b - a for _, a, b in starts])
    far = begin + width - 1
    anchor = np.where(right[begin] <= left[far], right_at[begin], left_at[far])
    new = np.ones(len(begin), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    a, b, place = begin[first], begin[last], anchor[first]
    own = offsets[row[first]]
    piece = span_hash(sums, a, b + length) ^ mix((place - a).astype(np.uint64))
    return row[first], mix(hashes[place]), piece, a - own, b - own, place - own


def anchors_by_part(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, part: int = 2 * SLICE_BYTES) -> tuple[np.ndarray, ...]:
    """:func:`anchors`; one text of more than ``part`` bytes is read part by part, each string in one of them.

    A piece that a part's edge cuts is two pieces of the same anchor.
    """
    if len(data) <= part:
        return anchors(data, offsets, length)
    found = []
    for begin in range(0, len(data) - length + 1, part):
        some = data[begin : begin + part + length - 1]
        row, anchor, piece, a, b, place = anchors(some, np.array([0, len(some)]), length)
        found.append((row, anchor, piece, a + begin, b + begin, place + begin))
    return tuple(np.concatenate(columns) for columns in zip(*found))


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for start, end in zip(starts[order].tolist(), ends[order].tolist()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_PIECES = "array<struct<anchor: long, piece: long, a: long, b: long, place: long, again: boolean>>"


def _first_pass(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text")):
                row, anchor, piece, a, b, place = anchors_by_part(data, offsets, length)
                anchor, piece = anchor.view(np.int64), piece.view(np.int64)
                order = np.lexsort((a, piece, anchor, row))
                same = np.zeros(len(order), bool)
                if len(order):
                    x, y = order[1:], order[:-1]
                    same[1:] = (row[x] == row[y]) & (anchor[x] == anchor[y]) & (piece[x] == piece[y])
                bounds = np.searchsorted(row[order], np.arange(end - first + 1))
                pieces, covered, shas = [], [], []
                for r in range(end - first):
                    mine = order[bounds[r] : bounds[r + 1]]
                    repeat = same[bounds[r] : bounds[r + 1]]
                    many = repeat | np.append(repeat[1:], False) if len(mine) else repeat
                    keep = mine[~repeat]
                    pieces.append([
                        {"anchor": h, "piece": p, "a": s, "b": e, "place": at, "again": g}
                        for h, p, s, e, at, g in zip(
                            anchor[keep].tolist(), piece[keep].tolist(), a[keep].tolist(), b[keep].tolist(),
                            place[keep].tolist(), many[~repeat].tolist(),
                        )
                    ])
                    again = mine[many]
                    covered.append([{"start": s, "end": e} for s, e in _merge(a[again], b[again] + length)])
                    shas.append(hashlib.sha256(data[offsets[r] : offsets[r + 1]]).digest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, end - first),
                        batch.column("key").slice(first, end - first),
                        pa.array(np.diff(offsets)),
                        pa.array(shas, pa.binary()),
                        pa.array(pieces, pa.list_(pa.struct([*((n, pa.int64()) for n in ("anchor", "piece", "a", "b", "place")), ("again", pa.bool_())]))),
                        pa.array(covered, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    ["id", "key", "n_bytes", "sha", "pieces", "covered"],
                )

    return scan


def _cut(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                data = (text or "").encode()
                for w in wanted:
                    out.append((w["anchor"], w["piece"], w["again"], w["place"] - w["a"], data[w["a"] : w["b"] + length]))
                    held += len(out[-1][-1])
                    if held > 4 * BLOCK_BYTES:
                        yield _texts(out)
                        out, held = [], 0
            yield _texts(out)

    return scan


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)],
        ["anchor", "piece", "again", "place", "bytes"],
    )


def _expand(length: int):
    """Runs of each piece, from blocks of whole anchors in the order of the partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bool, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            runs = repeated_runs([row[3] for row in held], length)
            spans = [
                [(0, len(text))] if again else found for (_, _, again, text), found in zip(held, runs)
            ]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([row[0] for row in held], pa.int64()),
                    pa.array([row[1] for row in held], pa.int64()),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in found] for found in spans],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                ],
                ["anchor", "piece", "runs"],
            )

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("anchor", "piece", "again", "bytes")]
            for row in zip(*columns):
                if size > BLOCK_BYTES and held[-1][0] != row[0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    return scan


def _split(length: int):
    """Each crowded piece as two, by the place of the anchor in the string; both know the piece they come from."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor", "piece", "low", "high", "place", "bytes")
        for batch in batches:
            out = []
            for anchor, piece, low, high, place, text in zip(*(batch.column(n).to_pylist() for n in names)):
                middle = (low + high) // 2
                for near, far in ((low, middle), (middle + 1, high)):
                    # strings whose anchor is near..far bytes after their start, as far as the piece has them
                    first, last = max(0, place - far), min(len(text) - length, place - near)
                    if first > last:
                        continue
                    core = text[place - near : place - far + length]
                    part = text[first : last + length]
                    digest = hashlib.sha256(core + bytes([near & 255, near >> 8, far & 255, far >> 8])).digest()
                    own = hashlib.sha256(part + (place - first).to_bytes(4, "little")).digest()
                    out.append((
                        anchor, piece, first, int.from_bytes(digest[:8], "little", signed=True),
                        int.from_bytes(own[:8], "little", signed=True), near, far, place - first, part,
                    ))
            kinds = [pa.int64()] * 8 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)],
                ["from_anchor", "from_piece", "shift", "anchor", "piece", "low", "high", "place", "bytes"],
            )

    return scan


def _runs_of(texts: DataFrame, length: int, crowd: int) -> DataFrame:
    """(anchor, piece, runs) of different pieces; anchors with more than ``crowd`` of them are split and split again."""
    keys = ["anchor", "piece"]
    texts = texts.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(length - K).cast("long"))
    quiet = None
    chains = []
    level = texts
    while True:
        sizes = level.groupBy("anchor").agg(F.count("*").alias("held"), F.min("low").alias("l"), F.max("high").alias("h"))
        crowded = sizes.filter((F.col("held") > crowd) & (F.col("l") < F.col("h"))).select("anchor")
        calm = level.join(crowded, "anchor", "left_anti").select("anchor", "piece", "again", "bytes")
        quiet = calm if quiet is None else quiet.union(calm)
        loud = level.join(crowded, "anchor", "left_semi")
        if loud.isEmpty():
            break
        parts = written(
            loud.mapInArrow(
                _split(length),
                "from_anchor long, from_piece long, shift long, anchor long, piece long, low long, high long, place long, bytes binary",
            ),
            "split-pieces",
        )
        again = loud.select(F.col("anchor").alias("from_anchor"), F.col("piece").alias("from_piece"), "again")
        merged = (
            parts.join(again, ["from_anchor", "from_piece"])
            .groupBy("anchor", "piece")
            .agg(
                ((F.count("*") > 1) | F.max("again")).alias("again"),
                F.min("low").alias("low"), F.min("high").alias("high"), F.min("place").alias("place"), F.min("bytes").alias("bytes"),
            )
        )
        # an anchor left with one piece is done: that piece recurs or it doesn't
        level = written(merged, "split-level")
        chains.append(parts.select("from_anchor", "from_piece", "shift", *keys))
    # the work follows the bytes: a task gets TASK_BLOCKS blocks, however many there are
    size = quiet.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    tasks = int(size // (TASK_BLOCKS * BLOCK_BYTES)) + 1
    quiet = quiet.repartition(tasks, "anchor").sortWithinPartitions("anchor", "piece")
    runs = quiet.mapInArrow(_expand(length), f"anchor long, piece long, runs {_SPANS}")
    if not chains:
        return runs
    runs = written(runs, "runs")
    for chain in reversed(chains):  # runs of parts become runs of what they come from
        back = chain.join(runs, keys).select(
            F.col("from_anchor").alias("anchor"),
            F.col("from_piece").alias("piece"),
            F.explode(F.transform("runs", lambda r: F.struct((r["start"] + F.col("shift")).alias("start"), (r["end"] + F.col("shift")).alias("end")))).alias("run"),
        )
        runs = written(
            runs.union(back.groupBy(*keys).agg(F.collect_list("run").alias("runs"))), "runs"
        )
    return runs


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and ``spans``: its byte runs covered by strings of ``length`` bytes that also start anywhere else.

    Null reads as empty; texts of fewer bytes have no spans. Rows are told apart by id and
    text: rows equal in both are copies of each other, and a row that has a copy, under any id, is
    covered whole. Spans are unmerged lists of (start, end) that :func:`without_spans` merges.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("key", F.xxhash64(F.col("id").cast("string"), "text"))
    kind = rows.schema["id"].dataType.simpleString()
    first = written(
        rows.mapInArrow(_first_pass(length), f"id {kind}, key long, n_bytes long, sha binary, pieces {_PIECES}, covered {_SPANS}"),
        "pieces",
    )
    classes = first.filter(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("copies"), F.min("key").alias("key"))
    copied = classes.filter("copies > 1")
    whole = first.filter(F.col("n_bytes") >= length).join(copied.select("sha"), "sha", "left_semi").select(
        "key", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans")
    )

    # one row of each class brings its pieces; those of a copied class recur anyway
    ours = first.join(classes, ["sha", "key"]).select("key", "copies", F.explode("pieces").alias("p"))
    pieces = ours.select(
        "key",
        F.col("p.anchor").alias("anchor"),
        F.col("p.piece").alias("piece"),
        F.col("p.a").alias("a"),
        F.col("p.b").alias("b"),
        F.col("p.place").alias("place"),
        (F.col("p.again") | (F.col("copies") > 1)).alias("again"),
        (F.col("copies") == 1).alias("open"),
    )
    met = (
        pieces.groupBy("anchor")
        .agg(F.count("*").alias("held"), F.min("piece").alias("low"), F.max("piece").alias("high"))
        .filter("held > 1")
        .select("anchor", (F.col("low") < F.col("high")).alias("mixed"))
    )
    met = written(pieces.join(met, "anchor"), "met-pieces")
    span = F.struct(F.col("a").alias("start"), (F.col("b") + length).alias("end")).alias("span")
    plain = met.filter("NOT mixed AND open").select("key", span)

    mixed = met.filter("mixed")
    holders = mixed.groupBy("anchor", "piece").agg(
        ((F.count("*") > 1) | F.max("again")).alias("again"), F.min(F.struct("key", "a", "b", "place")).alias("at")
    )
    wanted = holders.groupBy(F.col("at.key").alias("key")).agg(
        F.collect_list(F.struct("anchor", "piece", "again", F.col("at.a").alias("a"), F.col("at.b").alias("b"), F.col("at.place").alias("place"))).alias("wanted")
    )
    texts = rows.select("key", "text").join(wanted, "key").select("text", "wanted").mapInArrow(
        _cut(length), "anchor long, piece long, again boolean, place long, bytes binary"
    ).dropDuplicates(["anchor", "piece"])
    runs = _runs_of(written(texts, "piece-texts"), length, crowd)
    found = (
        mixed.filter("open")
        .join(runs, ["anchor", "piece"])
        .select("key", "a", F.explode("runs").alias("r"))
        .select("key", F.struct((F.col("a") + F.col("r.start")).alias("start"), (F.col("a") + F.col("r.end")).alias("end")).alias("span"))
    )
    own = first.filter(F.size("covered") > 0).select("key", F.col("covered").alias("spans"))
    spans = (
        plain.union(found).groupBy("key").agg(F.collect_list("span").alias("spans"))
        .union(own).union(whole)
        .groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    return rows.join(spans, "key", "left").select(F.col("id").alias(id_col), F.col("text").alias(text_col), "spans")


def without_spans(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the bytes that are left, joined) and ``removed`` (merged spans)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data, done, kept = text.encode(), 0, []
                merged = _merge(np.array([s["start"] for s in spans or []], np.int64), np.array([s["end"] for s in spans or []], np.int64))
                for start, end in merged:
                    kept.append(data[done:start])
                    done = end
                kept.append(data[done:])
                rows.append((len(data), sum(e - s for s, e in merged), len(merged), b"".join(kept), [{"start": s, "end": e} for s, e in merged]))
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds))],
                ["id", "n_bytes", "n_removed", "n_spans", "kept", "removed"],
            )

    rows = found.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "spans")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        scan, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, removed {_SPANS}"
    ).withColumnRenamed("id", id_col)

