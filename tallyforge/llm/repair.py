"""Conversation repair: the cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``.

Each row is a terminal; the grammar in Chomsky normal form has a symbol ``pq`` for each pair of places in that pattern
("the rows of this span lead from p to q") with rules ``pq -> pr rq``, and ``pq`` may also derive inserted turns alone.
A cell holds, for each symbol, the least (cost, audit) of a span: edits of one row for spans of one, closed under
insertions, then cells of neighbouring spans combined, short spans first. Since a symbol splits at any place, cells
of spans that different tasks hold combine as well: a long conversation is parsed in pieces by many tasks, and only one
cell a piece comes together. At equal cost no audit begins another (more letters cost more), so the least text of both
halves gives the least whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.graph import written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
RETELL, DROP, ADD, UNENDED = 2, 3, 2, 1
BLANK, TWICE, CUT, SOUND = "blank", "duplicate", "truncated", "sound"

#: Places: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, DONE = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
ROLES = {"u": "user", "a": "assistant"}
#: Pairs of initials that may stand side by side.
LEGAL = ("su", "ua", "au")
_WHITE = " \t\n\x0b\x0c\r"

Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(r, 4) if r < USER else (USER, DONE):
            found = right.get((r, q))
            if found is not None:
                both = (cost + found[0], audit + found[1])
                if (p, q) not in out or both < out[p, q]:
                    out[p, q] = both
    return out


def _closure() -> Cell:
    """Insertions alone: the shortest walk from each place to each other."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    grown = True
    while grown:
        grown = False
        for (p, r), (cost, audit) in list(cell.items()):
            for initial in ROLES:
                q = STEPS.get((r, initial))
                if q is not None and ((p, q) not in cell or (cost + ADD, audit + INSERT) < cell[p, q]):
                    cell[p, q], grown = (cost + ADD, audit + INSERT), True
    return cell


INSERTIONS = _closure()


def leaf(initial: str, fault: str) -> Cell:
    """The cell of one row."""
    cell: Cell = {(p, p): (DROP, DELETE) for p in range(4)}
    if fault not in (BLANK, TWICE):
        extra = UNENDED if fault == CUT else 0
        options = [(initial, extra, KEEP)] + [(role, extra + RETELL, REROLE) for role in ROLES]
        for role, cost, audit in options:
            for (p, by), q in STEPS.items():
                if by == role and ((p, q) not in cell or (cost, audit) < cell[p, q]):
                    cell[p, q] = (cost, audit)
    return combine(combine(INSERTIONS, cell), INSERTIONS)


class Parse:
    """Cells of consecutive spans, combined as soon as two neighbours are of one length."""

    def __init__(self):
        self.spans: list[tuple[int, Cell]] = []
        self._leaves: dict[tuple[str, str], Cell] = {}

    def add(self, initial: str, fault: str) -> None:
        if (initial, fault) not in self._leaves:
            if len(self._leaves) > 1_000:  # roles of odd initials
                self._leaves.clear()
            self._leaves[initial, fault] = leaf(initial, fault)
        self.push(1, self._leaves[initial, fault])

    def push(self, length: int, cell: Cell) -> None:
        while self.spans and self.spans[-1][0] <= length:
            size, left = self.spans.pop()
            length, cell = size + length, combine(left, cell)
        self.spans.append((length, cell))

    def take(self) -> Cell:
        """The cell of everything added; the parse is empty then."""
        cell: Cell = {(p, p): (0, "") for p in range(4)}
        while self.spans:
            cell = combine(self.spans.pop()[1], cell)
        return cell


def whole(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of a conversation that may be empty."""
    return min(cell[goal] for goal in ((START, START), (START, DONE)) if goal in cell)


# --- rows


def _key(column: Column) -> Column:
    return F.struct(column.isNotNull().alias("given"), column.alias("value"))


def _faults(turns: DataFrame) -> DataFrame:
    """One row for each different (conversation, turn, role, text): how often it stands there, and the fault of its first."""
    text = F.col("text")
    end = F.right(F.rtrim(text, F.lit(_WHITE)), F.lit(1))
    fault = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), CUT).otherwise(SOUND)
    rows = turns.select("conv_id", "turn", "role", F.unhex(F.md5(text)).alias("digest"), fault.alias("fault"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count(F.lit(1)).alias("times"))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(_key(F.col("turn"))).alias("first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "digest")]
    seen = (F.col("r.fault") != BLANK) & (F.col("f.first") < _key(F.col("r.turn")))
    return rows.alias("r").join(first.alias("f"), same[0] & same[1] & same[2]).select(
        "r.conv_id", "r.turn", "r.role", "r.digest", "r.times", F.when(seen, TWICE).otherwise(F.col("r.fault")).alias("fault")
    )


_PIECE = (
    "part int, turns long, first long, last long, head string, tail string, illegal long, blank long, duplicate long, "
    "truncated long, cells array<struct<p: int, q: int, cost: long, audit: string>>"
)
_CELLS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


class _Piece:
    """The rows of one conversation that one task holds, in order."""

    def __init__(self):
        self.parse = Parse()
        self.turns, self.first, self.last = 0, None, None
        self.head, self.tail, self.illegal = None, None, 0
        self.faults = {BLANK: 0, TWICE: 0, CUT: 0}

    def add(self, turn: int | None, role: str, fault: str, times: int) -> None:
        initial = role[:1]
        if turn is not None and (self.last is None or turn != self.last):
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.illegal += 1
        self.illegal += times - 1  # no initial may stand beside itself
        self.tail = initial
        self.parse.add(initial, fault)
        if fault in self.faults:
            self.faults[fault] += 1
        if times > 1:
            # repeats on the spot: blank ones are blank, others duplicates, and all of them must go
            self.faults[BLANK if fault == BLANK else TWICE] += times - 1
            gone = {(p, p): (DROP * (times - 1), DELETE * (times - 1)) for p in range(4)}
            self.parse.push(times - 1, combine(gone, INSERTIONS))  # insertions after deletions come first in text order

    def values(self, part: int) -> tuple:
        cells = [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in self.parse.take().items()]
        faults = self.faults
        return (part, self.turns, self.first, self.last, self.head, self.tail, self.illegal, faults[BLANK], faults[TWICE], faults[CUT], cells)


_TYPES = [pa.int32(), *[pa.int64()] * 3, pa.string(), pa.string(), *[pa.int64()] * 4, _CELLS]
_NAMES = [field.split()[0] for field in _PIECE.split(", cells")[0].split(", ")] + ["cells"]
_OUT_ROWS = 500


def _table(keys: list, key_type: pa.DataType, rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *columns], ["conv_id", *names])


def _pieces(faults: DataFrame) -> DataFrame:
    """Each task parses the rows that it holds of each conversation; ranges, not keys, so a hot conversation is many pieces."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    partitions = int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = faults.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    rows = placed.select("conv_id", "turn", "role", "fault", "times", F.spark_partition_id().alias("part"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, key, part, keys, done, key_type = None, None, 0, [], [], None
        for batch in batches:
            key_type = batch.schema.field(0).type
            columns = [column.to_pylist() for column in batch.columns]
            for conv, turn, role, fault, times, part in zip(*columns):
                if piece is None or conv != key:
                    if piece is not None:
                        keys.append(key)
                        done.append(piece.values(part))
                    piece, key = _Piece(), conv
                piece.add(turn, role, fault, times)
            if len(keys) >= _OUT_ROWS:
                yield _table(keys, key_type, done, _TYPES, _NAMES)
                keys, done = [], []
        if piece is not None:
            yield _table([*keys, key], key_type, [*done, piece.values(part)], _TYPES, _NAMES)

    return rows.mapInArrow(scan, f"conv_id {faults.schema['conv_id'].dataType.simpleString()}, {_PIECE}")


_PLAN = "turns long, first long, last long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces of a conversation combined in order: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("part")]
    rows = pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", *_NAMES)
    names = [field.split()[0] for field in _PLAN.split(", ")]
    types = [*[pa.int64()] * 8, pa.string()]

    def finish(parse: Parse, sums: list, ends: list, illegal: int) -> tuple:
        return (*sums[:1], *ends[:2], *sums[1:], illegal, *whole(parse.take()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, keys, done, key_type = None, None, [], [], None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for conv, _, turns, first, last, head, tail, illegal, *faults, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != key:
                    if state is not None:
                        keys.append(key)
                        done.append(finish(*state[:4]))
                    state, key = [Parse(), [0, 0, 0, 0], [None, None], 0, None], conv
                parse, sums, ends, _, before = state
                if first is not None:
                    sums[0] += turns - (first == ends[1])  # a turn that goes on from the last piece
                    ends[0], ends[1] = first if ends[0] is None else ends[0], last
                for i, n in enumerate(faults):
                    sums[i + 1] += n
                state[3] += illegal + (before is not None and before + head not in LEGAL)
                state[4] = tail
                parse.push(1, {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cells})
            if len(keys) >= _OUT_ROWS:
                yield _table(keys, key_type, done, types, names)
                keys, done = [], []
        if state is not None:
            yield _table([*keys, key], key_type, [*done, finish(*state[:4])], types, names)

    found = rows.mapInArrow(scan, f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, {_PLAN}")
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("turns"), F.lit(0))
    return found.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repair_plans(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation.

    ``turns`` hold conv_id, turn, role and text; other columns are not read. A null role or text reads as one space, so such a row has no
    legal role or is blank; a null conv_id is a conversation of its own. Rows stand by turn, null first, those of
    one turn by role and a digest of the text; repeated rows all count, and all but the first are duplicates.
    ``gaps`` ignores null turns. An empty table has no conversations.
    """
    return _joined(_pieces(_faults(_read(turns))))


def _read(turns: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text and edit of the turns that ``plans`` leave, in order within their conversation.

    Turns stream past the audit of their conversation, which comes first, so a task holds one batch of texts at a time.
    """
    rows = _read(turns)
    none = F.lit(None)
    both = plans.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"))
    both = both.union(rows.select("conv_id", F.lit(1), F.col("turn").cast("long"), "role", "text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.unhex(F.md5("text"))]
    placed = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text")
    names = ["position", "role", "text", "edit"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, position = "", 0, START, 0
        for batch in batches:
            key_type, keys, done = batch.schema.field(0).type, [], []
            kinds, roles, texts = (batch.column(i) for i in (1, 2, 3))
            for i, (conv, kind) in enumerate(zip(batch.column(0).to_pylist(), kinds.to_pylist())):
                if kind == 0:
                    audit, at, state, position = texts[i].as_py(), 0, START, 0
                else:
                    edit, at = audit[at], at + 1
                    if edit != DELETE:
                        expected = "a" if state == USER else "u"
                        role = roles[i].as_py() if edit == KEEP else ROLES[expected]
                        keys.append(conv)
                        done.append((position, role, texts[i].as_py(), edit))
                        state, position = STEPS[state, role[:1]], position + 1
                while audit[at : at + 1] == INSERT:
                    expected, at = "a" if state == USER else "u", at + 1
                    keys.append(conv)
                    done.append((position, ROLES[expected], "", INSERT))
                    state, position = STEPS[state, expected], position + 1
            if keys:
                yield _table(keys, key_type, done, types, names)

    conv_type = rows.schema["conv_id"].dataType.simpleString()
    return placed.mapInArrow(scan, f"conv_id {conv_type}, position long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): lowercase hex of ``role:text`` of :func:`repaired_turns`, newline-joined, read row by row."""
    conv_type = repaired.schema["conv_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, key, key_type = None, None, None
        for batch in batches:
            key_type, keys, done = batch.schema.field(0).type, [], []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3))
            for conv, position, role, text in rows:
                if position == 0:
                    if sha is not None:
                        keys.append(key)
                        done.append((sha.hexdigest(),))
                    sha, key = hashlib.sha256(), conv
                else:
                    sha.update(b"\n")
                sha.update(f"{role.as_py()}:{text.as_py()}".encode())
            if keys:
                yield _table(keys, key_type, done, [pa.string()], ["repaired_sha256"])
        if sha is not None:
            yield _table([key], key_type, [(sha.hexdigest(),)], [pa.string()], ["repaired_sha256"])

    return repaired.select("conv_id", "position", "role", "text").mapInArrow(scan, f"conv_id {conv_type}, repaired_sha256 string")


def repair_summary(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of ``conversations``: its plan and the digest of its repaired turns.

    Conversations without turns have zeros, an empty audit and the hash of nothing.
    """
    plans = written(repair_plans(turns), "repair-plans")
    sums = digests(repaired_turns(turns, plans))
    ids = conversations.select("conv_id").distinct()
    joined = ids.alias("i").join(plans.alias("p"), F.col("i.conv_id").eqNullSafe(F.col("p.conv_id")), "left")
    joined = joined.join(sums.alias("s"), F.col("i.conv_id").eqNullSafe(F.col("s.conv_id")), "left")
    counts = [F.coalesce(f"p.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "i.conv_id",
        *counts,
        F.coalesce("p.audit", F.lit("")).alias("audit"),
        F.coalesce("s.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
