"""Groups of spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

A word's edits (each letter deleted, each letter replaced by a smaller one; the other half is met from the other word)
are hashed from its running sums without being built. A blocked filter for each word length, one 64-bit block a
key, tells which edits may be words; only those are built and shuffled to an exact join with the vocabulary, which removes
the false ones. The filters are broadcast in parts of at most ``PART_BYTES``: a larger vocabulary takes
more parts, one after the other, each with its own share of the hashes. Forms lead to strictly more frequent words, so chains
end and are followed by doubling.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.graph import written
from tallyforge.llm.textbatch import mix, powers
from tallyforge.session import scratch_path

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: Words a task counts before it hands them on.
HELD_WORDS = 200_000
#: Longest length with a filter of its own; longer words share LONG_FILTERS of them, since they have more edits.
LONG = 64
LONG_FILTERS = 3
KEYS_A_BLOCK = 4
PART_BYTES = 16 << 20
POSITIONS = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LENGTH_STEP = np.uint64(0xD6E8FEB86659FD93)

Change = Callable[[object, str], str]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, change: Change | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, A-Z lower-cased, of ``min_length`` or more.

    Null and empty texts have none, every row counts. ``change`` rewrites a run of a document (its id, the run) before it is
    counted; results that are too short go. Tasks add up before the shuffle, so a frequent word is a row a task.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                low = (text.as_py() or "").encode().translate(_LOWER).decode()
                for word, n in Counter(run.findall(low)).items():
                    word = change(key, word) if change else word
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    parts = docs.select(id_col, text_col).mapInArrow(scan, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def _finish(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(sums + lengths.astype(np.uint64) * _LENGTH_STEP)


class Letters:
    """Words laid end to end, with the sums from which hashes of the words and of their edits follow."""

    def __init__(self, words: list[str]):
        self.data = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.uint64)
        self.lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        self.row = np.repeat(np.arange(len(words)), self.lengths)
        self.place = np.arange(len(self.data)) - self.starts[self.row]
        self.up, down = powers(int(self.lengths.max()) + 2)
        self.inverse = down[1]
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data + np.uint64(1)) * self.up[self.place], dtype=np.uint64, out=self.sums[1:])
        self.before, self.total = self.sums[self.starts], self.sums[ends]

    def words(self) -> np.ndarray:
        return _finish(self.total - self.before, self.lengths)

    def edits(self, alphabet: list[int], min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(places, hashes, lengths, letter): the letter replaces that at the place; 0 stands for a deletion.

        Of a run of equal letters only the first is deleted, so each edit comes once.
        """
        for low in range(0, len(self.data), POSITIONS):
            at = np.arange(low, min(low + POSITIONS, len(self.data)))
            row, place, letter = self.row[at], self.place[at], self.data[at]
            size = self.lengths[row]
            whole = self.total[row] - self.before[row]
            cut = np.flatnonzero((size > min_length) & ((place == 0) | (letter != self.data[at - 1])))
            head = self.sums[at[cut]] - self.before[row[cut]]
            tail = self.total[row[cut]] - self.sums[at[cut] + 1]
            yield at[cut], _finish(head + tail * self.inverse, size[cut] - 1), size[cut] - 1, 0
            for other in alphabet:
                some = np.flatnonzero(letter > other)
                moved = (letter[some] - np.uint64(other)) * self.up[place[some]]
                yield at[some], _finish(whole[some] - moved, size[some]), size[some], other


def _grouped(words: list[str]) -> Iterator[list[str]]:
    """Words in lists of about POSITIONS letters, a longer word alone."""
    some, letters = [], 0
    for word in words:
        if some and letters + len(word) > POSITIONS:
            yield some
            some, letters = [], 0
        some.append(word)
        letters += len(word)
    if some:
        yield some


def _bits(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), np.uint64)
    for step in range(5):
        out |= np.uint64(1) << ((hashes >> np.uint64(6 * step)) & np.uint64(63))
    return out


class Shards:
    """Where the blocks of each length's filter lie in the array of a part."""

    def __init__(self, counts: dict[int, int], parts: int):
        """``counts`` holds the words of each length, all from LONG on as one."""
        each = [counts.get(size, 0) for size in range(LONG)] + [counts.get(LONG, 0)] * LONG_FILTERS
        self.blocks = np.array([ceil(n / KEYS_A_BLOCK / parts) + 1 for n in each], np.uint64)
        self.offsets = np.concatenate([[0], np.cumsum(self.blocks)]).astype(np.int64)
        self.parts = parts

    def part(self, hashes: np.ndarray) -> np.ndarray:
        return mix(hashes ^ _LENGTH_STEP) % np.uint64(self.parts)

    def places(self, hashes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, blocks, bits) of each filter of the keys: the first of all, then the others of long ones."""
        shard, rows = np.minimum(lengths, LONG), np.arange(len(hashes))
        for _ in range(LONG_FILTERS):
            block = ((hashes >> np.uint64(32)) * self.blocks[shard]) >> np.uint64(32)
            yield rows, self.offsets[shard] + block.astype(np.int64), _bits(hashes)
            longer = np.flatnonzero(shard >= LONG)
            if not len(longer):
                return
            rows, shard, hashes = rows[longer], shard[longer] + 1, mix(hashes[longer] + _LENGTH_STEP)

    def maybe(self, held: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether each key may be in the part."""
        found = np.ones(len(hashes), bool)
        for rows, block, bits in self.places(hashes, lengths):
            found[rows] &= (held[block] & bits) == bits
        return found


def _filter_rows(vocabulary: DataFrame, shards: Shards) -> DataFrame:
    """(part, block, bits) of all filters, keys of a block brought together by Spark."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _grouped(batch.column(0).to_pylist()):
                letters = Letters(some)
                hashes = letters.words()
                part = shards.part(hashes).astype(np.int64)
                for rows, block, bits in shards.places(hashes, letters.lengths):
                    columns = [pa.array(part[rows]), pa.array(block), pa.array(bits.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "block", "bits"])

    rows = vocabulary.select("word").mapInArrow(scan, "part long, block long, bits long")
    return rows.groupBy("part", "block").agg(F.bit_or("bits").alias("bits"))


def _positives(vocabulary: DataFrame, shards: Shards, held, part: int, alphabet: list[int], min_length: int) -> DataFrame:
    """(word, n, other): edits that the filters of a part let pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            counts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for some in _grouped(list(counts)):
                letters = Letters(some)
                for at, hashes, lengths, letter in letters.edits(alphabet, min_length):
                    if shards.parts > 1:
                        mine = np.flatnonzero(shards.part(hashes) == np.uint64(part))
                        at, hashes, lengths = at[mine], hashes[mine], lengths[mine]
                    at = at[shards.maybe(filters, hashes, lengths)]
                    if not len(at):
                        continue
                    words = [some[r] for r in letters.row[at].tolist()]
                    new = chr(letter) if letter else ""
                    others = [w[:p] + new + w[p + 1 :] for w, p in zip(words, letters.place[at].tolist())]
                    columns = [pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64()), pa.array(others, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "n", "other"])

    return vocabulary.select("word", "n").mapInArrow(scan, "word string, n long, other string")


def near_pairs(vocabulary: DataFrame, min_length: int = MIN_LENGTH, part_bytes: int = PART_BYTES) -> DataFrame:
    """(word, n, other, other_n), each pair of words one edit apart in both directions.

    ``vocabulary`` (word, n) holds each word once, of ``min_length`` or more letters of Latin-1; it is read once to build the
    filters and once a part.
    """
    spark = vocabulary.sparkSession
    sizes = vocabulary.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("size")).count()
    counts = {r["size"]: r["count"] for r in sizes.collect()}  # a row a length, LONG at most
    keys = sum(n * (LONG_FILTERS if size == LONG else 1) for size, n in counts.items())
    shards = Shards(counts, max(1, ceil(keys / KEYS_A_BLOCK * 8 / part_bytes)))
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()
    alphabet = sorted(ord(r["letter"]) for r in letters.collect() if r["letter"])  # 90 letters at most
    filters = written(_filter_rows(vocabulary, shards), "spelling-filters")
    path = scratch_path(spark, "spelling-positives")
    for part in range(shards.parts):
        rows = filters.filter(F.col("part") == part).select("block", "bits").toArrow()
        held = np.zeros(int(shards.offsets[-1]), np.uint64)
        held[np.asarray(rows["block"])] = np.asarray(rows["bits"]).view(np.uint64)
        sent = spark.sparkContext.broadcast(held.tobytes())
        _positives(vocabulary, shards, sent, part, alphabet, min_length).write.parquet(f"{path}/{part}")
        sent.destroy()
    found = spark.read.schema("word string, n long, other string").parquet(*(f"{path}/{p}" for p in range(shards.parts)))
    exact = found.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    both = F.array(
        F.struct("word", "n", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    return exact.select(F.inline(both))


def spelling_groups(
    counts: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, part_bytes: int = PART_BYTES
) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word that is long and frequent enough.

    ``counts`` is (word, n) as of :func:`word_counts`. A word's form is its near word of the largest n, of equal ones the
    first by code points, if that n is at least ``ratio`` (2 or more) times the word's own; the root is where forms lead. Words without a near word have
    n_near 0, no form and themselves as root. An empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    vocabulary = written(
        counts.select("word", "n").filter((F.length("word") >= min_length) & (F.col("n") >= min_count)), "vocabulary"
    )
    near = near_pairs(vocabulary, min_length, part_bytes).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    fits = -F.col("best.less") >= ratio * F.col("n")
    grouped = written(
        vocabulary.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("best.other")).alias("form"),
            F.when(fits, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    steps = grouped.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    longest = max(1, int(log(max(most / min_count, 1), ratio)) + 1)
    for _ in range(ceil(log2(longest)) if longest > 1 else 0):
        steps = written(steps, "spelling-roots")
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return grouped.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))
