"""Benchmark decontamination: Wu-Manber search for windows of benchmark words.

The test strings are windows of ``WINDOW`` consecutive words of an item; an item of fewer
words is one window. Windows of one length form a set with a table of shifts by blocks of two
words, and buckets by the block that ends a window. The tables live on the executors one
benchmark block of about ``BLOCK_WORDS`` words at a time, so a larger benchmark means
more passes over a document, not larger tables.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.textbatch import ALNUM, lower_ascii, prefix_sums, slices, span_hash, words

WINDOW = 13
BLOCK = 2
BLOCK_WORDS = 1_000_000


class WuManber:
    """Windows of one length as sequences of word numbers; 0 is any word that no window holds."""

    def __init__(self, length: int, windows: dict[tuple[int, ...], list[int]], vocabulary: int):
        self.length = length
        self.block = min(BLOCK, length)
        self.base = vocabulary + 1
        self.default = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(dict)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = self._key(window, end)
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.buckets[self._key(window, length)][window] = items

    def _key(self, ids, end: int) -> int:
        return ids[end - 1] if self.block == 1 else ids[end - 2] * self.base + ids[end - 1]

    def occurrences(self, ids: list[int]) -> Iterator[tuple[int, tuple[int, ...], list[int]]]:
        """(start, window, item numbers) of every occurrence."""
        shift, default, base, length, total = self.shift, self.default, self.base, self.length, len(ids)
        end = length
        while end <= total:
            key = ids[end - 1] if self.block == 1 else ids[end - 2] * base + ids[end - 1]
            step = shift.get(key, default)
            if step:
                end += step
                continue
            window = tuple(ids[end - length : end])
            items = self.buckets[key].get(window)
            if items is not None:
                yield end - length, window, items
            end += 1


class Benchmark:
    """Search tables of one benchmark block."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        names = sorted({word for _, item in items for word in item})
        hashes = self._hashes(names)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order + 1
        self.names = [b"", *names]
        number = {word: i + 1 for i, word in enumerate(names)}
        self.items = [name for name, _ in items]
        found: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for which, (_, item) in enumerate(items):
            ids = [number[word] for word in item]
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1 if size else 0):
                holders = found[size][tuple(ids[start : start + size])]
                if not holders or holders[-1] != which:
                    holders.append(which)
        self.searches = [WuManber(size, dict(windows), len(names)) for size, windows in sorted(found.items())]

    @staticmethod
    def _hashes(names: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(name) for name in names], dtype=np.int64) if names else np.zeros(0, np.int64)
        return span_hash(prefix_sums(data), np.concatenate([[0], ends[:-1]]).astype(np.int64) if names else ends, ends)

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0)

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text: number of words, merged runs of hit words, item numbers."""
        for first, end, data, offsets in slices(column):
            data = lower_ascii(data)
            starts, ends, rows = words(data, offsets, ALNUM)
            ids = self.numbered(span_hash(prefix_sums(data), starts, ends))
            bounds = np.searchsorted(rows, np.arange(end - first + 1))
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            for row in range(end - first):
                low, high = int(bounds[row]), int(bounds[row + 1])
                runs: list[tuple[int, int]] = []
                hit: set[int] = set()
                if known[high] > known[low]:
                    text = ids[low:high].tolist()
                    for search in self.searches:
                        for at, window, items in search.occurrences(text):
                            spelled = [data[starts[low + at + k] : ends[low + at + k]].tobytes() for k in range(len(window))]
                            if spelled == [self.names[i] for i in window]:
                                hit.update(items)
                                runs.append((at, at + len(window)))
                yield high - low, merged(runs), hit


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_words(text: str | None) -> list[bytes]:
    data = lower_ascii(np.frombuffer((text or "").encode(), np.uint8))
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    return [data[a:b].tobytes() for a, b in zip(starts, ends)]


def _pass(tables) -> object:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = tables.value
        for batch in batches:
            counts, hits, items = [], [], []
            before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist())
            for (total, runs, found), (old_runs, old_items) in zip(benchmark.scan(batch.column("text")), before):
                counts.append(total)
                runs = merged(runs + list(zip(old_runs[::2], old_runs[1::2])))
                hits.append([bound for run in runs for bound in run])
                items.append(sorted({benchmark.items[i] for i in found if benchmark.items[i] is not None} | set(old_items)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), pa.array(counts, pa.int64()),
                 pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                ["id", "text", "n_words", "hits", "items"],
            )

    return scan


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row a document: id, n_words, ``hits`` (start, end, start, end, ... of merged runs of hit words), ``items``.

    Null and empty texts have no words and hit nothing; items without words are never found, and
    words of items without an id are hit, though ``items`` can't name these. Repeated documents each keep their row; repeated
    items share their windows. No row is shuffled: each benchmark block is one narrow pass.
    """
    spark = docs.sparkSession
    kept = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter(
        "text IS NOT NULL"
    )
    size = kept.agg(F.sum(F.length("text") / 4).alias("words")).first()["words"] or 0
    blocks = int(size // block_words) + 1
    out = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = out.schema
    for block in range(blocks):
        part = kept.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        items = [(row["item"], item_words(row["text"])) for row in part.orderBy("item", "text").toLocalIterator()]
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(Benchmark(items, window))), schema)
    return out.select(F.col("id").alias(id_col), "n_words", "hits", "items")


def contamination_flag(n_hit, n_words):
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def hit_words(hits):
    """Number of words in the runs of ``hits``."""
    return F.aggregate(
        F.transform(hits, lambda bound, i: F.when(i % 2 == 0, -bound).otherwise(bound)),
        F.lit(0).cast("long"),
        lambda total, value: total + value,
    )
