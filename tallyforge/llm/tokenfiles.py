"""Token ids of a corpus as Parquet files whose tokens and metadata are read selectively.

A row is a document: its id, kept metadata, ``at`` (ids before it in its file), ``n_tokens`` and ``ids``. Rows stand
in ascending order of the id, within a file and from file to file, so statistics of row groups and pages let a reader of
some ids skip the rest, and a reader of metadata touches no token. Ids are dictionary pages (two bytes a token for a
vocabulary below 65,536) or delta pages; the other integers are delta pages. A small table ``parts`` holds the
number of ids before each file, so ``start`` needs no pass over the corpus.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Text bytes that one file holds, and the sizes of its row groups and pages.
FILE_BYTES = 64 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
#: Pieces of text that a worker remembers (about 200 MB), and the longest of them.
MEMO_PIECES = 1_000_000
MEMO_CHARS = 32
OWN = ("part", "at", "n_tokens", "ids")

# Fixed value: Unicode's White_Space, which parts text in byte-level vocabularies.
_SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# Letters of the most common scripts of such texts; pieces of others are longer, not wrong.
_LETTERS = r"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u02AF"
#: No token crosses these: a word or marks, each with one space before, that a known character ends; a run without white space; white space
_PIECE = re.compile(
    rf" ?[{_LETTERS}]+(?=[ \n.,;:?!)]|\Z)| ?[.,;:?!()]+(?=[ \nA-Za-z0-9]|\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_WORD = re.compile(rf" ?[{_LETTERS}]+")


def _byte_signs() -> dict[int, int]:
    """Byte to the sign that stands for it in byte-level vocabularies: visible ones are their own, the others follow 255."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (byte for byte in range(256) if byte not in visible)
    return {byte: byte for byte in visible} | {byte: 256 + i for i, byte in enumerate(others)}


class Encoder(dict):
    """Ids of texts by the tokenizers library, as little-endian unsigned 32-bit integers.

    A byte-level vocabulary never joins bytes of two pieces of ``_PIECE``, so the library encodes a piece once and
    a bounded memo repeats its answer; a text that holds the string of an added token goes to the library whole.
    A word is one piece for the library too, so its bytes go to the library's model without the steps before it.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker a core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.signs = self.library.model, _byte_signs()
        added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _encode_word(self, word: str) -> bytes:
        signs = word.encode().decode("latin-1").translate(self.signs)
        return array("I", [token.id for token in self.model.tokenize(signs)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self._encode_word(piece) if _WORD.fullmatch(piece) else self._encode(piece)
        if len(piece) <= MEMO_CHARS and len(self) < MEMO_PIECES:  # those met first, which the most frequent are among
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return self._encode(text)
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Rows of the files, in the order of the input's partitions: each partition is one file."""
    rows = docs.select(id_col, *keep, text_col)
    named = [field for field in rows.schema.fields if field.name != text_col]
    end = np.array([end_id], "<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [encoder.ids(text.as_py() or "") + end for text in batch.column(len(named))]
            counts = np.array([len(some) // 4 for some in ids], np.int64)
            starts = at + np.concatenate([[0], np.cumsum(counts)])
            values = pa.Array.from_buffers(pa.int32(), int(counts.sum()), [None, pa.py_buffer(b"".join(ids))])
            offsets = pa.array((starts - at).astype(np.int32))
            at = int(starts[-1])
            lists = pa.ListArray.from_arrays(offsets, values)
            own = [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts[:-1]), pa.array(counts), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*batch.schema.names[:-1], *OWN])

    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in named)
    return rows.mapInArrow(scan, f"{schema}, part int, at long, n_tokens long, ids array<int>")


def write_tokens(
    docs: DataFrame,
    root: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    encoding: str = "dictionary",
    keep: tuple[str, ...] = ("source", "lang"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text and write ``root/tokens`` and ``root/parts``.

    Null and empty texts hold the end id alone. Rows stand by id, null first; rows that repeat an id all stay, by a hash of
    their texts. Of the metadata in ``keep`` what ``docs`` has is kept; no other column is, and a kept name that the
    files use themselves is an error. The files of an empty table hold no row. ``encoding`` is that of the ids,
    ``dictionary`` or ``delta``. Number and size of files follow the bytes of the texts; a text is never parted.
    A lost task writes its file again: Spark's commit keeps one of each.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    kept = [name for name in keep if name in docs.columns and name not in (id_col, text_col)]
    if clashes := {id_col, *kept} & set(OWN):
        raise ValueError(f"columns of the files themselves: {sorted(clashes)}")
    spark, root = docs.sparkSession, root.rstrip("/")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    files = max(-(-size // FILE_BYTES), spark.sparkContext.defaultParallelism)
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)]
    placed = docs.select(id_col, *kept, text_col).repartitionByRange(files, *order).sortWithinPartitions(*order)
    writer = encoded(placed, vocabulary or public_tokenizers.path(VOCABULARY), end_id, id_col, text_col, kept).write.mode("overwrite")
    settings = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.enable.dictionary#ids.list.element": "true" if encoding == "dictionary" else "false",
        **{f"parquet.enable.dictionary#{name}": "false" for name in (id_col, "at", "n_tokens")},
    }
    writer.options(**settings).parquet(f"{root}/tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    parts = _files(spark, root).groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    parts = parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    parts.coalesce(1).write.mode("overwrite").parquet(f"{root}/parts")


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/tokens")


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """The files with ``start``, the ids of all documents before.

    Filters on the id and the choice of columns reach the files: pages out of range and unnamed columns are not read.
    """
    parts = spark.read.parquet(f"{root.rstrip('/')}/parts").select("part", "base")
    # one row a file of FILE_BYTES: a hundred terabytes are under two million rows of 12 bytes
    joined = _files(spark, root).join(F.broadcast(parts), "part")
    return joined.withColumn("start", F.col("base") + F.col("at")).drop("base", "part", "at")


def checksums(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of :func:`read_tokens`: the unsigned crc32 of the ids as stored in binary token files."""
    rows = tokens.select(id_col, "start", "n_tokens", "ids")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = np.asarray(lists.flatten()).astype("<u4", copy=False)
            ends = np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64)).tolist()
            sums = [zlib.crc32(values[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], [*batch.schema.names[:3], "ids_crc32"]
            )

    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(scan, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")
