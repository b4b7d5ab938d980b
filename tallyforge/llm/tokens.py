"""Token totals kept by signed deltas, committed once a batch.

A ledger is a folder of deltas, one for each batch id, and of bases that fold deltas and keep the ids of
those folded, so batches may come in any order and leave gaps. An insert adds a document and its tokens, a delete takes both away, a revision adds the
difference of two counts; totals by source, language and tokenizer version are sums. A batch that is
committed again changes nothing, and one that broke off leaves no trace in the totals.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.mixing import word_count

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that parts text for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KEYS = ("source", "lang", "tokenizer")
INSERT, DELETE, REVISE = "insert", "delete", "revise"


@lru_cache(maxsize=1)
def _encoder(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``bpe`` and ``words``: tokens of the vocabulary and runs without white space.

    Null and empty texts count 0; columns of those names are replaced. The vocabulary file is read once and sent to the tasks
    (it is a fixed file of about a megabyte); every whole text is encoded, special tokens as ordinary text.
    """
    with open(vocabulary, "rb") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    counted = docs.drop("bpe").withColumn("words", word_count(F.col(text_col)))
    place = counted.columns.index(text_col)
    kept = [field for field in counted.schema.fields if field.name != text_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for batch in batches:
            counts = [len(encoder.encode_ordinary(text.as_py() or "")) for text in batch.column(place)]
            columns = [column for i, column in enumerate(batch.columns) if i != place]
            names = [name for i, name in enumerate(batch.schema.names) if i != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, "bpe"])

    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in kept)
    return counted.mapInArrow(scan, f"{schema}, bpe long")


def changes(counts: DataFrame, action: str, tokenizer: str, tokens: str, before: str | None = None) -> DataFrame:
    """Rows of one action for :meth:`Ledger.commit`: counts in column ``tokens``, earlier ones in ``before``."""
    return counts.select(
        F.lit(action).alias("action"),
        "source",
        "lang",
        F.lit(tokenizer).alias("tokenizer"),
        F.col(tokens).cast("long").alias("tokens"),
        (F.col(before) if before else F.lit(None)).cast("long").alias("before"),
    )


class Ledger:
    """Totals in a folder that all executors and the driver share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _finished(self, kind: str) -> list[int]:
        """Ids of the folders of a kind that were written to the end."""
        path, files = self._path(f"{self.root}/{kind}")
        if not files.exists(path):
            return []
        found = (status.getPath().getName() for status in files.listStatus(path))
        ids = sorted(int(name) for name in found if name.isdigit())
        return [i for i in ids if files.exists(self._path(f"{self.root}/{kind}/{i}/_SUCCESS")[0])]

    def _base(self) -> tuple[int | None, list[tuple[int, int]]]:
        """The newest base and the ranges of batch ids it holds: few, since neighbouring ids are one range."""
        bases = self._finished("base")
        if not bases:
            return None, []
        ranges = self.spark.read.schema("first long, last long").parquet(f"{self.root}/folded/{bases[-1]}")
        return bases[-1], sorted((r["first"], r["last"]) for r in ranges.collect())

    def _open(self) -> tuple[int | None, list[tuple[int, int]], list[int]]:
        """The newest base, what it holds, and the finished deltas that it doesn't."""
        base, folded = self._base()
        return base, folded, [i for i in self._finished("deltas") if not _within(i, folded)]

    def commit(self, batch: int, rows: DataFrame) -> bool:
        """Write the deltas of a batch; False if this id is already in the totals.

        ``rows`` hold action, source, lang, tokenizer, tokens and before. Null counts are 0. Deltas
        are summed before they are shuffled, so a hot source is one row a task. A batch
        that broke off has no ``_SUCCESS`` and is written anew.
        """
        _, folded, deltas = self._open()
        if batch in deltas or _within(batch, folded):
            return False
        action = F.col("action")
        sign = F.when(action == INSERT, 1).when(action == DELETE, -1).when(action == REVISE, 0)
        tokens, before = F.coalesce("tokens", F.lit(0)), F.coalesce("before", F.lit(0))
        moved = F.when(action == REVISE, tokens - before).otherwise(sign * tokens)
        deltas = rows.groupBy(*KEYS).agg(F.sum(sign).alias("documents"), F.sum(moved).alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.root}/deltas/{batch}")
        return True

    def _parts(self) -> DataFrame | None:
        base, _, deltas = self._open()
        paths = [f"{self.root}/base/{base}"] if base is not None else []
        paths += [f"{self.root}/deltas/{i}" for i in deltas]
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens; null sources and languages are groups, empty groups are left out."""
        sums = self._parts().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all deltas into a base; older folders go once it is written.

        The ids it holds are written first: a base without its ``_SUCCESS`` is not read, nor are they.
        """
        base, folded, deltas = self._open()
        if not deltas:
            return
        number = 0 if base is None else base + 1
        ranges = _ranges(folded + [(i, i) for i in deltas])
        self.spark.createDataFrame(ranges, "first long, last long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/folded/{number}")
        self.totals().write.mode("overwrite").parquet(f"{self.root}/base/{number}")
        older = range(number) if base is None else [base]
        gone = [f"deltas/{i}" for i in self._finished("deltas") if _within(i, ranges)]
        for name in [*gone, *(f"{kind}/{i}" for i in older for kind in ("base", "folded"))]:
            path, files = self._path(f"{self.root}/{name}")
            files.delete(path, True)


def _within(batch: int, ranges: list[tuple[int, int]]) -> bool:
    return any(first <= batch <= last for first, last in ranges)


def _ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of ids, neighbours joined."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def corpus_totals(docs: DataFrame, root: str, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Totals of a corpus, kept as a loader would: estimate, revise, delete.

    ``all_documents`` and ``all_tokens`` cover every row, ``documents`` and ``tokens`` leave out exact copies; each
    pair has a ledger of its own. A group that holds only copies has 0 documents. Batch 1 inserts every document with an estimate of a token for four characters, batch 2 revises
    the estimates to the counts of each tokenizer version, batch 3, of the totals without copies alone, deletes each
    text's documents but the one of the smallest id (among equal ids that of the first source). Batch 2 is sent twice,
    as after a lost answer. As copies null and empty texts are one text.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"), F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256).alias("digest"),
        F.ceil(F.coalesce(F.length(text_col), F.lit(0)) / 4).alias("guess"),
    )
    path = f"{root.rstrip('/')}/counts"
    count_tokens(rows, vocabulary).write.mode("overwrite").parquet(path)
    counts = spark.read.parquet(path)
    versions = {"byte_bpe_50k/1": "bpe", "words/1": "words"}
    ledger, single = (Ledger(spark, f"{root.rstrip('/')}/{name}") for name in ("ledger", "single"))

    def batch(frame: DataFrame, action: str, before: str | None = None, guess: bool = False) -> DataFrame:
        out = None
        for version, column in versions.items():
            one = changes(frame, action, version, "guess" if guess else column, before)
            out = one if out is None else out.union(one)
        return out

    for one in (ledger, single):
        one.commit(1, batch(counts, INSERT, guess=True))
        for _ in range(2):
            one.commit(2, batch(counts, REVISE, before="guess"))
    # where a text has several rows all are deleted and the first is inserted again, in one batch
    copied = (
        counts.groupBy("digest")
        .agg(F.count("*").alias("held"), F.min(F.struct("id", "source", "lang", "bpe", "words")).alias("first"))
        .filter("held > 1")
    )
    gone = counts.join(copied.select("digest"), "digest", "left_semi")
    single.commit(3, batch(gone, DELETE).union(batch(copied.select("first.*"), INSERT)))
    for one in (ledger, single):
        one.compact()
    none = F.lit(0).cast("long")
    every = ledger.totals().select(*KEYS, none.alias("d"), none.alias("t"), F.col("documents").alias("all_d"), F.col("tokens").alias("all_t"))
    both = every.union(single.totals().select(*KEYS, "documents", "tokens", none, none)).groupBy(*KEYS)
    return both.agg(
        F.sum("d").alias("documents"), F.sum("t").alias("tokens"), F.sum("all_d").alias("all_documents"), F.sum("all_t").alias("all_tokens")
    )
