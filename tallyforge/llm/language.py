"""Language by compression: a raw-content zstandard dictionary a language; the smallest result names it.

The dictionaries come from a bounded sample of labelled texts: for each language the
``SAMPLE_DOCS`` texts of up to ``SAMPLE_BYTES`` bytes with the lowest id hash, joined until
``DICTIONARY_BYTES``. Every text is then encoded whole, a long one in blocks that each start from the dictionary.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 200
SAMPLE_BYTES = 20_000
DICTIONARY_BYTES = 100_000
#: Fewer bytes per 1000 than this between the two best, and the answer counts as rejected.
MARGIN = 10
UNKNOWN = "und"
#: Short texts are encoded with shorter matches, which costs more time a byte.
SHORT = 600
#: Longer texts are encoded in blocks of so many bytes: the window (128 KB) would leave the dictionary behind.
BLOCK_BYTES = 1 << 16

LETTER = regex.compile(r"\p{L}")
_SPACED = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def letters_only(text: str) -> bytes:
    """The lower-case words of a text: what is no letter in ASCII parts them."""
    return b" ".join(text.lower().encode().translate(_SPACED).split())


def blocks(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of whole words of up to ``BLOCK_BYTES``; only a longer word is cut."""
    at = 0
    while len(data) - at > BLOCK_BYTES:
        end = data.rfind(b" ", at, at + BLOCK_BYTES + 1)
        end = end if end > at else at + BLOCK_BYTES
        yield data[at:end]
        at = end + (data[end : end + 1] == b" ")
    yield data[at:]


def sample_texts(labelled: DataFrame, lang_col: str, text_col: str, id_col: str) -> list[tuple[str, str]]:
    """At most ``SAMPLE_DOCS`` texts a language, in the order of a hash of the id."""
    order = Window.partitionBy("lang").orderBy("rank", "text")
    rows = (
        labelled.select(
            F.col(lang_col).alias("lang"),
            F.col(text_col).alias("text"),
            F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("rank"),
        )
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .filter(F.octet_length("text").between(1, SAMPLE_BYTES))
        .withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= SAMPLE_DOCS)
    )
    return [(row["lang"], row["text"]) for row in rows.orderBy("lang", "nth").select("lang", "text").collect()]


def dictionaries(samples: list[tuple[str, str]], names: list[str]) -> dict[str, bytes]:
    joined: dict[str, list[bytes]] = defaultdict(list)
    room: dict[str, int] = defaultdict(lambda: DICTIONARY_BYTES)
    for lang, text in samples:
        data = letters_only(text) + b" "
        if len(data) <= room[lang]:
            joined[lang].append(data)
            room[lang] -= len(data)
    return {lang: b"".join(parts) for lang, parts in sorted(joined.items(), key=lambda x: names.index(x[0]))}


class LanguageModel:
    """Compressors for each language; built once in each Python worker."""

    def __init__(self, contents: dict[str, bytes]):
        self.names = list(contents)
        self.quick, self.thorough = [], []
        for content in contents.values():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            for into, level, options in (
                (self.quick, 3, {}),
                (self.thorough, 12, {"min_match": 3, "strategy": zstandard.STRATEGY_BTOPT}),
            ):
                settings = zstandard.ZstdCompressionParameters.from_level(
                    level, dict_size=len(content), source_size=SHORT, write_content_size=0, write_dict_id=0, **options
                )
                into.append(zstandard.ZstdCompressor(dict_data=known, compression_params=settings))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected): the score is the share of bytes by which the best beats the next, on 0 to 1."""
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        data = letters_only(text)
        coders = self.thorough if len(data) <= SHORT else self.quick
        parts = list(blocks(data))
        sizes = [sum(len(coder.compress(part)) for part in parts) for coder in coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        second = min(size for i, size in enumerate(sizes) if i != best)
        lead = (second - sizes[best]) / second
        return self.names[best], min(1.0, lead), lead * 1000 < MARGIN


def identify_language(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """id, lang_pred, score, rejected for each row of ``docs``; ``labelled`` gives the dictionaries.

    A text that is null, empty or without a letter is ``und`` with score 0, and so is every
    text if nothing is labelled. Equal sizes go to the language with more labelled texts, then the first by name. With one
    language there is nothing to compare and the score is 1. Repeated rows each get theirs.
    """
    counts = labelled.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count()
    names = [row["lang"] for row in counts.orderBy(F.desc("count"), "lang").collect()]
    contents = docs.sparkSession.sparkContext.broadcast(
        dictionaries(sample_texts(labelled, lang_col, text_col, id_col), names)
    )

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(contents.value)
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                ["id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        classify, f"id {kind}, lang_pred string, score double, rejected boolean"
    ).withColumnRenamed("id", id_col)


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
