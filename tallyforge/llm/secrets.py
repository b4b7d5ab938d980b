"""Secret scans: patterns, and long strings that a character Markov model finds random.

Two order-1 Markov models of characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples; a candidate's log-likelihood ratio for each
character decides. Spans are code points, end exclusive.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.spans import SPANS, overlaps, span_columns

KINDS = ("assign", "access", "hex", "random")

# Patterns of the base kinds and the lengths their matches must reach.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20

#: A candidate of the model: at least this long, at least this many different characters, and a
#: log-likelihood ratio over this for each character.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
DISTINCT = 8
THRESHOLD = 0.5

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, len(_ALPHABET), dtype=np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))

# Words of the ordinary identifiers in the labelled sample.
_PARTS = (
    "account address amount array background batch buffer button cache callback channel client cluster column "
    "command config connection container content context control counter current customer data database default "
    "delete device dictionary directory document element error event exception execute export factory field file "
    "filter format frame function gateway group handler header identifier image import index information input "
    "instance integer interface internal iterator language layout length library listener location manager message "
    "method model module monitor network number object operation option output package parameter parser partition "
    "password path pattern payment process product project property provider query reader record reference region "
    "register report request resource response result return schedule schema screen search section server service "
    "session setting source standard status storage stream string structure system table target template thread "
    "token transaction transfer update upload user value variable vector version window worker writer"
).split()


def labelled_samples(spark: SparkSession, rows: int = 1200, seed: int = 7) -> DataFrame:
    """(value, secret): a small labelled table made by rule: random strings of usual alphabets and joined words."""
    rng = random.Random(seed)
    alphabets = (_ALPHABET[:62], _ALPHABET[:64], _ALPHABET[26:62], "0123456789abcdef", _ALPHABET[:26] + _ALPHABET[52:62])
    made = []
    for i in range(rows // 2):
        made.append(("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 64))), 1))
        words = rng.choices(_PARTS, k=rng.randint(2, 7))
        style = i % 6
        if style == 0:
            value = "_".join(words)
        elif style == 1:
            value = "-".join(words)
        elif style == 2:
            value = "/".join(words)
        elif style == 3:
            value = "".join(word.capitalize() for word in words)
        elif style == 4:
            value = "_".join(words).upper() + "_" + str(rng.randint(1, 2030))
        else:
            value = "".join(words)
        made.append((value, 0))
    return spark.createDataFrame(made, "value string, secret int")


class MarkovRatio:
    """Log ratio of two transition tables, random over ordinary."""

    def __init__(self, samples: list[tuple[str, int]]):
        size = len(_ALPHABET) + 2  # any other character, and the start
        counts = np.full((2, size, size), 0.1)
        for value, secret in samples:
            codes = self.codes(value)
            np.add.at(counts[int(bool(secret))], (codes[:-1], codes[1:]), 1)
        logs = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.table = logs[1] - logs[0]

    @staticmethod
    def codes(value: str) -> np.ndarray:
        points = np.frombuffer(value.encode("utf-32-le"), np.uint32)
        inside = np.where(points < 128, _CODE[np.minimum(points, 127)], len(_ALPHABET))
        return np.concatenate([[len(_ALPHABET) + 1], inside])

    def score(self, value: str) -> float:
        """Mean log-likelihood ratio of a character; 0 for nothing."""
        codes = self.codes(value)
        return float(self.table[codes[:-1], codes[1:]].mean()) if value else 0.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return found + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


def all_spans(text: str, model: MarkovRatio) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    added = [
        (3, m.start(), m.end())
        for m in CANDIDATE.finditer(text)
        if len(set(m.group())) >= DISTINCT and not overlaps(base, m.start(), m.end()) and model.score(m.group()) > THRESHOLD
    ]
    return base + added


def train(samples: DataFrame, limit: int = 20_000) -> MarkovRatio:
    """Tables from (value, secret); of a larger table the ``limit`` rows that come first by value."""
    rows = samples.filter("value IS NOT NULL AND secret IS NOT NULL").orderBy("value", "secret").limit(limit).collect()
    return MarkovRatio([(row["value"], row["secret"]) for row in rows])


def find_secrets(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans``: array of (kind, start, end, value, base) by start, then kind as listed in ``KINDS``.

    Null and empty texts have none; every row keeps its own, repeated ones too. A random string
    that overlaps a match of a pattern is not listed again.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(samples))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for cell in batch.column("text"):
                text = cell.as_py() or ""
                found = sorted(all_spans(text, model.value), key=lambda x: (x[1], x[0]))
                spans.append([(KINDS[k], a, b, text[a:b], KINDS[k] != "random") for k, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column("id"), span_columns(spans)], ["id", "spans"])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS STRING) AS text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)
