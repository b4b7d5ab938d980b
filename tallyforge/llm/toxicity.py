"""Toxicity: a learned lexicon, misspellings by Levenshtein automaton, and contexts of each hit.

The lexicon, the words that only look like it and the weights of the score come from a bounded
sample of labelled rows (``SAMPLE_ROWS``). Every whole text is then read word by word. A word
runs through the deterministic automaton of the lexicon trie intersected with the Levenshtein
automata of its terms, which is built state by state as words need it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StructField, StructType

from tallyforge.llm.language import fold
from tallyforge.session import scratch_path

#: Labelled rows that teach the lexicon and the weights, those of the lowest id hash; longer texts don't teach.
SAMPLE_ROWS = 12_000
SAMPLE_CHARS = 50_000
#: A term of the lexicon: in so many toxic rows at least, with this log odds ratio at least; and how many terms.
SUPPORT, LOG_ODDS, TERMS = 4, 1.8, 3_000
#: A stem is the first letters of longer words.
STEMS = (4, 5, 6, 7)
#: Words on each side that make the context of a hit.
WINDOW = 8
#: Words and automaton states that a task remembers before it starts afresh.
REMEMBERED = 100_000

_WORD = re.compile(r"[^\W\d_]+")
QUOTES = "\"'“”„«»‘’"
#: Words that report what somebody else said.
REPORTING = frozenset("said says wrote writes called calls quoted quotes term word so-called".split())
FACTOR_QUOTED, FACTOR_NEAR = 0.4, 0.25


def lowered(text: str) -> str:
    """``text`` in lower case, letter for letter: a dotted capital I would become two code points of which one parts words."""
    return text.replace("\u0130", "i").lower()


def allowed_errors(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Lexicon:
    """Trie of the searched terms with the automaton that accepts words within the allowed edits of a term."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], searched: frozenset[str], ordinary: frozenset[str]):
        self.words, self.stems, self.ordinary = words, stems, ordinary
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.limit = [0]  # the edits that any term below a node allows
        for word in sorted(searched):
            node, limit = 0, allowed_errors(len(word))
            self.limit[0] = max(self.limit[0], limit)
            for letter in word:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.limit.append(0)
                node = self.children[node][letter]
                self.limit[node] = max(self.limit[node], limit)
            self.term[node] = word
        self.seen: dict[str, tuple[float, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepted: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of the state of (trie node, edits so far), closed under skipped letters; -1 if nothing is left."""
        open_nodes = list(nodes)
        while open_nodes:
            node = open_nodes.pop()
            edits = nodes[node] + 1
            for child in self.children[node].values():
                if edits <= self.limit[child] and nodes.get(child, edits + 1) > edits:
                    nodes[child] = edits
                    open_nodes.append(child)
        key = tuple(sorted(nodes.items()))
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] and e <= allowed_errors(len(self.term[n]))]
            best = min(ends, default=None)
            self.accepted.append((best[1], best[0]) if best else None)
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}
        for node, edits in self.states[state]:
            for onto in (node, *self.children[node].values()):
                if edits < self.limit[onto]:
                    nodes[onto] = min(edits + 1, nodes.get(onto, edits + 1))
            child = self.children[node].get(letter)
            if child is not None:
                nodes[child] = min(edits, nodes.get(child, edits))
        return self._state(nodes)

    def nearest(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the term with the fewest edits, the first by name among equals."""
        state, steps = self.start, self.steps
        for letter in word:
            onto = steps[state].get(letter)
            if onto is None:
                onto = steps[state][letter] = self._step(state, letter)
            if onto < 0:
                return None
            state = onto
        return self.accepted[state]

    def lookup(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of a hit: a term, a misspelled term that is no ordinary word, or a word with a listed stem."""
        if word in self.seen:
            return self.seen[word]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        if len(self.states) > REMEMBERED:
            self._reset()
        hit = None
        if word in self.words:
            hit = (self.words[word], 0)
        else:
            near = self.nearest(word)
            if near and word not in self.ordinary:
                hit = (self.words[near[0]] * 0.5 ** near[1], near[1])
            stems = [self.stems[word[:size]] for size in STEMS if word[:size] in self.stems and len(word) > size]
            if stems and (hit is None or max(stems) > hit[0]):
                hit = (max(stems), 0)
        self.seen[word] = hit
        return hit

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, float, int]], int]:
        """(word number, start, end, weight, edits) of each hit, and the number of words."""
        seen, found, total = self.seen, [], 0
        text = lowered(text)
        words = _WORD.findall(text)
        total = len(words)
        at = []
        for i, word in enumerate(words):
            hit = seen.get(word, 0)
            if hit is None:
                continue
            hit = hit or self.lookup(word)
            if hit:
                at.append((i, hit))
        if at:
            wanted = dict(at)
            for i, m in enumerate(_WORD.finditer(text)):
                if i in wanted:
                    found.append((i, m.start(), m.end(), *wanted[i]))
        return found, total


def quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks stand on both sides in the line, or a word of reporting just before."""
    before = text[max(0, start - 60) : start]
    after = text[end : end + 60]
    before, after = before.rpartition("\n")[2], after.partition("\n")[0]
    marks = sum(c in QUOTES for c in before)
    last = _WORD.findall(lowered(before))[-2:]
    return bool(marks % 2 and any(c in QUOTES for c in after)) or any(word in REPORTING for word in last)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """What the score weighs: sums of hits by context, their density, strongest hit, misspellings."""
    hits, total = lexicon.hits(text or "")
    weighed, strongest, misspelled, quotes = 0.0, 0.0, 0, 0
    for n, (i, start, end, weight, edits) in enumerate(hits):
        if quoted(text, start, end):
            weight *= FACTOR_QUOTED
            quotes += 1
        near = sum(1 for j in range(max(0, n - 3), min(len(hits), n + 4)) if j != n and abs(hits[j][0] - i) <= WINDOW)
        weighed += weight * (1 + FACTOR_NEAR * near)
        strongest = max(strongest, weight)
        misspelled += edits > 0
    words = max(total, 1)
    return [
        math.log1p(weighed),
        strongest,
        min(100 * weighed / words, 40.0) / 4,
        math.log1p(len(hits)),
        math.log1p(total) / 4,
        math.log1p(misspelled),
        math.log1p(quotes),
    ]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(_WORD.findall(lowered(text or "")))
            counts[toxic].update({(word, 0) for word in words})
            counts[toxic].update({(word[:size], 1) for word in words for size in STEMS if len(word) > size})
        terms = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.int32()),
             pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())],
            ["term", "stem", "toxic", "clean"],
        )


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression with an intercept, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    def __init__(self, lexicon: tuple[dict[str, float], dict[str, float], frozenset[str], frozenset[str]], weights: list[float]):
        self.parts, self.weights = lexicon, weights

    def __reduce__(self):
        return ToxicityModel, (self.parts, self.weights)

    def score(self, text: str | None) -> float:
        x = features(text, _lexicon(self))
        total = sum(a * b for a, b in zip(x, self.weights)) + self.weights[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


@lru_cache(maxsize=1)
def _lexicon(model: ToxicityModel) -> Lexicon:
    return Lexicon(*model.parts)


EMPTY: tuple = ({}, {}, frozenset(), frozenset())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Model from the labelled rows of ``docs``; an id with several labels counts as toxic if one says so.

    With no row of either class every text scores 0.
    """
    spark = docs.sparkSession
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")), "id")
        .limit(SAMPLE_ROWS)
    )
    path = scratch_path(spark, "toxicity-sample")
    (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .filter(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(chosen), "id")  # SAMPLE_ROWS rows of an id and a flag
        .groupBy("text")  # copies would pass for evidence
        .agg(F.max(F.least(F.lit(1), F.greatest(F.lit(0), "toxic"))).alias("toxic"))
        .write.parquet(path)
    )
    sample = spark.read.parquet(path)
    sizes = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(EMPTY, [0.0] * len(features("", Lexicon(*EMPTY))) + [-30.0])
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    terms = (
        sample.mapInArrow(_term_counts, "term string, stem int, toxic long, clean long")
        .groupBy("term", "stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= SUPPORT)
        .withColumn("weight", odds)
        .filter(F.col("weight") >= LOG_ODDS)
        .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term", "stem")
        .limit(TERMS)
        .collect()
    )
    words = {row["term"]: row["weight"] for row in terms if not row["stem"]}
    stems = {row["term"]: row["weight"] for row in terms if row["stem"]}
    model = ToxicityModel((words, stems, frozenset(words), _ordinary(sample, words)), [0.0] * 8)
    held = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(held.value)
        for batch in batches:
            rows = [features(text, lexicon) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    rows = sample.mapInArrow(measure, "x array<double>, toxic int").orderBy("toxic", "x").collect()
    weights = fit_weights(np.array([row["x"] for row in rows]), np.array([row["toxic"] for row in rows], float))
    return ToxicityModel(model.parts, weights.tolist())


def _ordinary(sample: DataFrame, words: dict[str, float]) -> frozenset[str]:
    """Words of clean rows that lie within the edits of a term but are none."""
    held = sample.sparkSession.sparkContext.broadcast(words)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(held.value, {}, frozenset(held.value), frozenset())
        for batch in batches:
            found = {word for text in batch.column("text").to_pylist() for word in set(_WORD.findall(lowered(text or "")))}
            near = sorted(word for word in found if word not in lexicon.words and lexicon.nearest(word))
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["word"])

    clean = sample.filter("toxic = 0").select("text").mapInArrow(look, "word string")
    return frozenset(row["word"] for row in clean.distinct().collect())


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 (a column so named is replaced); null and empty texts score as texts without hits."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    place = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(text) for text in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(scan, schema)


def training_labels(labels: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """Labels of the rows that may teach: crc32 of the id modulo ``folds`` is not 0."""
    return labels.filter(fold(F.col(id_col), folds) != 0)
