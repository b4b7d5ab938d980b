"""Mixing, top-k, near duplicates, repeated strings and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check_oracle  # noqa: E402
import corpus_pipeline  # noqa: E402
from tallyforge.llm import neardup, pii, queries, toxicity
from tallyforge.llm.bwt import repeated_runs
from tallyforge.llm.graph import components
from tallyforge.llm.oracle import LLM_ORACLE
from tallyforge.llm.mixing import emit_copies, mix_sources
from tallyforge.llm.neardup import drop_near_duplicates, near_duplicates
from tallyforge.llm.repeats import anchors, anchors_by_part, repeated_spans, without_spans
from tallyforge.llm.topk import exact_top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, class string, spans string"


def docs_of(spark, rows):
    """(id, text, source) rows with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in rows], DOCS)


EDGES = [None, "", " \t\n", "one", "the same few words", "the same few words", "long " * 20_000, "ß" * 900]


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.001"


# --- mixing


def fair_targets(sizes, weights, cap=3):
    """Targets by resharing the excess again and again."""
    total, stopped = sum(sizes.values()), {}
    while True:
        left = total - sum(stopped.values())
        rest = sum(w for s, w in weights.items() if s not in stopped)
        level = {s: left * w / rest for s, w in weights.items() if s not in stopped} if rest else {}
        above = {s: cap * sizes[s] for s, t in level.items() if t > cap * sizes[s]}
        if not above:
            return {**stopped, **level}
        stopped |= above


def test_mix_targets_and_copies(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "é", "Z", None, "tiny"])) for i in range(3000)]
    rows += [(3000 + i, t, "edge") for i, t in enumerate(EDGES)] + [(1, rows[1][1], rows[1][2])] * 3
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = fair_targets(sizes, weights)
    mixed = mix_sources(docs_of(spark, rows))
    got = mixed.collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] == r["copies"] * len((r["text"] or "").split())
        taken[r["source"]] += r["taken"]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= max(r["size"] for r in got if r["source"] == source) * 3
    key = lambda r: (r["doc_id"], r["copies"], r["size"])
    again = mix_sources(docs_of(spark, rows[::-1]).repartition(7))
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    assert emit_copies(mixed).count() == sum(r["copies"] for r in got)


def test_mix_of_nothing(spark):
    assert mix_sources(docs_of(spark, [])).count() == 0
    row = mix_sources(docs_of(spark, [(1, None, None)])).first()
    assert (row["size"], row["target"], row["taken"]) == (0, 0.0, 0)


# --- top-k


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    table = (rng.normal(size=(900, 12)) * 0.4).round(2)
    table[100:140] = table[100]  # ties
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(table)]
    rows += [(900, None, "x"), (901, [], "x"), (902, [1.0, None] * 6, "x"), (903, [float("nan")] * 12, "x"), (904, [float("inf")] * 12, "x"), (905, [0.5] * 3, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5)
    asked = vectors.filter("vec_id % 50 = 0")
    whole = np.floor(256 * table).astype(np.int64)
    want = {
        q: sorted(((-int(whole[q] @ whole[c]), c) for c in range(900) if c != q))[:5] for q in range(0, 900, 50)
    }
    for block in (4096, 7):
        got = defaultdict(dict)
        for r in exact_top_k(vectors, asked, query_block=block).collect():
            got[r["query_id"]][r["rank"]] = (-r["score"], r["vec_id"])
        assert {q: [found[n] for n in sorted(found)] for q, found in got.items()} == want
    assert exact_top_k(vectors.limit(0), asked.limit(0)).count() == 0
    few = exact_top_k(vectors.filter("vec_id < 3"), vectors.filter("vec_id = 0")).orderBy("rank").collect()
    assert [r["rank"] for r in few] == [1, 2]


# --- near duplicates


def brute_sets(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        out[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=4))
    rows = [(i, t, "s") for i, t in enumerate(EDGES)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 7, 12, 60, 150, 300]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy.append(word())
            rows.append((len(rows), rng.choice([" ", "\n"]).join(copy), "s"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    rows = near_rows(seed)
    sets = brute_sets(rows)
    want = brute_components(sets)
    got = near_duplicates(docs_of(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets
    }
    left = drop_near_duplicates(docs_of(spark, rows))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i in sets if want[i] == i)


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(docs_of(spark, [])).count() == 0
    twice = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "A B c d e f", "s"), (None, "x", "s"), (None, "y", "s")]
    assert {tuple(r) for r in near_duplicates(docs_of(spark, twice)).collect()} == {(1, 2, 1, True), (2, 2, 1, False)}
    assert sorted(str(r["doc_id"]) for r in drop_near_duplicates(docs_of(spark, twice)).collect()) == ["1", "None", "None"]


def test_corrected_estimate_follows_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.95, 0.85, 0.5, 0.1):
        for size in (40, 400):
            both = rng.integers(0, 2**64, size=size, dtype=np.uint64)
            cut = int(size * (1 - share) / (1 + share))
            a, b = both[cut:], np.concatenate([both[: size - cut]])
            rows = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
            values = np.concatenate([np.sort(a), np.sort(b)])
            table = neardup.registers(rows, values, 2)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(abs((table[0] == table[1]).mean() - true))
    assert max(errors) < 0.16


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(400, 7), (5, 5), (9, 8)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(200, 401)) and got[9] == 8


# --- repeated strings


def brute_runs(texts, least):
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for text in texts:
        hit = np.zeros(len(text) + 2, bool)
        for i in range(len(text) - least + 1):
            if seen[text[i : i + least]] > 1:
                hit[i + 1 : i + least + 1] = True
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        out.append([(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])])
    return out


def test_transform_matches_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        base = bytes(rng.choices(b"ab", k=30))
        noise = lambda: bytes(rng.choices(b"abc\x00\xff", k=rng.randint(0, 12)))
        texts = [noise() + base[rng.randint(0, 20) :][: rng.randint(0, 30)] + noise() for _ in range(rng.randint(1, 6))]
        least = rng.randint(1, 20)
        assert repeated_runs(texts, least) == brute_runs(texts, least)


def test_every_string_has_one_anchor_by_content():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 100, 700).astype(np.uint8)
    data = np.concatenate([text, text[100:500], np.full(300, 97, np.uint8)])
    offsets = np.array([0, 700, 700, 1100, 1400])
    found = defaultdict(set)
    for row, anchor, _, a, b, place in zip(*anchors(data, offsets, 60, 12)):
        for start in range(a, b + 1):
            whole = data[offsets[row] + start : offsets[row] + start + 60].tobytes()
            found[whole].add((int(anchor), int(place - start)))
    assert all(len(v) == 1 for v in found.values())
    total = sum(max(0, n - 59) for n in np.diff(offsets).tolist())
    assert sum(1 for row, _, _, a, b, _ in zip(*anchors(data, offsets, 60, 12)) for _ in range(a, b + 1)) == total


def test_long_texts_are_read_part_by_part():
    data = np.random.default_rng(4).integers(97, 110, 5_000).astype(np.uint8)
    strings = lambda found: {(int(h), int(p - s)) for _, h, _, a, b, p in zip(*found) for s in range(a, b + 1)}
    whole, parts = anchors(data, np.array([0, 5_000]), 400), anchors_by_part(data, np.array([0, 5_000]), 400, 700)
    assert strings(whole) == strings(parts)
    assert sum(b - a + 1 for a, b in zip(parts[3], parts[4])) == 5_000 - 399


def repeat_rows(seed):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdé ", k=k))
    passages = [text(k) for k in (390, 450, 700, 1500)]
    rows = [(i, t, "s") for i, t in enumerate([*EDGES, "z" * 450, "line of text. " * 80])]
    for _ in range(60):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, 60)
            parts += [p[cut : len(p) - rng.randint(0, 60)], text(rng.randint(0, 200))]
        rows.append((len(rows), "".join(parts), "s"))
    return rows + [(len(rows), rows[20][1], "s"), (20, rows[20][1], "s"), (21, "another text of id 21", "s")]


@pytest.mark.parametrize("crowd", [1000, 3])
def test_repeats_match_brute_force(spark, crowd):
    rows = repeat_rows(3)
    texts = [(t or "").encode() for _, t, _ in rows]
    want = Counter()
    for (i, _, _), text, runs in zip(rows, texts, brute_runs(texts, 400)):
        kept, done = b"", 0
        for a, b in runs:
            kept, done = kept + text[done:a], b
        kept += text[done:]
        want[(i, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())] += 1
    found = without_spans(repeated_spans(docs_of(spark, rows), crowd=crowd))
    got = Counter(tuple(r) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
    assert got == want


def test_repeats_of_nothing(spark):
    assert without_spans(repeated_spans(docs_of(spark, []))).count() == 0


# --- the pipeline


def test_pipeline_matches_its_stages_by_brute_force(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r["doc_id"]: r.asDict() for r in documents.collect()}
    model = toxicity.learn(documents, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    left = {i: d for i, d in docs.items() if model.score(d["text"]) < 0.5}
    assert 0 < len(left) < len(docs)

    groups = brute_components(brute_sets([(i, d["text"], None) for i, d in left.items()]))
    left = {i: d for i, d in left.items() if groups[i] == i}

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = cut(r["text"])
        size = min(13, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size}
    for i in list(left):
        words, hit = cut(left[i]["text"]), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
        if hit and 20 * len(hit) >= len(words):
            del left[i]

    field = pii.train(pii.labelled_lines(spark))
    for d in left.values():
        spans = pii.text_spans([d["text"] or ""], field)[0]
        d["text"] = pii.masked(d["text"], spans) if spans else d["text"]
        d["n_chars"] = len(d["text"])

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    counts = Counter(r["doc_id"] for r in rows)
    assert set(counts) <= set(left)
    sizes = Counter()
    for d in left.values():
        sizes[d["source"]] += len((d["text"] or "").split())
    names = sorted(sizes)
    want = fair_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for r in rows:
        d = left[r["doc_id"]]
        assert (r["text"], r["n_chars"], r["source"]) == (d["text"], d["n_chars"], d["source"])
        assert (r["source_size"], r["copies"]) == (sizes[r["source"]], counts[r["doc_id"]])
        assert r["target"] == pytest.approx(want[r["source"]])
    for source in names:
        taken = sum(r["size"] for r in rows if r["source"] == source)
        assert abs(taken - want[source]) <= 3 * max((len(d["text"].split()) for d in left.values() if d["source"] == source))


def test_stages_take_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, None, None, None) for i, t in enumerate(EDGES)] + [(3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, None, None, None, None)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), schema)
            assert docs.count() == (0 if not table else len(table) if name == "toxicity" else len(table) - 3), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= (1 if table else 0)


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.LLM_QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_queries_match_their_sql(spark, sf_dir, name):
    assert check_oracle.compare(spark, check_oracle.connect(sf_dir), name, sf_dir).startswith("ok ")
