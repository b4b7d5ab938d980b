"""Token files, spelling variants and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from glob import glob
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from tallyforge.llm import queries, repair, tokenfiles, variants  # noqa: E402
from tallyforge.llm.repair import repair_plans, repair_summary, repaired_turns  # noqa: E402
from tallyforge.llm.tokenfiles import Encoder, checksums, read_tokens, write_tokens  # noqa: E402
from tallyforge.llm.variants import spelling_groups, word_counts  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokenfiles.VOCABULARY))


# --- token files


def brute_files(library, rows):
    """(id, start, n_tokens, crc32) of (id, text) rows in the order of the files."""
    out, start = [], 0
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op11_against_the_library(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in queries.op11_tokenfiles(spark, sf_dir).collect())
    assert got == brute_files(library, [tuple(r) for r in rows])


def test_pieces_encode_as_whole_texts(library):
    rng = random.Random(4)
    encoder = Encoder(public_tokenizers.path(tokenfiles.VOCABULARY))
    parts = ["a", "word", "it's", ", ", ".", "!)", "—", "д", "Ünï", "x,y", ".\n", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "​", " ", "é", "中文", "12", "?!", "<|endoftext|>", "<|end", "😀"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_every_letter_go_to_the_model_alone(library):
    encoder = Encoder(public_tokenizers.path(tokenfiles.VOCABULARY))
    letters = [c for c in map(chr, range(0x41, 0x2B0)) if tokenfiles._WORD.fullmatch(c)]
    assert len(letters) > 500
    for one, other in zip(letters, letters[::-1]):
        for word in (one, f" {one}", f" {one}{other}{one}"):
            assert encoder._encode_word(word) == encoder._encode(word), word


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_of_odd_rows(spark, tmp_path, library, encoding):
    texts = [None, "", " \n", "two words", "x" * 50_000, "long text " * 20_000, "<|endoftext|> again", "same", "same"]
    rows = [(i * 3 % 10, t, "s", 1, "p") for i, t in enumerate(texts)] + [(None, "no id", "s", 2, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, at int, part string").repartition(3)
    write_tokens(docs, str(tmp_path), encoding=encoding)
    tokens = read_tokens(spark, str(tmp_path))
    assert set(tokens.columns) == {"doc_id", "source", "n_tokens", "ids", "start"}
    want = brute_files(library, [(None, "no id")] + sorted(((r[0], r[1]) for r in rows if r[0] is not None)))
    assert sorted((tuple(r) for r in checksums(tokens).collect()), key=lambda r: r[1]) == want
    by_id = {r["doc_id"]: r["ids"] for r in tokens.collect()}
    assert library.decode(by_id[9][:-1]) == "two words" and by_id[0] == [2]
    with pytest.raises(ValueError):
        write_tokens(docs, str(tmp_path), keep=("at",))


def test_repeated_ids_keep_their_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "other"), (2, None)], "doc_id long, text string")
    write_tokens(docs, str(tmp_path))
    rows = sorted(tuple(r) for r in checksums(read_tokens(spark, str(tmp_path))).select("doc_id", "start", "n_tokens").collect())
    assert [r[0] for r in rows] == [1, 1, 1, 2]
    assert [r[1] for r in rows] == np.concatenate([[0], np.cumsum([r[2] for r in rows])[:-1]]).tolist()


def test_token_files_of_an_empty_table(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string, source string"), str(tmp_path))
    assert checksums(read_tokens(spark, str(tmp_path))).collect() == []


def test_files_are_sorted_paged_and_read_in_part(spark, tmp_path, sf_dir):
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path))
    spans = []
    for path in glob(f"{tmp_path}/tokens/*.parquet"):
        groups = pq.ParquetFile(path).metadata
        for g in range(groups.num_row_groups):
            columns = {groups.row_group(g).column(c).path_in_schema: groups.row_group(g).column(c) for c in range(groups.num_columns)}
            assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            spans.append((columns["doc_id"].statistics.min, columns["doc_id"].statistics.max))
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    some = read_tokens(spark, str(tmp_path)).filter("doc_id BETWEEN 20 AND 29").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert some.count() == 10


# --- spelling variants


def brute_vocabulary(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_groups(vocabulary):
    """(word, form, root, n, n_near, form_n) from every edit of every word."""
    letters = sorted({c for w in vocabulary for c in w})
    forms, near = {}, {}
    for word in vocabulary:
        edits = {word[:i] + word[i + 1 :] for i in range(len(word))}
        edits |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
        edits |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
        near[word] = [e for e in edits if e != word and e in vocabulary]
        best = min(near[word], key=lambda e: (-vocabulary[e], e), default=None)
        if best is not None and vocabulary[best] >= 5 * vocabulary[word]:
            forms[word] = best
    out = []
    for word, n in vocabulary.items():
        root = word
        while root in forms:
            root = forms[root]
        form = forms.get(word)
        out.append((word, form, root, n, len(near[word]), vocabulary.get(form)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op12_against_brute_force(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op12_variants(spark, path).collect()), key=repr)
    assert got == brute_groups(brute_vocabulary(rows))
    assert any(r[1] for r in got)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("part_bytes", [variants.PART_BYTES, 64])
def test_groups_of_odd_vocabularies(spark, part_bytes):
    rng = random.Random(12)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8]))): rng.choice([5, 5, 30, 200, 2_000]) for _ in range(500)}
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "b" * 63: 9, "b" * 64: 99, "b" * 65: 999, "b" * 64 + "c": 5}
    words |= {"ÿ" * 200: 5, "ÿ" * 199 + "À": 25, "ab" * 40_000: 7, "ab" * 39_999 + "a": 700, "short": 900, "rare word": 4}
    frame = spark.createDataFrame([(w, n) for w, n in words.items() if w != "rare word"], "word string, n long").repartition(5)
    got = spelling_groups(frame, part_bytes=part_bytes).select(*COLUMNS).collect()
    kept = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    assert len(got) == len(kept)
    small = {w: n for w, n in kept.items() if len(w) < 1_000}
    assert sorted((tuple(r) for r in got if len(r[0]) < 1_000), key=repr) == brute_groups(small)
    long = {len(r["word"]): r for r in got if len(r["word"]) >= 1_000}
    assert long[80_000]["root"] == "ab" * 39_999 + "a" and long[79_999]["n_near"] == 1


def test_words_of_odd_documents(spark):
    texts = [None, "", "  ", "ABCDEF abcdef Àbcdef×y", "x" * 60_000, "abcdef1abcdef", "short é"] + ["word word wordword"] * 2
    docs = spark.createDataFrame([(i, t, 3, "w") for i, t in enumerate(texts)], "doc_id long, text string, n int, word string")
    want = Counter({"abcdef": 4, "Àbcdef×y": 1, "x" * 60_000: 1, "wordword": 2})
    assert {r["word"]: r["n"] for r in word_counts(docs).collect()} == want
    assert word_counts(docs.limit(0)).collect() == []
    assert spelling_groups(word_counts(docs.limit(0))).collect() == []
    assert word_counts(spark.createDataFrame([(None, "abcdef")], "doc_id long, text string"), change=queries.misspelt).count() == 1
    with pytest.raises(ValueError):
        spelling_groups(word_counts(docs), ratio=1)


def test_filters_never_miss_and_let_few_pass():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefghijklmn") for _ in range(rng.randrange(6, 90))) for _ in range(20_000)})
    shards = variants.Shards(Counter(min(len(w), variants.LONG) for w in words), 1)
    held = np.zeros(int(shards.offsets[-1]), np.uint64)
    letters = variants.Letters(words[::2])
    for _, block, bits in shards.places(letters.words(), letters.lengths):
        np.bitwise_or.at(held, block, bits)
    assert shards.maybe(held, letters.words(), letters.lengths).all()
    others = variants.Letters(words[1::2])
    assert shards.maybe(held, others.words(), others.lengths).mean() < 0.01


# --- conversation repair


def brute_damage(rows):
    """Rows after damage, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv] += []
        if kind != 0:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for turns in out.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    return out


def brute_faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(turns):
    """(cost, audit, repaired lines): Dijkstra over (row, initials so far as a place of the pattern)."""
    faults = brute_faults(turns)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, place, lines = heapq.heappop(heap)
        if (i, place) in done:
            continue
        done.add((i, place))
        if i == len(turns) and place in ("", "a"):
            return cost, audit, lines
        for role in ("user", "assistant"):
            if (place, role[0]) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", i, step[place, role[0]], lines + (f"{role}:",)))
        if i < len(turns):
            _, own, text = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, place, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if (place, own[:1]) in step:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, step[place, own[:1]], lines + (f"{own}:{text}",)))
                for role in ("user", "assistant"):
                    if (place, role[0]) in step:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, step[place, role[0]], lines + (f"{role}:{text}",)))
    raise AssertionError


def brute_row(conv, turns):
    given = [t for t, _, _ in turns if t is not None]
    gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
    faults = brute_faults(turns)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit, lines = brute_repair(turns)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)


REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op13_against_brute_force(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted(brute_row(conv, turns) for conv, turns in brute_damage(rows).items())
    assert sorted(tuple(r) for r in queries.op13_repair(spark, path).select(*REPAIR).collect()) == want


def test_repair_of_odd_conversations(spark):
    rng = random.Random(13)
    rows = []
    for conv in [None, *range(120)]:
        for _ in range(rng.choice([1, 2, 3, 5, 9, 40])):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, ""])
            text = rng.choice(["One.", "Two!", "cut", "", None, " \n", "Three? \n", "Ünïcode.", "last ", f"{rng.random()}."])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 4, 5, 9]), role, text, "x", 7))
    rows += [(500, t, "user", "Same text.", "y", 1) for t in range(300)] + [(501, 3, "user", "Same row.", "y", 1)] * 300
    rows += [(502, None, "assistant", "x" * 50_000, "y", 1), (503, 0, "user", "." * 30_000, "y", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, part int").repartition(4)
    want = [brute_row(conv, turns) for conv, turns in brute_damage([r[:4] for r in rows]).items()]
    got = repair_summary(queries.damaged(frame), frame).select(*REPAIR).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    turns = repaired_turns(frame, repair_plans(frame)).collect()
    assert {r["edit"] for r in turns} == {"K", "R", "I"} and all(r["role"][:1] in "sua" for r in turns)
    empty = frame.limit(0)
    assert repair_plans(empty).collect() == [] and repair_summary(empty, frame).count() == 125


def test_long_conversation_is_parsed_in_pieces(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Full stop.", "cut", f"{t}.", f"{t}!"])) for t in range(3_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        assert repair._pieces(repair._faults(frame)).count() > 8
        got = [tuple(r) for r in repair_summary(frame, frame).select(*REPAIR).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    turns = [(t, r, x) for _, t, r, x in rows]
    cost, audit = repair.whole(_parse(turns))
    sound = brute_row(7, turns[:200])
    assert got[0][6:8] == (cost, audit) and repair.whole(_parse(turns[:200])) == sound[6:8]


def _parse(turns):
    parse = repair.Parse()
    for (_, role, _), fault in zip(turns, brute_faults(turns)):
        parse.add(role[:1], fault or "sound")
    return parse.take()
