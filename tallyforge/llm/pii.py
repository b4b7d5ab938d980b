"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The field tags words with B-, I- or O of each kind. It is trained from a small labelled table
and decoded by Viterbi over batches of word runs. A tag dictionary is part of the field: a plain word,
one without a digit, ``@`` or bracket, can only be O. Such words split the chain exactly, so
only the runs of other words between them are decoded, with the result of the whole text. Spans
are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.spans import SPANS, overlaps, span_columns

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{place}-{kind}" for kind in KINDS for place in "BI"))
OUTSIDE = 0

# The patterns of the base kinds and the limits of their matches.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_PART = (16, 19), (8, 15), 255

#: What the field may add must hold so many digits; a card must also pass the Luhn check.
ADDED_DIGITS = {"ip": (4, 32), "card": (13, 19), "phone": (7, 15)}

# The labelled table: made-up lines with the personal data marked, ordinary lines without any.
LABELLED = """
write to <email>anna.berg(at)example(dot)com</email> about it
mail <email>info[at]firm[dot]org</email> for help
reach me on <email>j_doe(at)mail.net</email> please
my address is <email>tom@localhost</email> there
ask <email>kim(at)post.example.org</email> first
send it to <email>a.b@mail7.example.com</email> today
contact <email>x99@example.org</email> or call <phone>555-0142</phone>
the note of <email>karl.17@mail2.example.com</email> was lost
so wrote <email>m.lund@post.example.org</email>
<email>eva_92@box8.example.net</email> answered later
then <email>ole-b@example.com</email>, who had left, came back
list of <email>rita.5@mail11.example.com</email> and <email>c.d@example.org</email>
the old <email>sam+news@firm.example.org</email> still works
their <email>q.77@example.co.uk</email> was copied
known as <email>nina_x(at)club(dot)example(dot)org</email> in town
names like <email>lars[at]example[dot]net</email> are old
she is <email>otto.4[at]mail3.example.org</email> now
who is <email>pia@intranet</email> really
wrote <email>ada.8[at]haus(dot)example(dot)net</email> again
then <email>leo(at)mail9(dot)example(dot)com</email> came
both <email>ivo3(at)club[dot]net</email> and <email>uma[at]book[dot]org</email> read
is <email>bo_21[at]work.net</email> there
old <email>jan.6(at)town.net</email> too
call <phone>(212) 555-0199</phone> now
phone <phone>212-555-0147</phone> after nine
tel <phone>020 7946 0958</phone> or write
my number is <phone>(020) 7946 0123</phone> since may
ring <phone>555 010 4477</phone> at once
fax <phone>030/901820</phone> for the office
call <phone>+1 (790) 555-2115</phone> today
dial <phone>0044 20 7946 0321</phone> from abroad
mobile <phone>07700 900 123</phone> only
number <phone>(415) 555-0134</phone> rings
her phone is <phone>415.555.0188</phone> again
card <card>4111 1111 1111 1111</card> was used
pay with <card>5500-0000-0000-0004</card> please
card number <card>4012888888881881</card> expired
visa <card>4000 0566 5566 5556</card> is lost
charged to <card>3782 822463 10005</card> last week
amex <card>371449635398431</card> on file
the card <card>6011000990139424</card> works
address <ip>2001:db8:0:0:0:0:2:1</ip> answered
host <ip>192.168.1.77</ip> replied
from <ip>172.16.254.1</ip> to <ip>172.16.254.9</ip>
ping <ip>fe80::1ff:fe23:4567:890a</ip> failed
log in from <ip>203.0.113.25</ip> at noon
so <ip>10.44.7.203</ip> was seen
both <ip>81.2.69.144</ip> and <ip>198.51.100.4</ip> are known
then <ip>5.188.10.9</ip> came back
version 3.2.1 of the program was released
in 1998 the town had 12,500 people
section 4.1.2 says so on page 77
it cost 19.99 and not 25.00 this time
on 2024-01-15 we met at 10:30 for 45 minutes
chapters 12 13 and 14 were long
order 88213 holds 3 boxes of 24
the year 2001 (see note 12) was dry
a list of 10 20 30 40 50 values
room 101 on floor 7 is free
figures (a) and (b) show 95% of it
the sum of 100 and 250 is 350
he won 6-4 6-3 in 90 minutes
see [12] and [13] for the proof
under the license, version 2.0 of 2004
it (the first one) was not read
born 12.05.1987 in a small town
route 66 runs 2448 miles west
about 7 of 10 said yes, 3 of 10 no
token = "57f17a56c90cac3e893f4491169557bdc83d8148" was found
key 9c8b45435718dcc700c184a7 is no secret
meet @ noon by the gate
three pieces @ 5 each
the handle @maria_b was taken
an ordinary line of words without anything
Another One With Capital Letters Only
PLAIN WORDS IN LARGE LETTERS HERE
words, with; signs! and? more. signs
isbn 978-3-16-148410-0 is the book
temperature -40.5 to 120.25 degrees
ratio 16:9 or 4:3 on the screen
call it what you like, phone or not
"""

_MARK = re.compile(r"<(/?)(\w+)>")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A word with none of these is plain.
_OPEN = re.compile(r"[0-9@(\[]")
#: A name, a sign or word for "at" and the first part of a host.
_ADDRESS = re.compile(r"[A-Za-z0-9](?:@|[(\[]at[)\]])[A-Za-z0-9]")
#: Signs around a word that belong to no span.
SIGNS = "\"'.,;:!?|*#%&$<>="
#: Plain words that tell the open words beside them what they are.
CUES = frozenset(
    "call phone tel mobile number ring dial fax card visa amex pay mail email contact write server host ip address "
    "ping from version section page chapter".split()
)


def labelled_lines(spark: SparkSession) -> DataFrame:
    """(text, spans): the labelled table, ``spans`` as (kind, start, end)."""
    rows = []
    for line in LABELLED.strip().splitlines():
        text, spans, begun = "", [], 0
        at = 0
        for mark in _MARK.finditer(line):
            text += line[at : mark.start()]
            at = mark.end()
            if mark.group(1):
                spans.append((mark.group(2), begun, len(text)))
            else:
                begun = len(text)
        rows.append((text + line[at:], spans))
    return spark.createDataFrame(rows, "text string, spans array<struct<kind: string, start: int, end: int>>")


@lru_cache(maxsize=1 << 14)
def features(word: str) -> tuple[str, ...]:
    """Names of the shape features of one word."""
    if not _OPEN.search(word):
        bare = word.strip(".,;:!?\"'")
        return (f"cue={bare.lower()}",) if bare.lower() in CUES else ("plain",)
    shape = re.sub(r"[^\W\d_]+", "a", word.strip(SIGNS) or word)
    digits = re.findall(r"[0-9]+", word)
    runs = re.sub(r"[0-9]+", lambda m: f"<{min(len(m.group()), 5)}>", shape)
    total = sum(map(len, digits))
    return (
        "open",
        f"shape={re.sub(r'[0-9]+', 'd', shape)}",
        f"runs={runs}",
        f"digits={min(total, 20)}",
        f"groups={min(len(digits), 6)}",
        f"at={'@' in word}",
        f"address={_ADDRESS.search(word) is not None}",
        f"first={re.sub('[a-z]', 'a', re.sub('[0-9]', 'd', word[0].lower()))}",
        f"last={re.sub('[a-z]', 'a', re.sub('[0-9]', 'd', word[-1].lower()))}",
        f"letters={any(map(str.isalpha, word))}",
        f"dots={min(word.count('.'), 4)}",
        f"colons={min(word.count(':'), 3)}",
    )


def neighbour(word: str | None) -> str:
    """What a word tells of those beside it."""
    if word is None:
        return "none"
    found = features(word)
    return found[0] if found[0].startswith(("cue", "plain")) else found[3]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class WordField:
    """Weights of the field: features by tag, and tag by next tag."""

    def __init__(self, lines: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 60, rate: float = 0.3, decay: float = 0.01):
        self.index: dict[str, int] = {}
        chains = []
        for text, spans in lines:
            words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
            tags = []
            for _, start, end in words:
                held = next(((k, a, b) for k, a, b in spans if a < end and start < b), None)
                tags.append(OUTSIDE if held is None else TAGS.index(f"{'B' if start <= held[1] else 'I'}-{held[0]}"))
            names = [self._names(words, i) for i in range(len(words))]
            chains.append((
                [[self.index.setdefault(n, len(self.index)) for n in found] for found in names],
                [bool(_OPEN.search(word)) for word, _, _ in words],
                tags,
            ))
        self.allowed = np.array(
            [[not b.startswith("I-") or a[2:] == b[2:] and a != "O" for b in TAGS] for a in TAGS]
        )
        self.weights = np.zeros((len(self.index), len(TAGS)))
        self.moves = np.zeros((len(TAGS), len(TAGS)))
        self._fit(chains, steps, rate, decay)

    @staticmethod
    def _names(words: list[tuple[str, int, int]], i: int) -> list[str]:
        before = words[i - 1][0] if i else None
        after = words[i + 1][0] if i + 1 < len(words) else None
        return WordField.names(words[i][0], before, after)

    @staticmethod
    def names(word: str, before: str | None, after: str | None) -> list[str]:
        own = list(features(word))
        if own[0] == "open":
            own += [f"before={neighbour(before)}", f"after={neighbour(after)}"]
        return own

    def _fit(self, chains, steps: int, rate: float, decay: float) -> None:
        """Gradient ascent on the penalised log-likelihood, by forward and backward sums."""
        square_w, square_m = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        for _ in range(steps):
            grad_w, grad_m = -decay * self.weights, -decay * self.moves
            moves = np.where(self.allowed, self.moves, -1e9)
            for rows, can_be, tags in chains:
                if not rows:
                    continue
                scores = np.array([self.weights[r].sum(axis=0) for r in rows])
                size = len(rows)
                scores[[not w for w in can_be], 1:] = -1e9
                ahead = np.empty_like(scores)
                ahead[0] = scores[0] + moves[OUTSIDE]
                for t in range(1, size):
                    ahead[t] = scores[t] + _log_sum(ahead[t - 1][:, None] + moves, 0)
                back = np.zeros_like(scores)
                back[-1] = moves[:, OUTSIDE]
                for t in range(size - 2, -1, -1):
                    back[t] = _log_sum(moves + (scores[t + 1] + back[t + 1])[None, :], 1)
                total = _log_sum(ahead[-1] + back[-1], 0)
                likely = np.exp(ahead + back - total)
                for t, r in enumerate(rows):
                    change = -likely[t]
                    change[tags[t]] += 1
                    grad_w[r] += change
                path = [OUTSIDE, *tags, OUTSIDE]
                for a, b in zip(path, path[1:]):
                    grad_m[a, b] += 1
                for t in range(1, size):
                    grad_m -= np.exp(ahead[t - 1][:, None] + moves + (scores[t] + back[t])[None, :] - total)
                grad_m[OUTSIDE] -= likely[0]
                grad_m[:, OUTSIDE] -= likely[-1]
            square_w += grad_w**2
            square_m += grad_m**2
            self.weights += rate * grad_w / np.sqrt(square_w)
            self.moves += rate * grad_m / np.sqrt(square_m)
        self.moves = np.where(self.allowed, self.moves, -1e9)

    def emission(self, word: str, before: str | None, after: str | None) -> np.ndarray:
        rows = [self.index[n] for n in self.names(word, before, after) if n in self.index]
        return self.weights[rows].sum(axis=0) if rows else np.zeros(len(TAGS))

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each run of emissions between two O words; runs of one length go together."""
        out: list[np.ndarray | None] = [None] * len(runs)
        by_size = defaultdict(list)
        for i, run in enumerate(runs):
            by_size[len(run)].append(i)
        for size, which in by_size.items():
            scores = np.stack([runs[i] for i in which])
            best = scores[:, 0] + self.moves[OUTSIDE]
            came = np.zeros((len(which), size, len(TAGS)), np.int8)
            for t in range(1, size):
                options = best[:, :, None] + self.moves[None]
                came[:, t] = options.argmax(axis=1)
                best = options.max(axis=1) + scores[:, t]
            tags = np.empty((len(which), size), np.int8)
            tags[:, -1] = (best + self.moves[:, OUTSIDE]).argmax(axis=1)
            for t in range(size - 1, 0, -1):
                tags[:, t - 1] = came[np.arange(len(which)), t, tags[:, t]]
            for i, found in zip(which, tags):
                out[i] = found
        return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind, then start."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= IP_PART for part in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m.group()) <= PHONE_DIGITS[1]:
            found.append((3, m.start(), m.end()))
    return found


def word_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of words that aren't plain, as (start, end)."""
    space = " \t\n\x0b\x0c\r"
    done, found = 0, _OPEN.search(text)
    while found:
        start = found.start()
        while start > done and text[start - 1] not in space:
            start -= 1
        run = []
        word = _WORD.match(text, start)
        while word and _OPEN.search(word.group()):
            run.append(word.span())
            done = word.end()
            word = _WORD.search(text, done)
        yield run
        found = _OPEN.search(text, done)


def _beside(text: str, at: int, step: int) -> str | None:
    """The word just before ``at`` (step -1) or from it on (step 1)."""
    if step > 0:
        found = _WORD.search(text, at)
        return found.group() if found else None
    end = at
    while end and text[end - 1] in " \t\n\x0b\x0c\r":
        end -= 1
    start = end
    while start and text[start - 1] not in " \t\n\x0b\x0c\r":
        start -= 1
    return text[start:end] or None


def field_spans(texts: list[str], field: WordField) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of tagged words in each text; signs around them are left out."""
    runs, where = [], []
    for i, text in enumerate(texts):
        for run in word_runs(text):
            words = [text[a:b] for a, b in run]
            around = [_beside(text, run[0][0], -1), *words, _beside(text, run[-1][1], 1)]
            runs.append(np.array([field.emission(w, around[j], around[j + 2]) for j, w in enumerate(words)]))
            where.append((i, run))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, run), tags in zip(where, field.decode(runs)):
        spans: list[list[int]] = []
        for (start, end), tag in zip(run, tags.tolist()):
            if tag == OUTSIDE:
                continue
            kind, inside = divmod(tag - 1, 2)
            if inside and spans and spans[-1][0] == kind:
                spans[-1][2] = end
            else:
                spans.append([kind, start, end])
        for kind, start, end in spans:
            value = texts[i][start:end]
            end -= len(value) - len(value.rstrip(SIGNS))
            start += len(value) - len(value.lstrip(SIGNS))
            digits = sum(c in "0123456789" for c in texts[i][start:end])
            low, high = ADDED_DIGITS.get(KINDS[kind], (0, 1 << 30))
            if KINDS[kind] == "card" and not luhn("".join(c for c in texts[i][start:end] if c in "0123456789")):
                continue
            if start < end and low <= digits <= high:
                out[i].append((kind, start, end))
    return out


def train(labelled: DataFrame, limit: int = 2_000) -> WordField:
    """The field from (text, spans); of a larger table the ``limit`` rows that come first by text."""
    rows = labelled.filter("text IS NOT NULL").orderBy("text").limit(limit).collect()
    return WordField([(row["text"], [(s["kind"], s["start"], s["end"]) for s in row["spans"] or []]) for row in rows])


def text_spans(texts: list[str], field: WordField) -> list[list[tuple[str, int, int, str, bool]]]:
    """(kind, start, end, value, base) by kind, then start; found words that overlap a base match are left out."""
    out = []
    for text, added in zip(texts, field_spans(texts, field)):
        base = base_spans(text)
        every = [(*s, True) for s in base] + [(*s, False) for s in added if not overlaps(base, s[1], s[2])]
        out.append([(KINDS[k], a, b, text[a:b], own) for k, a, b, own in sorted(every)])
    return out


def find_pii(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans``: array of (kind, start, end, value, base) by kind as listed in ``KINDS``, then start.

    Null and empty texts have none; every row keeps its own, repeated ones too. ``base`` tells
    matches of the patterns from what the field adds where it overlaps none of them.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(labelled))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), span_columns(text_spans(texts, field.value))], ["id", "spans"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def mask_pii(docs: DataFrame, labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; other columns stay."""
    field = docs.sparkSession.sparkContext.broadcast(train(labelled))
    place = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = text_spans([text or "" for text in texts], field.value)
            clean = [text if not spans else masked(text, spans) for text, spans in zip(texts, found)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(clean, batch.schema.field(place).type))

    return docs.mapInArrow(scan, docs.schema)


def masked(text: str, spans: list[tuple[str, int, int, str, bool]]) -> str:
    """The text with each span, or run of spans that overlap, replaced by ``[KIND]`` of the first."""
    parts, done = [], 0
    for kind, start, end, _, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(parts) + text[done:]
