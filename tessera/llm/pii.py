"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

Method. Base spans come from four patterns with checks. The field labels words (runs without
white space) as beginning or continuing an email address, IP address, card or phone number, from
features of their shapes: the shape with its digit counts, the shapes of both neighbours, the
number of digits, the first and last kind of character, and whether the digits of the word, or
of its run of all-digit words, pass the checks.
It is trained, in numpy, from a small labelled table (`labelled_table`, made here by a rule from
a few dozen templates, positive and negative), and decoded by Viterbi in batches of sequences.
A sequence is a neighbourhood of words with a digit or @: all others can't hold such data, and
their stretches aren't decoded. A stretch has no bound: a long one is decoded in pieces whose
scores are chained, with the labels that it has when decoded at once. A span that the field finds
is added unless it overlaps a base span or fails its kind's check; base spans always stay.

Defined cases: null text counts as empty (no spans). Positions count code points, ends are
exclusive. Rows with equal doc_id are read one by one; columns other than doc_id and text are
ignored by `find_pii`, whatever their names, and kept by `redact`. An empty table gives no rows.
Long texts, long words and long runs of digits or of address characters take linear time.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm import crf
from tessera.llm import text_arrays as ta
from tessera.llm import worker

KINDS = ("email", "ip", "card", "phone")

# What the base patterns consist of.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PARTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SOME = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, 0, done
        # Characters up to a failed @ can't take part in a later match.
        done = max(done, at + 1)
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[Span]:
    for m in _PARTS.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in four):
                yield at, 1, end
            at = end + 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, ordered by start, then kind."""
    found = list(_emails(text))
    if "." in text:
        found += _addresses(text)
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += ((m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15)
    return sorted(found)


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# The field ------------------------------------------------------------------------------------

FEATURES = 1 << 13
LABELS = 1 + 2 * len(KINDS)  # 0: none; 1 + 2k: a span of kind k begins; 2 + 2k: it goes on
NEIGHBOURS = 3


def _remembered(f):
    """f with a cache for words of usual length; longer ones are read each time."""
    cached = lru_cache(1 << 14)(f)
    return lambda word, *more: cached(word, *more) if len(word) <= 64 else f(word, *more)


@_remembered
def _shape(word: str) -> str:
    out: list[str] = []
    for c in word:
        k = "9" if "0" <= c <= "9" else "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else c
        if k in "aA" and out and out[-1] in "aA":
            continue
        out.append(k)
    return re.sub("9+", lambda m: f"d{min(len(m.group()), 20)}", "".join(out))


def _trim(word: str) -> tuple[int, int]:
    """Start and end of a word without the punctuation around it."""
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or word[a] in "+("):
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    if ")" in word and b < len(word) and word[b] == ")" and "(" in word[a:b]:
        b += 1
    return a, b


def _valid(kind: int, text: str) -> bool:
    """The check that a span of the field's has to pass."""
    d = _digits(text)
    if kind == 0:
        return "@" in text and "." in text.rpartition("@")[2]
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text)) and all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15


def _value(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


@_remembered
def _own_features(word: str) -> tuple[int, ...]:
    a, b = _trim(word)
    core = word[a:b]
    d = _digits(core)
    shape = _shape(core)
    return tuple(
        _value(x)
        for x in (
            f"shape {shape}",
            f"rough {re.sub('d[0-9]+', '9', shape)}",
            f"digits {min(len(d), 20)} {len(d) == len(core)}",
            f"luhn {12 <= len(d) <= 19 and luhn(d)} {12 <= len(d) <= 19}",
            f"ip {_valid(1, core)}",
            f"at {_valid(0, core)} {'@' in core}",
            f"ends {shape[:1]} {shape[-1:]}",
            f"plus {core[:1] == '+'} {core[:1] == '('}",
        )
    )


@_remembered
def _side_feature(word: str, side: str) -> int:
    a, b = _trim(word)
    shape = _shape(word[a:b])
    return _value(f"{side} {shape if 'd' in shape else 'word'}")


_DOUBLED = np.array([sum(divmod(2 * d, 10)) for d in range(10)])


def _card_groups(core: list[str]) -> Iterator[tuple[int, bool]]:
    """(words, do they pass the checks of a card) for the groups of a run of digit words: all that is
    left of the run if that passes, else the shortest group from where one begins, else one word."""
    n = len(core)
    place = np.concatenate([[0], np.cumsum([len(c) for c in core])])
    digits = np.frombuffer("".join(core).encode(), np.uint8) - 48
    # Luhn sums of any stretch from two prefix sums: the plain digits are those of the last one's parity.
    odd = np.arange(len(digits)) % 2 == 1
    sums = [np.concatenate([[0], np.cumsum(np.where(odd == last, digits, _DOUBLED[digits]))]) for last in (0, 1)]
    # Each of the words has a digit, so that more than 19 of them aren't a card.
    step = np.arange(1, 20)
    whole, first = np.zeros(n, bool), np.zeros(n, np.int64)
    for at in range(0, n, 1 << 15):
        k = np.arange(at, min(at + (1 << 15), n))
        end = k[:, None] + step
        low, high = place[k][:, None], place[np.minimum(end, n)]
        total = np.where(high % 2 == 1, sums[0][high] - sums[0][low], sums[1][high] - sums[1][low])
        fine = (end <= n) & (high - low >= 12) & (high - low <= 19) & (total % 10 == 0)
        whole[k] = (fine & (end == n)).any(1)
        inner = fine & (end < n)
        first[k] = np.where(inner.any(1), inner.argmax(1) + 1, 0)
    k = 0
    while k < n:
        size = n - k if whole[k] else int(first[k])
        yield max(size, 1), size > 0
        k += max(size, 1)


@lru_cache(8)
def _run_feature(found: bool, many: bool, digit: bool) -> int:
    return _value(f"run {found} {many} {digit}")


def _group_features(words: list[str]) -> list[int]:
    """For each word, is it in a group of all-digit words that passes the checks of a card: a whole
    run of them, or the shortest group from where one begins. Punctuation ends a run."""
    core = ["".join(w[slice(*_trim(w))].split("-")) for w in words]
    digits = [c.isascii() and c.isdigit() for c in core]
    out: list[int] = []
    while (k := len(out)) < len(words):
        stop = k
        while stop < len(words) and digits[stop] and (stop == k or words[stop - 1][-1:] in "0123456789"):
            stop += 1
        for size, found in _card_groups(core[k:stop]) if stop > k else [(1, False)]:
            out += [_run_feature(found, size > 1, digits[k])] * size
    return out


def _feature_rows(words: list[str]) -> Iterator[tuple[int, ...]]:
    around = ["", *words, ""]
    group = _group_features(words)
    return ((*_own_features(w), _side_feature(around[i], "before"), _side_feature(around[i + 2], "after"), group[i]) for i, w in enumerate(words))


def _features(words: list[str]) -> list[tuple[int, ...]]:
    return list(_feature_rows(words))


N_FEATURES = 11


def labelled_table(rows: int = 1000, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """(words, labels) of short invented sentences; kinds as in KINDS, and many near misses."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstuéö") for _ in range(r.randint(2, 9)))
    host = lambda: ".".join(w() for _ in range(r.randint(1, 2))) + r.choice([".com", ".org", ".net", ".example.com", ".de"])

    def card(valid: bool) -> str:
        while True:
            d = n(r.choice([13, 15, 16, 16, 16, 19]))
            if luhn(d) == valid:
                return d

    def grouped(d: str) -> str:
        return " ".join(d[i : i + 4] for i in range(0, len(d), 4))

    part = lambda: str(r.randint(0, 255))
    kinds = [
        (0, lambda: f"{w()}.{n(2)}@{host()}"), (0, lambda: f"{w()}@{host()}"), (0, lambda: f"<{w()}_{w()}@{host()}>"),
        (1, lambda: ".".join(part() for _ in range(4))), (1, lambda: ".".join(part() for _ in range(4))),
        (2, lambda: card(True)), (2, lambda: card(True)), (2, lambda: grouped(card(True))), (2, lambda: grouped(card(True)).replace(" ", "-")),
        (3, lambda: f"+{r.choice(['1', '44', '49'])} ({n(3)}) {n(3)}-{n(4)}"), (3, lambda: f"({n(3)}) {n(3)}-{n(4)}"), (3, lambda: f"{n(3)}-{n(3)}-{n(4)}"),
        (3, lambda: f"+{n(2)} {n(3)} {n(7)}"), (3, lambda: f"{n(3)}.{n(3)}.{n(4)}"), (3, lambda: f"1-{n(3)}-{n(3)}-{n(4)}"),
        (-1, lambda: card(False)), (-1, lambda: card(False)), (-1, lambda: grouped(card(False))), (-1, lambda: f"Version {n(1)}.{n(1)}"), (-1, lambda: f"version {n(1)}"),
        (-1, lambda: f"{n(1)}.{n(1)}.{n(1)}"), (-1, lambda: f"{r.randint(1900, 2099)}"), (-1, lambda: f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}"),
        (-1, lambda: f"{n(2)}:{n(2)}"), (-1, lambda: f"{n(2)}:{n(2)}:{n(2)}"), (-1, lambda: n(r.randint(1, 11))), (-1, lambda: n(r.randint(12, 24)) + w()), (-1, lambda: f"{n(3)}.{n(2)}"),
        (-1, lambda: f"{r.randint(256, 999)}.{part()}.{part()}.{r.randint(256, 999)}"), (-1, lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"'),
        (-1, lambda: f"@{w()}"), (-1, lambda: f"{w()}@{w()}"), (-1, lambda: f"{n(1)},{n(3)},{n(3)}"), (-1, lambda: f"{n(4)}-{n(4)}"), (-1, lambda: f"{n(3)}-{n(2)}"), (-1, lambda: f"{w()}{n(2)}"),
        (-1, lambda: f"{n(3)} {n(3)}"), (-1, lambda: f"{n(4)} {n(4)} {n(4)}"), (-1, lambda: f"{n(1)} {n(2)} {n(1)} {n(3)}"), (-1, lambda: f"{n(1)}-{n(2)}-{n(5)}-{n(1)}"),
    ]
    out = []
    for i in range(rows):
        words, labels = [], []
        for _ in range(r.randint(1, 2)):
            before = [w() for _ in range(r.randint(0, 3))]
            words += before
            labels += [0] * len(before)
            kind, make = kinds[i % len(kinds)] if r.random() < 0.6 else r.choice(kinds)
            pieces = make().split(" ")
            pieces[-1] += r.choice(["", "", "", ".", ",", "!!", "***", "###", "|"])
            words += pieces
            labels += [0] * len(pieces) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(pieces) - 1)
        after = [w() for _ in range(r.randint(0, 3))]
        out.append((words + after, labels + [0] * len(after)))
    return out


def _padded(sequences: list[list[tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    out = np.full((len(sequences), int(lengths.max()), N_FEATURES), -1, np.int32)
    for k, s in enumerate(sequences):
        out[k, : len(s)] = s
    return out, lengths


@lru_cache(1)
def train() -> crf.Crf:
    """The field fitted to the labelled table."""
    table = labelled_table()
    features, lengths = _padded([_features(words) for words, _ in table])
    labels = np.zeros(features.shape[:2], np.int64)
    for k, (_, own) in enumerate(table):
        labels[k, : len(own)] = own
    return crf.fit(features, labels, lengths, FEATURES, LABELS)


def neighbourhoods(text: str) -> list[list[tuple[int, int]]]:
    """Word spans in stretches around words with a digit or @."""
    out: list[list[tuple[int, int]]] = []
    before: deque[tuple[int, int]] = deque(maxlen=NEIGHBOURS)  # words since the last stretch
    wanted = gap = 0  # words that the last stretch still takes, and words since it
    for m in _WORD.finditer(text):
        span = m.span()
        if _SOME.search(text, *span):
            if out and gap <= NEIGHBOURS:
                out[-1] += [*before, span]
            else:
                out.append([*before, span])
            before.clear()
            wanted, gap = NEIGHBOURS, 0
        elif wanted:
            out[-1].append(span)
            wanted -= 1
        else:
            before.append(span)
            gap += 1
    return out


#: A stretch of more words is decoded in pieces of this size, whose scores are chained.
MAX_SEQUENCE = 256
DECODE_WORDS = 40_000


def _spans_of(text: str, s: list[tuple[int, int]], labels: list[int]) -> Iterator[Span]:
    """Valid spans among the labels of the words at s."""
    i = 0
    while i < len(s):
        if labels[i] % 2 == 1:
            kind, j = labels[i] // 2, i + 1
            while j < len(s) and labels[j] == labels[i] + 1:
                j += 1
            start, end = s[i][0], s[j - 1][1]
            a, b = _trim(text[start:end])
            if _valid(kind, text[start + a : start + b]):
                yield start + a, kind, start + b
            i = j
        else:
            i += 1


def field_spans(model: crf.Crf, texts: list[str]) -> list[list[Span]]:
    """Valid spans that the field finds in each text."""
    stretches: list[tuple[int, list[tuple[int, int]]]] = []
    found: list[list[Span]] = [[] for _ in texts]
    for row, text in enumerate(texts):
        for s in neighbourhoods(text):
            if len(s) <= MAX_SEQUENCE:
                stretches.append((row, s))
            else:
                rows = _feature_rows([text[a:b] for a, b in s])
                features = np.fromiter((x for f in rows for x in f), np.int32, len(s) * N_FEATURES).reshape(-1, N_FEATURES)
                labels = crf.viterbi_long(model, features, MAX_SEQUENCE, DECODE_WORDS // MAX_SEQUENCE // LABELS)
                found[row] += _spans_of(text, s, labels.tolist())
    stretches.sort(key=lambda s: len(s[1]))
    at = 0
    while at < len(stretches):
        to = at + 1
        while to < len(stretches) and (to - at + 1) * len(stretches[to][1]) <= DECODE_WORDS:
            to += 1
        some = stretches[at:to]
        features, lengths = _padded([_features([texts[row][a:b] for a, b in s]) for row, s in some])
        best = crf.viterbi(model, features, lengths)
        for (row, s), labels in zip(some, best.tolist(), strict=True):
            found[row] += _spans_of(texts[row], s, labels)
        at = to
    return found


def all_spans(model: crf.Crf, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, more in zip(texts, field_spans(model, texts), strict=True):
        base = base_spans(text)
        free = [s for s in more if all(s[2] <= b[0] or b[2] <= s[0] for b in base)] if base else more
        out.append((base, sorted(base + free)))
    return out


_PII_BYTES = np.zeros(256, bool)
_PII_BYTES[[*range(48, 58), ord("@")]] = True


def _spans_of_rows(model: crf.Crf, texts: pa.Array) -> list[tuple[list[Span], list[Span]]]:
    """As all_spans; rows without a digit or @ have none and aren't read as Python strings."""
    data, offsets = ta.utf8(texts)
    some = np.flatnonzero(ta.per_row(_PII_BYTES[data], offsets))
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
    for k, found in zip(some.tolist(), all_spans(model, texts.take(pa.array(some)).to_pylist()), strict=True):
        out[k] = found
    return out


SCHEMA = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", *(f"base_{k} long" for k in KINDS)])


def _counts(spans: list[list[Span]]) -> list[pa.Array]:
    """For each kind, how many of each text's spans are of it."""
    return [pa.array([sum(s[1] == k for s in own) for own in spans], pa.int64()) for k in range(len(KINDS))]


def find_pii(documents: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    """Counts over all spans, a digest of the base spans, all spans, and counts over the base spans, for each document."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for part in ta.blocks(batches):
            found = _spans_of_rows(model, ta.text_column(part))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), *_counts([every for _, every in found]),
                    pa.array([hashlib.sha256(render(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([render(every) for _, every in found], pa.string()), *_counts([base for base, _ in found]),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(f"base_{k}" for k in KINDS)],
            )

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind's mark."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    """The same rows and columns; personal data in text is replaced by marks (null stays null)."""
    model = model or train()
    names = documents.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for part in ta.blocks(batches):
            texts = ta.text_column(part)
            found = _spans_of_rows(model, texts)
            hit = np.array([bool(every) for _, every in found], bool)
            if hit.any():
                new = [redacted(t, every) for t, (_, every) in zip(texts.filter(pa.array(hit)).to_pylist(), (f for f in found if f[1]), strict=True)]
                column = pc.replace_with_mask(part.column(where).cast(pa.large_string()), pa.array(hit), pa.array(new, pa.large_string()))
                part = part.set_column(where, part.schema.field(where).name, column.cast(part.schema.field(where).type))
            yield part

    return documents.mapInArrow(run, documents.schema)
