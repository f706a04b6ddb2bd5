"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is a sentencepiece model of the merge type (BPE with byte fallback, identity
normalisation, white space as a mark before words). Encoding follows its agenda: the merge whose
piece has the best score is done first, the leftmost of equal ones, until none is left. With
dropout each candidate merge (a pair of neighbouring symbols at its place in a word) is skipped if
a hash of it, keyed by the seed, is below `dropout`; so a seed fixes one segmentation of a corpus
and each seed gives another. Dropout 0 gives the library's own ids.

No piece joins a mark with a character before it, so words are independent; equal words get equal
pieces under one seed. Words not seen yet are merged together, as arrays: every step does the best
merge of each word. Characters that no piece has become byte pieces.

White-space marks that a text holds itself are written as byte pieces, so that `decode` gives back
every text; only for those texts do the ids differ from the library's at dropout 0.

Longer words (`LONG_WORD`) are merged alone, with a heap as their agenda: n log n steps, and about
300 bytes for each of their characters.

Ids are packed in 16 bits, or 32 for models of more than 65,536 pieces.

Defined cases: null text is the empty text (no pieces). Rows with equal doc_id are encoded one by
one; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import text_arrays as ta
from tessera.llm import worker

MARK = "▁"
DROPOUT = 0.1
SEED = 1
CACHE_WORDS = 200_000
LONG_WORD = 2048
_UNITS = re.compile(r" +[^ ]*|[^ ]+")
_NONE = np.int32(2**31 - 1)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Vocabulary:
    """Pieces, and a hash table of the pairs of pieces that make another one."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.kind = "<u2" if n <= 1 << 16 else "<u4"
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_id = np.zeros(256, np.int32)
        self.byte_of = {}
        for i in range(n):
            if model.is_byte(i):
                b = int(self.pieces[i][1:-1], 16)
                self.byte_id[b] = i
                self.byte_of[i] = bytes([b])
        own = {self.pieces[i]: i for i in normal}
        if any(MARK in p.lstrip(MARK) for p in own):
            raise ValueError("a piece joins a mark with a character before it")
        self.char_id = {p: i for p, i in own.items() if len(p) == 1}
        # Any symbol may be a character without a piece; pairs are of pieces.
        pairs = [(own[p[:k]], own[p[k:]], i) for p, i in own.items() for k in range(1, len(p)) if p[:k] in own and p[k:] in own]
        order = sorted(normal, key=lambda i: (-model.get_score(i), i))
        # Equal scores share a rank, so that the leftmost of them comes first.
        rank, last, at = {}, None, -1
        for i in order:
            if model.get_score(i) != last:
                last, at = model.get_score(i), at + 1
            rank[i] = at
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self._bits = int(np.ceil(np.log2(4 * len(pairs))))
        size = 1 << self._bits
        self._keys, self._made, self._rank = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.full(size, _NONE, np.int32)
        key = left << 20 | right
        slot = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):  # each free slot takes one of the keys that want it; the others go on
            free = self._keys[slot[todo]] < 0
            first = np.unique(slot[todo][free], return_index=True)[1]
            put = todo[free][first]
            self._keys[slot[put]], self._made[slot[put]] = key[put], made[put]
            self._rank[slot[put]] = [rank[i] for i in made[put].tolist()]
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & (size - 1)
        self._longest = self._longest_run()

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """(rank, made piece) by key, for one look-up at a time."""
        some = np.flatnonzero(self._keys >= 0)
        return dict(zip(self._keys[some].tolist(), zip(self._rank[some].tolist(), self._made[some].tolist(), strict=True), strict=True))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (ta.mix(key.astype(np.uint64)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _longest_run(self) -> int:
        full = np.append(self._keys >= 0, self._keys >= 0)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], full.astype(np.int8), [0]])))
        return int((edges[1::2] - edges[::2]).max(initial=0)) + 1

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, made piece) of pairs; the rank of a pair that makes none is the largest number."""
        key = left.astype(np.int64) << 20 | right
        key = np.where((left < 0) | (right < 0), -2, key)
        slot = self._slot(key)
        rank, made = np.full(len(key), _NONE, np.int32), np.full(len(key), -1, np.int32)
        todo = np.flatnonzero(key >= 0)
        while len(todo):
            at = slot[todo]
            held = self._keys[at]
            hit = held == key[todo]
            rank[todo[hit]], made[todo[hit]] = self._rank[at[hit]], self._made[at[hit]]
            todo = todo[~hit & (held >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self._bits) - 1)
        return rank, made


class Encoder:
    """Texts to pieces' ids (packed), under one seed."""

    def __init__(self, model: str | Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.vocabulary = model if isinstance(model, Vocabulary) else Vocabulary(model)
        self._below = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        self._seed = ta.mix(np.array([seed], np.uint64))[0]
        self._now: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _dropped(self, word: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        place = start.astype(np.uint64) * _PLACE[0] + middle.astype(np.uint64) * _PLACE[1] + end.astype(np.uint64) * _PLACE[2]
        return ta.mix(ta.mix(word ^ self._seed) ^ place) < self._below

    def _merge_long(self, word: str) -> bytes:
        """Packed ids of one word of any length."""
        v, n = self.vocabulary, len(word)
        raw = np.frombuffer(word.encode(), np.uint8)
        key = ta.unit_hashes(raw, np.array([0]), np.array([len(raw)]))
        token = [v.char_id.get(MARK if c == " " else c, -1) if c != MARK else -1 for c in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def add(places: list[int]) -> None:
            """Put the merges of the symbols at these places with their next ones on the agenda."""
            some = []
            for left in places:
                middle = after[left]
                if middle < n and token[left] >= 0 and token[middle] >= 0:
                    hit = v.pairs.get(token[left] << 20 | token[middle])
                    if hit is not None:
                        some.append((hit[0], left, middle, after[middle]))
            if some and self._below:
                at = np.array(some)[:, 1:].T
                some = [x for x, off in zip(some, self._dropped(key, *at).tolist(), strict=True) if not off]
            for x in some:
                heapq.heappush(agenda, x)

        for at in range(0, n, 1 << 16):
            add(list(range(at, min(at + (1 << 16), n))))
        gone = bytearray(n)
        while agenda:
            _, left, middle, end = heapq.heappop(agenda)
            # An entry holds while both its symbols are as they were.
            if gone[left] or gone[middle] or after[left] != middle or after[middle] != end:
                continue
            token[left] = v.pairs[token[left] << 20 | token[middle]][1]
            gone[middle] = 1
            after[left] = end
            if end < n:
                before[end] = left
            add([left, before[left]] if before[left] >= 0 else [left])
        out: list[int] = []
        at = 0
        while at < n:
            out += [token[at]] if token[at] >= 0 else v.byte_id[list(word[at].encode())].tolist()
            at = after[at]
        return np.asarray(out, v.kind).tobytes()

    def _merge(self, words: list[str]) -> list[bytes]:
        """Packed ids of words, all of one length."""
        v, n, width = self.vocabulary, len(words), len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, width)
        known, back = np.unique(chars, return_inverse=True)
        ids = np.array([v.char_id.get(chr(c), -1) if c != ord(MARK) else -1 for c in known.tolist()], np.int32)
        # A word's own marks are spaces here; those of the text itself have no piece.
        ids = np.where(known == 32, v.char_id[MARK], ids)
        token = ids[back.reshape(n, width)].astype(np.int32)
        word = ta.Hasher(chars.ravel()).spans(np.arange(n) * width, np.arange(1, n + 1) * width)
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        alive = np.ones((n, width), bool)
        rank = np.full((n, width), _NONE, np.int32)
        made = np.full((n, width), -1, np.int32)

        def judge(rows: np.ndarray, left: np.ndarray) -> None:
            """Set the merge of the symbol at `left` with the next one."""
            middle = after[rows, left]
            there = middle < width
            rank[rows[~there], left[~there]] = _NONE
            rows, left, middle = rows[there], left[there], middle[there]
            r, m = v.look_up(token[rows, left], token[rows, middle])
            some = np.flatnonzero(r != _NONE)
            if self._below and len(some):
                off = self._dropped(word[rows[some]], left[some], middle[some], after[rows[some], middle[some]])
                r[some[off]] = _NONE
            rank[rows, left], made[rows, left] = r, m

        for k in range(width - 1):
            judge(np.arange(n), np.full(n, k))
        rows = np.arange(n)
        while len(rows):
            best = rank[rows].argmin(1)
            go = rank[rows, best] != _NONE
            rows, at = rows[go], best[go]
            if not len(rows):
                break
            gone = after[rows, at]
            token[rows, at] = made[rows, at]
            alive[rows, gone] = False
            rank[rows, gone] = _NONE
            further = after[rows, gone]
            after[rows, at] = further
            inner = further < width
            before[rows[inner], further[inner]] = at[inner]
            judge(rows, at)
            has = before[rows, at] >= 0
            judge(rows[has], before[rows[has], at[has]])
        unknown = (token < 0) & alive
        out = []
        plain = ~unknown.any(1)
        counts = alive.sum(1)
        flat = token[alive].astype(v.kind).tobytes()
        ends = (np.dtype(v.kind).itemsize * np.cumsum(counts)).tolist()
        at = 0
        for k, end in enumerate(ends):
            if plain[k]:
                out.append(flat[at:end])
            else:
                parts = []
                for i in np.flatnonzero(alive[k]).tolist():
                    parts += v.byte_id[list(words[k][i].encode())].tolist() if unknown[k, i] else [int(token[k, i])]
                out.append(np.asarray(parts, v.kind).tobytes())
            at = end
        return out

    def _encode(self, words: set[str]) -> dict[str, bytes]:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out: dict[str, bytes] = {}
        for length, group in by_length.items():
            if length > LONG_WORD:
                out |= {w: self._merge_long(w) for w in group}
                continue
            step = max(1, 400_000 // length)
            for i in range(0, len(group), step):
                out |= dict(zip(group[i : i + step], self._merge(group[i : i + step]), strict=True))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        # The mark before the first word is part of the encoding; an empty text has no pieces.
        units = [_UNITS.findall(" " + t) if t else [] for t in texts]
        flat = [u for row in units for u in row]
        got = list(map(self._now.get, flat))
        at = [i for i, x in enumerate(got) if x is None]
        if at:
            new = {flat[i] for i in at}
            held = {w: self._old[w] for w in new & self._old.keys()}
            found = held | self._encode(new - held.keys())
            for i in at:
                got[i] = found[flat[i]]
            if len(self._now) + len(found) > CACHE_WORDS:
                self._old, self._now = self._now, {}
            self._now |= {w: x for w, x in found.items() if len(w) <= 64}
        out, k = [], 0
        for row in units:
            out.append(b"".join(got[k : k + len(row)]))
            k += len(row)
        return out


class Decoder:
    """Packed ids back to texts."""

    def __init__(self, vocabulary: Vocabulary):
        byte = vocabulary.byte_of
        self._kind = vocabulary.kind
        self._bytes = [byte.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(vocabulary.pieces)]

    def __call__(self, packed: bytes) -> str:
        raw = b"".join(map(self._bytes.__getitem__, np.frombuffer(packed, self._kind).tolist()))
        return raw.decode("utf-8", errors="replace")[1:]


def _worker_copy(model: str, dropout: float, seed: int) -> tuple[Encoder, Decoder]:
    def make() -> tuple[Encoder, Decoder]:
        encoder = Encoder(model, dropout, seed)
        return encoder, Decoder(encoder.vocabulary)

    return worker.hold(("pieces", model, dropout, seed), make)


def encode(documents: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, ids) of each document; ids are little-endian unsigned numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _worker_copy(model, dropout, seed)
        width = np.dtype(encoder.vocabulary.kind).itemsize
        for part in ta.blocks(batches, limit=1 << 20):
            ids = encoder(ta.text_column(part).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_pieces", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _worker_copy(model, 0.0, 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decoder(x.as_py()) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless): each text encoded, decoded and compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _worker_copy(model, dropout, seed)
        width = np.dtype(encoder.vocabulary.kind).itemsize
        for part in ta.blocks(batches, limit=1 << 20):
            texts = ta.text_column(part).to_pylist()
            ids = encoder(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([decoder(x) == t if x else not t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "lossless"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
