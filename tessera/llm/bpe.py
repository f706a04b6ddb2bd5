"""Byte-level BPE ids of whole texts, the same as the tokenizers library gives for a .json file.

The vocabulary is read from the .json file itself and its merges are run by tiktoken's engine,
which is several times faster on words that aren't in any cache; tests hold every id against
the tokenizers library. Texts are cut at safe boundaries only: before a space that stands
between two characters that aren't white space. There the file's splitting pattern always begins
a new match and looks at nothing beyond, so ids of the parts, joined, are the ids of the text.

Blocks of texts are cut, looked up and put together as arrays. A part of up to `KEY_BYTES` bytes
is its own key in a table of bounded size, so equal keys are equal parts; only parts not seen yet
are encoded, many in one call. Longer parts are encoded each time.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa

from tessera.llm import text_arrays as ta
from tessera.llm import worker

#: Parts of at most so many bytes are kept; a key is three 64-bit words, the last byte its length.
KEY_BYTES = 23
#: Slots of the table (32 bytes each); it's emptied when three fifths are taken.
SLOTS = 1 << 21
#: Texts are cut into windows of about so many bytes.
WINDOW = 1 << 20
#: What the splitting pattern comes to where there are no apostrophes and only single spaces.
WORD_PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
#: Parts that are encoded in one call, and their bytes.
CALL_PARTS, CALL_BYTES = 20_000, 1 << 20


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable bytes stand for
    themselves, the others for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def id_type(path: str) -> str:
    """The type of a file's packed ids: 16 bits, or 32 for vocabularies above 65,536 ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return "<u2" if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) < 1 << 16 else "<u4"


class ByteBpe:
    """Encoder for one tokenizer file; made once in each Python worker."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._ranks = {bytes(byte[c] for c in k): i for k, i in spec["model"]["vocab"].items() if k not in self.special}
        engine = lambda pattern: tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=self._ranks, special_tokens={})
        self._encoding, self._words = engine(public_tokenizers.PATTERN), engine(WORD_PATTERN)
        self.kind = "<u2" if max([*self._ranks.values(), *self.special.values()]) < 1 << 16 else "<u4"
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def begins_with_space(self) -> np.ndarray:
        """For each id, do its bytes begin with a space."""
        out = np.zeros(1 + max([*self._ranks.values(), *self.special.values()]), bool)
        out[[i for k, i in self._ranks.items() if k[:1] == b" "]] = True
        return out

    def has_special(self, text: str) -> bool:
        return self._split_special is not None and self._split_special.search(text) is not None

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text without special strings."""
        return self._encoding.encode_to_numpy(text, disallowed_special=())

    def words(self, text: str) -> np.ndarray:
        """As plain, for texts whose only white space is single spaces, and without apostrophes."""
        return self._words.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        """Ids of text; special strings in it become their own ids, as the library does by default."""
        if not self.has_special(text):
            return self.plain(text)
        parts = self._split_special.split(text)
        return np.concatenate([np.array([self.special[p]], np.uint32) if k % 2 else self.plain(p) for k, p in enumerate(parts)])


def white(data: np.ndarray) -> np.ndarray:
    """Bytes of characters that are white space to any of the libraries."""
    out = (data <= 32) & ((data == 32) | ((data >= 9) & (data <= 13)) | (data >= 28))
    if len(data) > 1 and (data >= 0xC2).any():
        two = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))
        out[two] = out[two + 1] = True
    if len(data) > 2 and (data >= 0xE1).any():
        a, b, c = data[:-2], data[1:-1], data[2:]
        some = np.flatnonzero((a >= 0xE1) & (a <= 0xE3))
        a, b, c = a[some], b[some], c[some]
        general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        other = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        at = some[general | other]
        out[at] = out[at + 1] = out[at + 2] = True
    return out


def safe_spaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of the spaces, inside rows, before which texts may be cut."""
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at + 1 < len(data))]
    if not len(at):
        return at
    blank = white(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    return at[~(blank[at - 1] | blank[at + 1] | edge[at] | edge[at + 1])]


_MASKS = np.array([[(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for k in range(3)] for n in range(KEY_BYTES + 1)], np.uint64)
_SHIFT = np.uint64(56)


class PartTable:
    """Ids of short parts, found by the parts' own bytes; open addressing in arrays."""

    def __init__(self, kind: str, slots: int = SLOTS):
        self._slots, self._kind = slots, kind
        self._shift = np.uint64(64 - (slots.bit_length() - 1))
        self.clear()

    def clear(self) -> None:
        self._rows = np.zeros((self._slots, 4), np.uint64)  # the key, and its part's number + 1
        self._starts, self._ids, self.size, self._used = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, self._kind), 0, 0

    def full(self, more: int) -> bool:
        return 5 * (self.size + more) > 3 * self._slots

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        return ta.mix(ta.mix(ta.mix(keys[:, 0]) + keys[:, 1]) + keys[:, 2])

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Number of each key's part; -1 if it isn't there."""
        out = np.full(len(keys), -1, np.int64)
        slot = (hashes >> self._shift).astype(np.int64)
        rows = self._rows[slot]
        there = rows[:, 3] > 0
        hit = there & (rows[:, 0] == keys[:, 0]) & (rows[:, 1] == keys[:, 1]) & (rows[:, 2] == keys[:, 2])
        out[hit] = rows[hit, 3].astype(np.int64) - 1
        todo = np.flatnonzero(there & ~hit)
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (self._slots - 1)
            rows = self._rows[slot]
            there = rows[:, 3] > 0
            hit = there & (rows[:, :3] == keys[todo]).all(1)
            out[todo[hit]] = rows[hit, 3].astype(np.int64) - 1
            go = there & ~hit
            todo, slot = todo[go], slot[go]
        return out

    def add(self, keys: np.ndarray, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Add parts that aren't there, with `ids` (counts[i] for each); their numbers."""
        n = len(keys)
        self._starts = _grown(self._starts, self.size + n + 1)
        self._ids = _grown(self._ids, self._used + len(ids))
        self._ids[self._used : self._used + len(ids)] = ids
        self._starts[self.size + 1 : self.size + n + 1] = self._used + np.cumsum(counts)
        number = self.size + np.arange(n)
        slot, todo = (hashes >> self._shift).astype(np.int64), np.arange(n)
        while len(todo):  # each free slot takes one of the keys that want it; the others go on
            free = self._rows[slot[todo], 3] == 0
            put = todo[free][np.unique(slot[todo][free], return_index=True)[1]]
            self._rows[slot[put], :3] = keys[put]
            self._rows[slot[put], 3] = number[put].astype(np.uint64) + np.uint64(1)
            left = np.ones(n, bool)
            left[put] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & (self._slots - 1)
        self.size, self._used = self.size + n, self._used + len(ids)
        return number

    def spans(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, number) of parts' ids in `ids`."""
        at = self._starts[numbers]
        return at, self._starts[numbers + 1] - at

    @property
    def ids(self) -> np.ndarray:
        return self._ids[: self._used]


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    if size <= len(a):
        return a
    out = np.zeros(max(size, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class Encoder:
    """Ids of texts of one tokenizer file."""

    def __init__(self, path: str, slots: int = SLOTS, window: int = WINDOW):
        self.bpe = ByteBpe(path)
        self.kind, self._window = self.bpe.kind, window
        self._begins = self.bpe.begins_with_space()
        self._table = PartTable(self.kind, slots)

    def packed(self, ids) -> bytes:
        """Ids as little-endian unsigned numbers of 16 bits, or 32 for larger vocabularies."""
        return np.asarray(ids, self.kind).tobytes()

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, numbers of ids, ids) of the parts data[starts:ends], in that order; a part that isn't a text's first has a space before it.

        A part with its space begins with the only id whose bytes begin with a space, unless the
        part itself holds spaces; so the ids of many parts, encoded as one text, come apart again.
        """

        def has(marked: np.ndarray) -> np.ndarray:
            upto = np.zeros(len(data) + 1, np.int32)
            np.cumsum(marked, out=upto[1:], dtype=np.int32)
            return upto[ends] > upto[starts]

        alone = first | has(data == 32)
        plain = ~has(white(data) | (data == 39))
        order, counts, out = [], [], []
        for k in np.flatnonzero(alone).tolist():
            out.append(self._alone(data, starts[k], ends[k], first[k]))
            order.append([k])
            counts.append([len(out[-1])])
        for group, encode in ((np.flatnonzero(~alone & plain), self.bpe.words), (np.flatnonzero(~alone & ~plain), self.bpe.plain)):
            upto = np.cumsum(ends[group] - starts[group] + 1)
            k = 0
            while k < len(group):
                base = upto[k - 1] if k else 0
                to = min(max(k + 1, int(np.searchsorted(upto, base + CALL_BYTES, "right"))), k + CALL_PARTS)
                n, ids = self._joined(data, starts[group[k:to]], ends[group[k:to]], encode)
                order.append(group[k:to])
                counts.append(n)
                out.append(ids)
                k = to
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        return np.concatenate(order), np.concatenate(counts), np.concatenate(out)

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids) of parts, each behind a space, in one call."""
        size = ends - starts + 1
        upto = np.cumsum(size)
        source = np.repeat(starts - 1 - (upto - size), size) + np.arange(upto[-1])
        source[upto - size] = 0
        joined = data[source]
        joined[upto - size] = 32
        text = joined.tobytes().decode()
        if self.bpe.has_special(text):
            each = [self._alone(data, a, b, False) for a, b in zip(starts, ends, strict=True)]
            return np.array([len(x) for x in each], np.int64), np.concatenate(each)
        ids = encode(text)
        at = np.flatnonzero(self._begins[ids])
        if len(at) != len(starts):
            raise RuntimeError("parts' ids don't come apart")
        return np.diff(at, append=len(ids)), ids

    def _alone(self, data: np.ndarray, start: int, end: int, first: bool) -> np.ndarray:
        return self.bpe.encode(("" if first else " ") + data[start:end].tobytes().decode())

    def _ids(self, data: np.ndarray, offsets: np.ndarray, continued: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids by row, ids of all rows); `continued`: the only row goes on behind a safe space."""
        cuts = safe_spaces(data, offsets)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        heads = offsets[filled]
        starts = np.sort(np.concatenate([heads, cuts + 1]))
        ends = np.sort(np.concatenate([offsets[filled + 1], cuts]))
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, self.kind)
        by_row = np.searchsorted(starts, offsets)
        first = np.zeros(len(starts), bool)
        if not continued:
            first[np.searchsorted(starts, heads)] = True
        size = ends - starts
        place, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short, extra = np.flatnonzero(size <= KEY_BYTES), np.zeros(0, self.kind)
        if len(short):
            padded = np.concatenate([data, np.zeros(24, np.uint8)])
            keys = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 24), (1, 1))[starts[short]].view("<u8")
            keys &= _MASKS[size[short]]
            keys[:, 2] |= (size[short] | first[short] << 7).astype(np.uint64) << _SHIFT
            hashes = self._table.hashes(keys)
            number = self._table.find(keys, hashes)
            missing = np.flatnonzero(number < 0)
            if len(missing):
                order = missing[np.argsort(hashes[missing], kind="stable")]
                new = np.ones(len(order), bool)
                new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
                one = order[new]
                if self._table.full(len(one)) and self._table.size:
                    self._table.clear()
                    return self._ids(data, offsets, continued)
                at = short[one]
                done, n, ids = self._encode(data, starts[at], ends[at], first[at])
                made = np.zeros(len(one), np.int64)
                made[done] = self._table.add(keys[one[done]], hashes[one[done]], n, ids)
                number[order] = made[np.cumsum(new) - 1]
            place[short], counts[short] = self._table.spans(number)
        long = np.flatnonzero(size > KEY_BYTES)
        if len(long):
            done, n, ids = self._encode(data, starts[long], ends[long], first[long])
            counts[long[done]] = n
            place[long[done]] = len(self._table.ids) + np.cumsum(n) - n
            extra = ids.astype(self.kind)
        upto = np.cumsum(counts)
        source = np.repeat(place - (upto - counts), counts) + np.arange(upto[-1])
        pool = np.concatenate([self._table.ids, extra]) if len(extra) else self._table.ids
        return np.diff(np.concatenate([[0], upto])[by_row]), pool[source]

    def _long(self, data: np.ndarray):
        """Ids of one long text, window by window."""
        at, n = 0, len(data)
        while at < n:
            size = self._window
            to = n
            while at + size < n:
                cuts = safe_spaces(data[at : at + size], np.array([0, min(size, n - at)]))
                if len(cuts):
                    to = at + int(cuts[-1])
                    break
                size *= 2
            yield self._ids(data[at:to], np.array([0, to - at]), at > 0)[1]
            at = to + 1

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Numbers of ids of a large_string array."""
        data, offsets = ta.utf8(texts)
        if len(texts) == 1 and len(data) > 2 * self._window:
            return np.array([sum(map(len, self._long(data)))], np.int64)
        return self._ids(data, offsets)[0]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids by row, ids of all rows, packed) of a large_string array."""
        data, offsets = ta.utf8(texts)
        if len(texts) == 1 and len(data) > 2 * self._window:
            ids = np.concatenate(list(self._long(data)))
            return np.array([len(ids)], np.int64), ids
        return self._ids(data, offsets)


def worker_copy(path: str) -> Encoder:
    """The encoder of a Python worker for this file."""
    return worker.hold(("bpe", path), lambda: Encoder(path))
