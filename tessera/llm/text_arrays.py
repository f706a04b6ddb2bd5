"""Vectorised text primitives over the UTF-8 buffers of Arrow string columns.

A block is a run of rows whose texts together hold about `BLOCK_BYTES`; one long text may
exceed that and then forms a block of its own, whose words and characters are taken in windows
of that size. So what is held beyond a text itself are a few numbers for each of its words.
Everything below works on a block or window at once: no Python loop over rows, words or
characters.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that begin a character.
LEAD = (np.arange(256) & 0xC0) != 0x80
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as 64-bit-offset strings; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.large_string()), "")


def blocks(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, cut so that a block's texts hold about `limit` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(text_column(batch, name)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; offsets has one entry more than there are rows."""
    _, offs, data = texts.buffers()
    n = len(texts)
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points)."""
    before = np.zeros(len(data) + 1, np.int32)
    np.cumsum(LEAD[data], out=before[1:], dtype=np.int32)
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), before[offsets].astype(np.int64)


def point_windows(data: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, int]]:
    """(code points, how many n-grams begin in the window) of one text, n - 1 more points at its end."""
    at = 0
    while at < len(data):
        to, upto = min(at + BLOCK_BYTES, len(data)), min(at + BLOCK_BYTES + 4 * n, len(data))
        while to < len(data) and not LEAD[data[to]]:
            to += 1
        while upto < len(data) and not LEAD[data[upto]]:
            upto += 1
        points = np.frombuffer(data[at:upto].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        yield points, min(int(np.count_nonzero(LEAD[data[at:to]])), max(len(points) - n + 1, 0))
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PRIME = np.uint64((1 << 31) - 1)
_SMALL, _SMALL_INVERSE = 0x2545F491, pow(0x2545F491, -1, (1 << 31) - 1)


def _powers_of(base: int, size: int) -> np.ndarray:
    """Powers of a base modulo the prime."""
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), int(_PRIME))) % _PRIME])
    return out[:size]


@functools.cache
def _power_tables() -> tuple[np.ndarray, ...]:
    """Powers of both bases and their inverses, for the positions of a window."""
    size = BLOCK_BYTES + 4096
    wide = []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        wide.append(np.cumprod(steps, dtype=np.uint64))
    return wide[0], wide[1], _powers_of(_SMALL, size), _powers_of(_SMALL_INVERSE, size)


class Hasher:
    """Hashes of any substrings of one array of at most a window from prefix sums.

    The sums are polynomials modulo 2**64 and, if `exact`, also modulo a prime: modulo a power of
    two some long strings (Thue-Morse's) collide whatever the base. Without `exact` the hashes do
    for feature buckets only.
    """

    def __init__(self, symbols: np.ndarray, exact: bool = True):
        powers, self._inverse, small, self._small_inverse = _power_tables()
        symbols = symbols.astype(np.uint64) + np.uint64(1)
        self._prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * powers[: len(symbols)], out=self._prefix[1:])
        self._second = None
        if exact:
            part = symbols * small[: len(symbols)]  # 22 and 31 bits
            part = (part & _PRIME) + (part >> np.uint64(31))
            self._second = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum(part, out=self._second[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = mix((self._prefix[ends] - self._prefix[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))
        if self._second is not None:
            second = (self._second[ends] - self._second[starts]) % _PRIME * self._small_inverse[starts] % _PRIME
            out = mix(out + second * np.uint64(0xD6E8FEB86659FD93))
        return out


def windows(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(i, j): units starts[i:j] to ends[i:j] lie within `BLOCK_BYTES`, or are one longer unit."""
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        yield i, j
        i = j


def unit_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool = True) -> np.ndarray:
    """Hashes of data[starts:ends], units in order that don't overlap; a unit's hash depends on its bytes alone."""
    out = np.empty(len(starts), np.uint64)
    for i, j in windows(starts, ends):
        base, top = starts[i], ends[j - 1]
        if top - base > BLOCK_BYTES:
            out[i] = int.from_bytes(hashlib.blake2b(data[base:top], digest_size=8).digest(), "little")
        else:
            out[i:j] = Hasher(data[base:top], exact).spans(starts[i:j] - base, ends[i:j] - base)
    return out


def runs(inside: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are true in the table `inside` (256) and don't cross a row: (starts, ends, run offsets by row)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    if len(offsets) == 2:
        # One row: changes of what is inside, window by window.
        at, last, edges = 0, False, []
        while at < n:
            part = inside[data[at : at + BLOCK_BYTES]]
            edges.append(at + np.flatnonzero(np.diff(part, prepend=last)))
            last, at = bool(part[-1]), at + BLOCK_BYTES
        edges = np.concatenate([*edges, np.full(int(last), n)])
        return edges[0::2], edges[1::2], np.array([0, len(edges) // 2])
    own = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1] | cut[1:n]
    last[:-1] &= ~own[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than the six separators; UTF-8's other bytes are all word bytes."""
    return runs(~SPACE, data, offsets)


def row_counts(marked: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are true in the table `marked` (256)."""
    if len(offsets) == 2:
        return np.array([sum(int(np.count_nonzero(marked[data[at : at + BLOCK_BYTES]])) for at in range(0, len(data), BLOCK_BYTES))], np.int64)
    return per_row(marked[data], offsets)


def per_row(values: np.ndarray, offsets: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]; empty rows give 0."""
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:], dtype=kind)
    return total[offsets[1:]] - total[offsets[:-1]]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each element the index of its row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the key there twice or more, is there an equal key earlier) for each element."""
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    # Many keys are taken in parts by their leading bits, so that what is sorted at once is bounded.
    bits = max(len(keys) >> 20, 0).bit_length()
    for part in range(1 << bits):
        some = np.flatnonzero(keys >> np.uint64(64 - bits) == part) if bits else slice(None)
        own = keys[some]
        order = np.argsort(own, kind="stable")
        same = np.zeros(len(own), bool)
        same[1:] = own[order][1:] == own[order][:-1]
        both = same.copy()
        both[:-1] |= same[1:]
        back = np.empty(len(own), bool)
        back[order] = same
        later[some] = back
        back[order] = both
        twice[some] = back
    return twice, later


def with_columns(batch: pa.RecordBatch, names: list[str], arrays: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """The named columns of batch followed by arrays, as schema says."""
    cols = [batch.column(batch.schema.get_field_index(n)) for n in names] + [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays.values()]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, schema, strict=True)], schema=schema)
