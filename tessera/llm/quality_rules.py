"""Quality rules: exact text statistics, and a calibrated logistic regression on hashed n-grams.

Method: words, word pairs and character 3- and 5-grams are hashed into four weight tables; a
document's logit is the sum, over the tables, of the mean weight of its n-grams, plus three
structural ratios and a bias. Weights are learnt on a bounded sample of labelled rows, the
probability is calibrated (Platt) on a part of the sample left out of the fit, and rows are
scored in Arrow batches against a fixed threshold.

Defined cases: null text counts as the empty text (all counts 0, base_failed). Rows with equal
doc_id are scored one by one. `quality_rules` ignores columns other than doc_id and text, whatever
their names; `keep_rows` hands them on. An empty table gives no rows. A long text is taken whole,
in windows, so that it needs about 50 bytes for each of its words. Without labels of both classes
there is no model, and the base rules alone decide.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import labelled
from tessera.llm import text_arrays as ta
from tessera.llm import worker

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TABLE_BITS = 16
FAMILIES = ("word", "word pair", "3 characters", "5 characters")
DENSE = ("repeated words", "repeated lines", "capitals")
#: Documents with a calibrated probability of label 1 below this are rejected.
THRESHOLD = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_SAME = np.uint64(12345)


#: Words of one long text whose features are made at once.
_STEP = 1 << 17
_LINE = np.arange(256) != 10
#: Features of the sample that are held at once in learning (or those of one block of texts), 12 bytes each, and 40 more while a step uses them.
FEATURES = 1 << 18


@dataclass
class Block:
    """What the rules and the model need of one block of texts."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    dense: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    words: np.ndarray  # hashes
    by_row: np.ndarray

    def ngrams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(family, buckets, row offsets), in one piece for each family or, for one row, in several."""
        shift = np.uint64(64 - TABLE_BITS)
        if len(self.offsets) == 2:
            for at in range(0, len(self.words), _STEP):
                some = self.words[at : at + _STEP + 1]
                for f, keys in ((0, some[:_STEP]), (1, _pairs(some[:-1], some[1:]))):
                    yield f, (keys >> shift).astype(np.int32), np.array([0, len(keys)])
            for f, n in ((2, 3), (3, 5)):
                for points, many in ta.point_windows(self.data, n):
                    at = np.arange(many)
                    yield f, (ta.Hasher(points, exact=False).spans(at, at + n) >> shift).astype(np.int32), np.array([0, many])
            return
        yield 0, (self.words >> shift).astype(np.int32), self.by_row
        row = ta.row_of(self.by_row)
        inner = np.flatnonzero(row[1:] == row[:-1])
        yield 1, (_pairs(self.words[inner], self.words[inner + 1]) >> shift).astype(np.int32), _offsets(np.maximum(np.diff(self.by_row) - 1, 0))
        points, place = ta.code_points(self.data, self.offsets)
        hasher, sizes = ta.Hasher(points, exact=False), np.diff(place)
        for f, n in ((2, 3), (3, 5)):
            counts = np.maximum(sizes - n + 1, 0)
            offs = _offsets(counts)
            at = np.arange(offs[-1]) + np.repeat(place[:-1] - offs[:-1], counts)
            yield f, (hasher.spans(at, at + n) >> shift).astype(np.int32), offs


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of word pairs; a word followed by itself is one feature, whatever the word."""
    return np.where(a == b, _SAME << np.uint64(48), ta.mix(a * np.uint64(3) + b))


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _repeat_words(word: np.ndarray, by_row: np.ndarray) -> np.ndarray:
    """Words of each row in 3-word windows that the row has twice or more."""
    triple = np.zeros(len(word), bool)
    if len(word) > 2:
        one_row = len(by_row) == 2
        row = np.broadcast_to(np.uint64(0), len(word)) if one_row else ta.row_of(by_row).astype(np.uint64)
        key = np.empty(len(word) - 2, np.uint64)
        for at in range(0, len(key), _STEP):
            w, r = word[at : at + _STEP + 2], row[at : at + _STEP]
            r = r[: len(w) - 2]
            key[at : at + _STEP] = ta.mix(ta.mix(ta.mix(w[:-2] + r * np.uint64(0x51ED270B)) + w[1:-1]) + w[2:])
        if one_row:
            twice, _ = ta.repeated(key)
            hit = np.flatnonzero(twice)
        else:
            at = np.flatnonzero(row[:-2] == row[2:])
            hit = at[ta.repeated(key[at])[0]]
        for shift in (0, 1, 2):
            triple[hit + shift] = True
    return np.add.reduceat(np.append(triple, False), by_row[:-1], dtype=np.int64) * (np.diff(by_row) > 0)


def analyse(texts: pa.Array) -> Block:
    data, offsets = ta.utf8(texts)
    starts, ends, by_row = ta.words(data, offsets)
    n_words = np.diff(by_row)
    word = ta.unit_hashes(data, starts, ends)
    n_repeat = _repeat_words(word, by_row)

    line_starts, line_ends, lines_by_row = ta.runs(_LINE, data, offsets)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    full = np.flatnonzero(has_word)
    line_row = ta.row_of(lines_by_row).astype(np.uint64)[full]
    _, later = ta.repeated(ta.mix(ta.unit_hashes(data, line_starts[full], line_ends[full]) + line_row * np.uint64(0x2545F491)))
    dup = np.zeros(len(line_starts), bool)
    dup[full[later]] = True
    n_dup = ta.per_row(dup, lines_by_row)

    chars = np.maximum(ta.row_counts(ta.LEAD, data, offsets), 1)
    dense = np.stack([n_repeat / np.maximum(n_words, 1), n_dup / np.maximum(ta.per_row(has_word, lines_by_row), 1), ta.row_counts(ta.CAPITAL, data, offsets) / chars], axis=1)
    return Block(n_words, ta.row_counts(ta.LEAD & ~ta.SPACE, data, offsets), ta.row_counts(_SYMBOL, data, offsets), n_dup, n_repeat, dense, data, offsets, word, by_row)


@dataclass
class Model:
    tables: np.ndarray  # (families, 2 ** TABLE_BITS)
    dense: np.ndarray
    bias: float
    slope: float = 1.0  # of the calibration
    shift: float = 0.0

    def probability(self, block: Block) -> np.ndarray:
        sums, counts = np.zeros((2, len(FAMILIES), len(block.n_words)))
        for f, buckets, offs in block.ngrams():
            sums[f] += ta.per_row(self.tables[f][buckets], offs, np.float64)
            counts[f] += np.diff(offs)
        logit = self.bias + block.dense @ self.dense + (sums / np.maximum(counts, 1)).sum(0)
        return sigmoid(self.slope * logit + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Features:
    """Sparse features (row, column, value) in runs of whole documents; all but a single run wait in a temporary file of the driver's."""

    def __init__(self):
        self._now, self._size, self._runs, self._file = [], 0, [], None

    def add(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> None:
        if self._now and self._size + len(rows) > FEATURES:
            self._put()
        self._now.append((rows.astype(np.int32), columns.astype(np.int32), values.astype(np.float32)))
        self._size += len(rows)

    def _put(self) -> None:
        self._file = self._file or tempfile.TemporaryFile()
        for arrays in zip(*self._now, strict=True):
            for a in arrays:
                a.tofile(self._file)
        self._runs.append(self._size)
        self._now, self._size = [], 0

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self._file is None:
            if not self._now:
                return
            self._now = [tuple(np.concatenate(arrays) for arrays in zip(*self._now, strict=True))]
            yield self._now[0]
            return
        if self._now:
            self._put()
        self._file.seek(0)
        for n in self._runs:
            yield tuple(np.fromfile(self._file, kind, n) for kind in (np.int32, np.int32, np.float32))


def fit(table: pa.Table | labelled.Sample, sizes: dict[int, int], steps: int = 60, seed: int = 7) -> Model | None:
    """The model for a sample (doc_id, text, y); None unless both classes are in it."""
    y = np.asarray(table.column("y").to_pylist(), float)
    if len(y) == 0 or y.min() == y.max():
        return None
    features, dense = _Features(), []
    at = 0
    for part in ta.blocks(table.to_batches()):
        block = analyse(ta.text_column(part))
        pieces = list(block.ngrams())
        count = np.zeros((len(FAMILIES), part.num_rows))
        for f, _, offs in pieces:
            count[f] += np.diff(offs)
        rows, cols, values = [], [], []
        for f, buckets, offs in pieces:
            key, n = np.unique(ta.row_of(offs).astype(np.int64) << TABLE_BITS | buckets, return_counts=True)
            r = key >> TABLE_BITS
            rows.append((r + at).astype(np.int32))
            cols.append(((key & ((1 << TABLE_BITS) - 1)) + (f << TABLE_BITS)).astype(np.int32))
            values.append((n / count[f][r]).astype(np.float32))
        if rows:  # a text without words or characters has none
            features.add(np.concatenate(rows), np.concatenate(cols), np.concatenate(values))
        dense.append(block.dense)
        at += part.num_rows
    d = np.concatenate(dense)
    fitted = np.random.default_rng(seed).permutation(len(y)) % 4 != 0
    if len(set(y[fitted])) < 2 or len(set(y[~fitted])) < 2:
        fitted[:] = True
    weight = np.where(y == 1, 0.5 / max(y[fitted].sum(), 1), 0.5 / max((1 - y[fitted]).sum(), 1)) * fitted
    n_cols = len(FAMILIES) << TABLE_BITS
    w, wd, b = np.zeros(n_cols), np.zeros(d.shape[1]), 0.0
    state = [np.zeros(n_cols), np.zeros(n_cols), np.zeros(d.shape[1] + 1), np.zeros(d.shape[1] + 1)]
    for step in range(1, steps + 1):
        sums, g = np.zeros(len(y)), np.zeros(n_cols)
        for r, c, v in features:
            own = np.bincount(r, v * w[c], len(y))
            err = (sigmoid(own + d @ wd + b) - y) * weight
            np.add.at(g, c, v * err[r])  # one after another, so that the sums don't depend on how features are held
            sums += own
        err = (sigmoid(sums + d @ wd + b) - y) * weight
        g += 1e-6 * w
        gd = np.append(d.T @ err, err.sum())
        for k, (grad, rate) in enumerate(((g, 0.5), (gd, 0.3))):
            m, s = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            s += 0.01 * (grad**2 - s)
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
            if k:
                wd -= move[:-1]
                b -= move[-1]
            else:
                w -= move
    logit = sum((np.bincount(r, v * w[c], len(y)) for r, c, v in features), np.zeros(len(y))) + d @ wd + b
    test = ~fitted if not fitted.all() else fitted
    slope, shift = platt(logit[test], y[test], sizes)
    return Model(w.reshape(len(FAMILIES), -1).astype(np.float32), wd, b, slope, shift)


def platt(logit: np.ndarray, y: np.ndarray, sizes: dict[int, int], steps: int = 200) -> tuple[float, float]:
    """Slope and shift that turn logits into probabilities at the classes' own shares (sizes)."""
    share = sizes[1] / (sizes[0] + sizes[1])
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    soft = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):  # Newton on two parameters, damped
        p = sigmoid(a * logit + b)
        g = np.array([((p - soft) * weight * logit).sum(), ((p - soft) * weight).sum()])
        h = p * (1 - p) * weight
        hess = np.array([[(h * logit**2).sum(), (h * logit).sum()], [(h * logit).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, g)
        move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-12))
        a, b = a - move[0], b - move[1]
    return float(a), float(b)


def base_failed(block: Block) -> np.ndarray:
    return (block.n_words < MIN_WORDS) | (100 * block.n_repeat_words > MAX_REPEAT_PERCENT * block.n_words)


def verdict(block: Block, model: Model | None, threshold: float) -> np.ndarray:
    """Is the document kept."""
    return ~base_failed(block) & (model.probability(block) >= threshold if model is not None else True)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def score(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row of statistics and verdicts per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for part in ta.blocks(batches):
            block = analyse(ta.text_column(part))
            failed = base_failed(block)
            p = model.probability(block) if model is not None else np.ones(len(failed))
            yield pa.RecordBatch.from_arrays(
                [part.column(0)] + [pa.array(x) for x in (block.n_words, block.word_chars, block.n_symbols, block.n_dup_lines, block.n_repeat_words, failed, ~failed & (p >= threshold), p)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def quality_rules(documents: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, per_class: int = 1000, threshold: float = THRESHOLD) -> DataFrame:
    """Statistics and verdicts of `documents`; labelled rows of `learn_from` (itself, if None) train the model."""
    model, _ = labelled.learn(fit, learn_from if learn_from is not None else documents, labels, "quality", per_class)
    return score(documents, model, threshold)


def keep_rows(documents: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, per_class: int = 1000, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, all columns, that are kept; no shuffle."""
    model, _ = labelled.learn(fit, learn_from if learn_from is not None else documents, labels, "quality", per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for part in ta.blocks(batches):
            block = analyse(ta.text_column(part))
            yield part.filter(pa.array(verdict(block, model, threshold)))

    return documents.mapInArrow(run, documents.schema)
