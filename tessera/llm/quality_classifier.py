"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Method. Every word has a fixed sparse random index vector (a few +1 and -1, found by the word's
hash). The vector of a word is its own index vector plus the index vectors of its neighbours
in the training texts, normalised: words of like contexts point alike, and words never seen
still have their index vector. A second, smaller table gives vectors of a word's make (length,
capitals, symbols, digits, last character). A document pools its words: the mean vector, the mean
size of the step from each word to the next, and the same of the make vectors, with a
few ratios of repetition. A network with one hidden layer, in numpy, turns that into a logit;
its temperature is fitted on a part of the sample left out of the training, and the share of
classes is corrected to that of all labelled rows.

Labels are learnt from a bounded sample of rows that aren't held out (labelled.py); labels, lang,
source and doc_id are no inputs. Scores cover every whole text, in Arrow batches.

Defined cases: null and empty texts pool to zeros and get the score of those. Rows with equal
doc_id are scored one by one. `quality_scores` ignores columns other than doc_id and text, whatever
their names; `keep_rows` hands them on. An empty table gives no rows. A long text is pooled whole,
in windows, so that it needs about 50 bytes for each of its words. Without labels of both classes
every score is the share of label 1 (0.5 if there are no labels), in `keep_rows` too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import labelled
from tessera.llm import text_arrays as ta
from tessera.llm import worker

WORD_BITS, WORD_DIM = 16, 32
MAKE_BITS, MAKE_DIM = 11, 24
HIDDEN = 32
THRESHOLD = 0.3
SEED = 20

_KIND = np.zeros(256, np.uint8)  # of bytes: 0 others, 1 symbols, 2 capitals, 3 digits
_KIND[[ord(c) for c in "#*$%&|<>!=_~^{}[]\\/@"]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def index_vectors(bits: int, dim: int, seed: int, ones: int = 4) -> np.ndarray:
    """Sparse ternary vectors of unit length, one for each hash bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << bits, dim), np.float32)
    for k in range(ones):
        at = rng.integers(0, dim, 1 << bits)
        out[np.arange(1 << bits), at] = rng.choice(np.array([-1, 1], np.float32), 1 << bits)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def _makes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets of words' makes, for words that fill a window at most or for one word."""
    n, share = ends - starts, []
    for kind in (1, 2, 3):
        if len(data) > ta.BLOCK_BYTES:
            count = ta.row_counts(_KIND == kind, data, np.array([0, len(data)]))
        else:
            total = np.zeros(len(data) + 1, np.int32)
            np.cumsum(_KIND[data] == kind, out=total[1:], dtype=np.int32)
            count = total[ends] - total[starts]
        share.append((count > 0).astype(np.int64) + (count > 1) + (count == n))
    last = np.where(_KIND[data[ends - 1]] == 1, data[ends - 1], 0).astype(np.int64)
    make = ((np.minimum(n, 15) * 4 + share[0]) * 4 + share[1]) * 4 + share[2]
    return (ta.mix((make * 256 + last).astype(np.uint64)) >> np.uint64(64 - MAKE_BITS)).astype(np.int16)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, make buckets, word hashes, row offsets)."""
    data, offsets = ta.utf8(texts)
    starts, ends, by_row = ta.words(data, offsets)
    word = ta.unit_hashes(data, starts, ends, exact=False)
    make = [_makes(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]) for i, j in ta.windows(starts, ends)]
    return (word >> np.uint64(64 - WORD_BITS)).astype(np.int32), np.concatenate(make) if make else np.zeros(0, np.int16), word, by_row


@dataclass
class Model:
    words: np.ndarray
    makes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    shift: float = 0.0

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(standard(pooled, self.mean, self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(pooled) / self.temperature + self.shift, -40, 40)))


#: The pooled vector of a text of so many words counts half against the mean of all texts.
SHRINK_WORDS = 8


def standard(pooled: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised vectors; those of short texts, which say little, are drawn to the mean (0)."""
    return (pooled[:, :-1] - mean) / scale * pooled[:, -1:]


#: Words whose vectors are held at once.
_POOL_WORDS = 50_000


def pool(texts: pa.Array, words: np.ndarray, makes: np.ndarray) -> np.ndarray:
    """Pooled vectors of texts, (rows, 2 * WORD_DIM + 2 * MAKE_DIM + 3), and how much they count."""
    word, make, full, by_row = _words(texts)
    rows = len(by_row) - 1
    dims = words.shape[1] + makes.shape[1]
    sums, steps = np.zeros((rows, dims), np.float64), np.zeros((rows, dims), np.float64)
    row = ta.row_of(by_row)
    for at in range(0, len(word), _POOL_WORDS):
        to = min(at + _POOL_WORDS, len(word))
        # One word before the stretch, for the first step.
        low = max(at - 1, 0)
        v = np.concatenate([words[word[low:to]], makes[make[low:to]]], axis=1)
        own = row[at:to]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[cuts]] += np.add.reduceat(v[at - low :], cuts, axis=0)
        step = np.abs(np.diff(v, axis=0))
        of = row[low + 1 : to]
        step[row[low : to - 1] != of] = 0
        if len(of):
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            steps[of[cuts]] += np.add.reduceat(step, cuts, axis=0)
    count = np.diff(by_row)
    n = np.maximum(count, 1)[:, None]
    _, later = ta.repeated(ta.mix(full + row.astype(np.uint64) * np.uint64(0x9E3779B1)))
    same = np.zeros(len(full), bool)
    same[1:] = (full[1:] == full[:-1]) & (row[1:] == row[:-1])
    extra = np.stack([ta.per_row(later, by_row) / n[:, 0], ta.per_row(same, by_row) / n[:, 0], np.log1p(count) / 10, count / (count + SHRINK_WORDS)], 1)
    return np.concatenate([sums / n, steps / n, extra], axis=1)


def word_vectors(table: pa.Table | labelled.Sample, base: np.ndarray, window: int = 2, weight: float = 0.5) -> np.ndarray:
    """Index vectors plus the normalised sums of neighbours' index vectors in the table's texts."""
    context = np.zeros_like(base, dtype=np.float64)
    for part in ta.blocks(table.to_batches()):
        word, _, _, by_row = _words(ta.text_column(part))
        row = ta.row_of(by_row)
        for gap in range(1, window + 1):
            ok = row[gap:] == row[:-gap]
            a, b = word[gap:][ok], word[:-gap][ok]
            for x, y in ((a, b), (b, a)):
                order = np.argsort(x, kind="stable")
                cuts = np.flatnonzero(np.diff(x[order], prepend=-1))
                if len(cuts):
                    context[x[order][cuts]] += np.add.reduceat(base[y[order]], cuts, axis=0)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return (base + weight * context).astype(np.float32)


def fit(table: pa.Table | labelled.Sample, sizes: dict[int, int], steps: int = 400, seed: int = SEED) -> Model | None:
    """The model of a sample (doc_id, text, y); None unless both classes are in it."""
    y = np.asarray(table.column("y").to_pylist(), float)
    if len(y) == 0 or y.min() == y.max():
        return None
    words = word_vectors(table, index_vectors(WORD_BITS, WORD_DIM, seed))
    makes = index_vectors(MAKE_BITS, MAKE_DIM, seed + 1)
    x = np.concatenate([pool(ta.text_column(p), words, makes) for p in ta.blocks(table.to_batches())])
    rng = np.random.default_rng(seed)
    train = rng.permutation(len(y)) % 5 != 0
    if len(set(y[train])) < 2 or len(set(y[~train])) < 2:
        train[:] = True
    mean, scale = x[train, :-1].mean(0), x[train, :-1].std(0) + 1e-3
    m = Model(words, makes, mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1] - 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    z = standard(x, mean, scale)
    weight = np.where(y == 1, 0.5 / max(y[train].sum(), 1), 0.5 / max((1 - y[train]).sum(), 1)) * train
    parts = [m.w1, m.b1, m.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, steps + 1):
        h = np.tanh(z @ parts[0] + parts[1])
        err = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3][0], -40, 40))) - y) * weight
        back = err[:, None] * parts[2] * (1 - h**2)
        grads = [z.T @ back + 1e-4 * parts[0], back.sum(0), h.T @ err + 1e-4 * parts[2], np.array([err.sum()])]
        for k, g in enumerate(grads):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g**2 - second[k])
            parts[k] -= 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = parts[0], parts[1], parts[2], float(parts[3][0])
    test = ~train if not train.all() else train
    m.temperature = temperature(m.logit(x[test]), y[test])
    m.shift = float(np.log(sizes[1] / sizes[0]))  # the training weighs both classes alike
    return m


def temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits (1 or more) with the least balanced log loss, by search over a grid."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    grid = np.exp(np.linspace(0, np.log(16), 61))
    loss = [(weight * np.logaddexp(0, np.where(y == 1, -1, 1) * logit / t)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(documents: DataFrame, model: Model | None, otherwise: float = 0.5, threshold: float = THRESHOLD) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for part in ta.blocks(batches):
            texts = ta.text_column(part)
            p = model.probability(pool(texts, model.words, model.makes)) if model is not None else np.full(len(texts), otherwise)
            # crc32 of a missing id is that of the empty text.
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % labelled.HOLD_OUT == 0 for i in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.bool_()), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _share(sizes: dict[int, int]) -> float:
    """The score of every text where there is no model: the share of label 1."""
    known = sum(sizes.values())
    return sizes.get(1, 0) / known if known else 0.5


def quality_scores(documents: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, per_class: int = 1500, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    model, sizes = labelled.learn(fit, learn_from if learn_from is not None else documents, labels, "quality", per_class)
    return score(documents, model, _share(sizes), threshold)


def keep_rows(documents: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, per_class: int = 1500, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, all columns, with a score of threshold or more; no shuffle."""
    model, sizes = labelled.learn(fit, learn_from if learn_from is not None else documents, labels, "quality", per_class)
    if model is None:
        return documents if _share(sizes) >= threshold else documents.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for part in ta.blocks(batches):
            yield part.filter(pa.array(model.probability(pool(ta.text_column(part), model.words, model.makes)) >= threshold))

    return documents.mapInArrow(run, documents.schema)
