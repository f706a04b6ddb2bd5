"""A linear-chain conditional random field in numpy: fitting and Viterbi over batches of sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    emit: np.ndarray  # (feature values, labels)
    step: np.ndarray  # (labels, labels): from, to
    first: np.ndarray  # (labels,)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Emission scores (..., labels) for feature values (..., features of a token); -1 is none."""
        return np.where(features[..., None] >= 0, self.emit[features], 0).sum(-2)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int, steps: int = 70, rate: float = 0.2, l2: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam over all sequences at once.

    features: (sequences, tokens, features of a token), labels: (sequences, tokens); rows behind
    a sequence's length are padding.
    """
    n, width, _ = features.shape
    model = Crf(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    inside = np.arange(width) < lengths[:, None]
    real = features[inside]
    gold_step, gold_first = np.zeros_like(model.step), np.zeros_like(model.first)
    token, place = np.nonzero(real >= 0)
    value = real[token, place].astype(np.int64)

    def counts(weights: np.ndarray) -> np.ndarray:
        """Sums of the tokens' label weights for each feature value."""
        return np.stack([np.bincount(value, weights[token, k], n_features) for k in range(n_labels)], 1)

    gold_emit = counts(np.eye(n_labels)[labels[inside]])
    both = inside[:, 1:]
    np.add.at(gold_step, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    np.add.at(gold_first, labels[:, 0], 1)
    parts = [model.emit, model.step, model.first]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, steps + 1):
        score = model.scores(features)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = model.first + score[:, 0]
        for i in range(1, width):
            new = _logsum(alpha[:, i - 1, :, None] + model.step, 1) + score[:, i]
            alpha[:, i] = np.where(inside[:, i, None], new, alpha[:, i - 1])
        total = _logsum(alpha[:, -1], 1)
        for i in range(width - 2, -1, -1):
            new = _logsum(model.step + (score[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(inside[:, i + 1, None], new, beta[:, i + 1])
        p = np.exp(alpha + beta - total[:, None, None])
        g_emit = counts(p[inside]) - gold_emit
        pair = np.exp(alpha[:, :-1, :, None] + model.step + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        g_step = pair[both].sum(0) - gold_step
        g_first = p[:, 0].sum(0) - gold_first
        for k, (part, grad) in enumerate(zip(parts, (g_emit, g_step, g_first), strict=True)):
            grad = grad / n + l2 * part
            m[k] += 0.1 * (grad - m[k])
            v[k] += 0.001 * (grad**2 - v[k])
            part -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def viterbi(model: Crf, features: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """Best labels (sequences, tokens); what lies behind a sequence's length means nothing.

    first: scores (sequences, labels) in place of the model's; last: labels that sequences end with.
    """
    n, width, _ = features.shape
    score = model.scores(features)
    back = np.zeros((n, width, score.shape[2]), np.int8)
    best = (model.first if first is None else first) + score[:, 0]
    keep = np.arange(score.shape[2], dtype=np.int8)
    for i in range(1, width):
        through = best[:, :, None] + model.step
        inside = (i < lengths)[:, None]
        back[:, i] = np.where(inside, through.argmax(1), keep)
        best = np.where(inside, through.max(1) + score[:, i], best)
    out = np.zeros((n, width), np.int8)
    out[:, -1] = best.argmax(1) if last is None else last
    for i in range(width - 1, 0, -1):
        out[:, i - 1] = np.take_along_axis(back[:, i], out[:, i, None].astype(np.int64), 1)[:, 0]
    return out


def _ways(model: Crf, features: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best scores (pieces, label before, last label) of whole pieces, entered by the scores `start` of the same shape."""
    score = model.scores(features).transpose(1, 2, 0)  # tokens, labels, pieces
    best = start.transpose(2, 1, 0) + score[0][:, None]  # label, label before, pieces
    for own in score[1:]:
        best = (best[:, None] + model.step[:, :, None, None]).max(0) + own[:, None]
    return best.transpose(2, 1, 0)


def viterbi_long(model: Crf, features: np.ndarray, piece: int, block: int) -> np.ndarray:
    """Best labels of one sequence (tokens, features of a token) of any length, as `viterbi` has them.

    Pieces are scored side by side, `block` at once, for each label before them. Chained, these
    scores give the labels at all borders, and between them each piece is decoded.
    """
    n, k = divmod(len(features), piece)
    whole, rest = features[: n * piece].reshape(n, piece, -1), features[n * piece :][None]
    start = np.broadcast_to(model.step, (n + (k > 0), *model.step.shape)).copy()
    start[0] = model.first
    ways = [_ways(model, whole[i : i + block], start[i : min(i + block, n)]) for i in range(0, n, block)]
    ways = np.concatenate(ways + [_ways(model, rest, start[n:])] * (k > 0))
    total, came = np.zeros(len(model.first)), []
    for way in ways:
        through = total[:, None] + way
        came.append(through.argmax(0))
        total = through.max(0)
    ends = [int(total.argmax())]
    for before in reversed(came):
        ends.append(int(before[ends[-1]]))
    ends = np.array(ends[::-1])
    first, last = start[np.arange(len(ways)), ends[:-1]], ends[1:]
    full = lambda m: np.full(m, piece)
    out = [viterbi(model, whole[i : i + block], full(len(whole[i : i + block])), first[i : min(i + block, n)], last[i : min(i + block, n)]).ravel() for i in range(0, n, block)]
    if k:
        out.append(viterbi(model, rest, np.array([k]), first[n:], last[n:])[0])
    return np.concatenate(out)
