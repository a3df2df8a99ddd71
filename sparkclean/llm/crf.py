"""A linear-chain conditional random field over dense features, and its Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass(frozen=True)
class Crf:
    """Weights of ``emission`` (features x labels), ``transition`` (label to next label) and ``first`` label."""

    emission: np.ndarray
    transition: np.ndarray
    first: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features @ self.emission

    def decode(self, scores: np.ndarray) -> list[int]:
        """The most likely labels for the emission ``scores`` of one sequence; ties go to the smaller label."""
        if not len(scores):
            return []
        labels = range(len(self.first))
        change = self.transition.tolist()
        rows = scores.tolist()
        best = [a + b for a, b in zip(rows[0], self.first.tolist())]
        back = []
        for row in rows[1:]:
            came = [max(labels, key=lambda i, j=j: best[i] + change[i][j]) for j in labels]
            best = [best[came[j]] + change[came[j]][j] + row[j] for j in labels]
            back.append(came)
        path = [max(labels, key=best.__getitem__)]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]


def marginals(model: Crf, x: np.ndarray) -> np.ndarray:
    """The probability of each label at each item of one sequence."""
    e = model.scores(x)
    fore, aft = np.zeros(e.shape), np.zeros(e.shape)
    for t in range(len(e)):
        fore[t] = e[t] + (model.first if t == 0 else _logsumexp(fore[t - 1][:, None] + model.transition, 0))
    for t in range(len(e) - 2, -1, -1):
        aft[t] = _logsumexp(model.transition + (e[t + 1] + aft[t + 1])[None, :], 1)
    both = fore + aft
    return np.exp(both - _logsumexp(both, 1)[:, None]) if len(e) else both


def _gradient(model: Crf, x: np.ndarray, y: np.ndarray, used: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Log likelihood of weighted sequences padded to one length, and its gradient; ``used`` marks real items."""
    e = x @ model.emission
    n, steps, k = e.shape
    fore, aft = np.zeros((steps, n, k)), np.zeros((steps, n, k))
    fore[0] = e[:, 0] + model.first
    for t in range(1, steps):
        step = _logsumexp(fore[t - 1][:, :, None] + model.transition, 1) + e[:, t]
        fore[t] = np.where(used[:, t, None], step, fore[t - 1])
    for t in range(steps - 2, -1, -1):
        step = _logsumexp(model.transition + (e[:, t + 1] + aft[t + 1])[:, None, :], 2)
        aft[t] = np.where(used[:, t + 1, None], step, aft[t + 1])
    whole = _logsumexp(fore[-1], 1)
    on_ = used[:, :, None] * weight[:, None, None]
    seen = np.eye(k)[y] * on_
    likely = np.exp(fore.transpose(1, 0, 2) + aft.transpose(1, 0, 2) - whole[:, None, None]) * on_
    pairs, counted = np.zeros((k, k)), np.zeros((k, k))
    for t in range(1, steps):
        on = used[:, t]
        joint = fore[t - 1][on][:, :, None] + model.transition + (e[on, t] + aft[t][on])[:, None, :] - whole[on][:, None, None]
        pairs += (np.exp(joint) * weight[on, None, None]).sum(axis=0)
        np.add.at(counted, (y[on, t - 1], y[on, t]), weight[on])
    gold = (e * seen).sum() + (counted * model.transition).sum() + (model.first[y[:, 0]] * weight).sum()
    difference = seen - likely
    grads = [np.einsum("nsd,nsk->dk", x, difference), counted - pairs, difference[:, 0].sum(axis=0)]
    return float(gold - (whole * weight).sum()), grads


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], labels: int = 2, rounds: int = 150, rate: float = 0.1, l2: float = 1e-3, weights: list[float] | None = None, start: Crf | None = None) -> Crf:
    """Train on ``(features, labels)`` pairs by full-batch Adam on the penalised likelihood; deterministic.

    ``weights`` tells how often each pair counts; training goes on from the model ``start``.
    """
    if not sequences:
        raise ValueError("no labelled sequence to train on")
    ordered = sorted(zip(sequences, weights or [1.0] * len(sequences)), key=lambda s: len(s[0][1]))
    batches = []
    for i in range(0, len(ordered), 256):
        part = ordered[i : i + 256]
        shape = (len(part), max(len(y) for (_, y), _ in part))
        x, y, used = np.zeros((*shape, part[0][0][0].shape[1])), np.zeros(shape, int), np.zeros(shape, bool)
        for r, ((f, g), _) in enumerate(part):
            x[r, : len(g)], y[r, : len(g)], used[r, : len(g)] = f, g, True
        batches.append((x, y, used, np.array([w for _, w in part])))
    items = sum(float((u * w[:, None]).sum()) for *_, u, w in batches)
    values = [np.zeros((sequences[0][0].shape[1], labels)), np.zeros((labels, labels)), np.zeros(labels)]
    if start:
        values = [start.emission.copy(), start.transition.copy(), start.first.copy()]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, rounds + 1):
        total = [-l2 * v for v in values]
        for batch in batches:
            for t, g in zip(total, _gradient(Crf(*values), *batch)[1]):
                t += g / items
        for v, g, m, s in zip(values, total, mean, square):
            m[:] = 0.9 * m + 0.1 * g
            s[:] = 0.999 * s + 0.001 * g * g
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Crf(*values)
