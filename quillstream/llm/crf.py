"""A linear-chain conditional random field with two labels, in numpy.

Many sequences lie one after another in flat arrays (features of all items, lengths). Sums
over positions run in lockstep: step t handles the t-th item of every sequence that has one.
The score of a labelling is ``sum(label * (x @ weights)) + sum(transitions[previous, label])``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Parameters of a fitted chain; ``mean`` and ``scale`` standardise the features."""

    weights: np.ndarray
    transitions: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each item."""
        return _sums(self.odds(x), self.transitions, lengths)[0]

    def best(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The likeliest labelling of each sequence (Viterbi); ties go to label 0."""
        return self.decoded(self.odds(x), lengths)

    def decoded(self, odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The same from the items' ``odds``."""
        steps = _steps(lengths)
        back = np.zeros((len(odds), 2), np.int8)
        label = np.zeros(len(odds), np.int8)
        score = None
        for t, at in enumerate(steps):
            if t == 0:
                score = np.zeros((len(at), 2))
            else:
                options = score[: len(at), :, None] + self.transitions
                back[at] = options.argmax(1)
                score[: len(at)] = options.max(1)
            score[: len(at), 1] += odds[at]
        if len(steps):
            ends = score.argmax(1).astype(np.int8)  # rows stay as their sequence left them
            for t in range(len(steps) - 1, -1, -1):
                at = steps[t]
                label[at] = ends[: len(at)]
                ends[: len(at)] = back[at, ends[: len(at)]]
        return label


def _steps(lengths: np.ndarray) -> list[np.ndarray]:
    """For each t, the flat positions of the t-th items, longest sequences first."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), "left")
    return [starts[:n] + t for t, n in enumerate(alive)]


def _sums(odds: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward: marginals of label 1, expected transitions, log of the partition sum."""
    steps = _steps(lengths)
    top = np.maximum(odds, 0)
    emit = np.exp(np.stack([-top, odds - top], 1))
    move = np.exp(transitions)
    forward, scale = np.ones((len(odds), 2)), np.ones(len(odds))
    for t, at in enumerate(steps):
        a = emit[at] if t == 0 else (forward[steps[t - 1][: len(at)]] @ move) * emit[at]
        scale[at] = a.sum(1)
        forward[at] = a / scale[at][:, None]
    behind, expected = np.ones((len(odds), 2)), np.zeros((2, 2))
    for t in range(len(steps) - 2, -1, -1):
        nxt = steps[t + 1]
        at = steps[t][: len(nxt)]
        later = emit[nxt] * behind[nxt] / scale[nxt][:, None]
        expected += forward[at].T @ later * move
        behind[at] = later @ move.T
    both = forward * behind
    return both[:, 1] / np.maximum(both.sum(1), 1e-300), expected, float(np.log(scale).sum() + top.sum())


def fit(x: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> Chain:
    """Maximum likelihood with a ridge, by Adam on all sequences."""
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-6
    z = np.ones((len(x), x.shape[1] + 1), np.float32)
    for k in range(0, len(x), 20_000):
        z[k : k + 20_000, :-1] = (x[k : k + 20_000] - mean) / scale
    y = labels.astype(np.int64)
    lengths = np.asarray(lengths, np.int64)
    inner = np.ones(len(y), bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(y[at - 1] * 2 + y[at], minlength=4).reshape(2, 2)
    w = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        p, expected, _ = _sums((z @ w[:-4].astype(np.float32)).astype(np.float64), w[-4:].reshape(2, 2), lengths)
        grad = np.concatenate([z.T @ (y - p).astype(np.float32), (seen - expected).ravel()]) / max(1, len(y)) - ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return Chain(w[:-4], w[-4:].reshape(2, 2), mean, scale)
