import itertools

import numpy as np

from quillstream.llm import crf


def chain(rng, features=3):
    return crf.Chain(rng.normal(size=features + 1), rng.normal(size=(2, 2)), np.zeros(features), np.ones(features))


def brute(c, x):
    odds = c.odds(x)
    best, total, one = None, 0.0, np.zeros(len(x))
    for y in itertools.product((0, 1), repeat=len(x)):
        s = sum(o * k for o, k in zip(odds, y)) + sum(c.transitions[a, b] for a, b in zip(y, y[1:]))
        if best is None or s > best[0] + 1e-12:
            best = (s, y)
        total += np.exp(s)
        one += np.exp(s) * np.array(y)
    return one / total, best[1]


def test_marginals_and_viterbi_match_enumeration():
    rng = np.random.default_rng(1)
    c = chain(rng)
    lengths = np.array([3, 0, 1, 6, 2])
    x = rng.normal(size=(lengths.sum(), 3))
    p, y = c.marginals(x, lengths), c.best(x, lengths)
    at = 0
    for n in lengths:
        if n:
            want_p, want_y = brute(c, x[at : at + n])
            assert np.allclose(p[at : at + n], want_p) and tuple(y[at : at + n]) == want_y
        at += n


def test_fit_learns_from_neighbours():
    rng = np.random.default_rng(2)
    lengths = np.full(60, 12)
    y = np.repeat(rng.integers(0, 2, 180), 4)
    x = (y + rng.normal(scale=1.2, size=len(y)))[:, None]
    c = crf.fit(x, y, lengths)
    assert c.transitions[0, 0] + c.transitions[1, 1] > c.transitions[0, 1] + c.transitions[1, 0]
    assert (c.best(x, lengths) == y).mean() > ((x[:, 0] > 0.5) == y).mean()
