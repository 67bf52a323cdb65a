"""Set joins against all pairs, and how many pairs they look at."""

import random

import pytest

from quillstream.operators import passages as S
from quillstream.operators import similarity as J


def made(n, seed, vocabulary=400, low=0, high=30):
    """Sets of words drawn by a law in which a few words are in most sets."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    weights = [1 / (k + 1) for k in range(vocabulary)]
    return {k: sorted(set(rng.choices(words, weights, k=rng.randint(low, high)))) for k in range(n)}


def frame(spark, sets, name):
    return spark.createDataFrame([(k, v) for k, v in sets.items()], f"{name} long, words array<string>")


@pytest.mark.parametrize("least", [18, 50, 90])
@pytest.mark.parametrize("most", [0, 100_000])
def test_overlaps(spark, least, most):
    a, b = made(150, 1), made(40, 2)
    got = sorted(map(tuple, J.overlaps(frame(spark, a, "id"), ["id"], frame(spark, b, "other"), "other", least, most).collect()))
    want = []
    for i, x in a.items():
        for j, y in b.items():
            shared, smaller = len(set(x) & set(y)), min(len(x), len(y))
            if shared and shared * 100 >= smaller * least:
                want.append((i, j, shared, smaller))
    assert got == sorted(want)


def test_few_others_are_an_index(spark, monkeypatch):
    """Few contexts are counted where the paragraphs lie, in small steps as well, without a join on words."""
    monkeypatch.setattr(J, "overlap_candidates", None)
    monkeypatch.setattr(J, "CELLS", 300)
    texts = {1: "Alpha beta-gamma, the DELTA alpha “x”", 2: None, 3: "nothing here", 4: "alpha delta epsilon zeta eta theta"}
    paragraphs = spark.createDataFrame([(k % 2, k, t) for k, t in texts.items()], "doc_id long, seq int, text string")
    contexts = spark.createDataFrame([(7, "delta alpha with that"), (8, "epsilon beta-gamma"), (9, None)], "context_id int, text string")
    got = {(r.seq, r.context_id): (r.shared, r.smaller) for r in S.context_similarity(paragraphs, contexts).collect()}
    assert got == {(1, 7): (2, 2), (1, 8): (1, 2), (4, 7): (2, 2), (4, 8): (1, 2)}


@pytest.mark.parametrize("rounds", [J.ROUNDS, (0.0,), (0.9, 0.0)])
def test_best_partner(spark, rounds):
    sets = made(120, 3) | {200: ["only"], 201: [], 202: ["w0", "w1"], 203: ["w0", "w1"]}
    got = {r.id: (r.other, round(r.similarity, 9)) for r in J.best_partner(frame(spark, sets, "id"), rounds).collect()}
    want = {}
    for i, x in sets.items():
        scored = [(-len(set(x) & set(y)) / max(len(x), len(y)), j) for j, y in sets.items() if j != i and set(x) & set(y)]
        if scored:
            want[i] = (min(scored)[1], round(-min(scored)[0], 9))
    assert got == want


def test_few_pairs_are_looked_at(spark):
    """At a high least overlap the prefixes leave less than a tenth of the pairs that share a word."""
    a, b = made(400, 4, 2000, 15, 40), made(60, 5, 2000, 15, 40)
    sharing = sum(bool(set(x) & set(y)) for x in a.values() for y in b.values())
    looked = lambda least: J.overlap_candidates(frame(spark, a, "id"), ["id"], frame(spark, b, "other"), "other", least).select("id", "other").distinct().count()
    kept = J.overlaps(frame(spark, a, "id"), ["id"], frame(spark, b, "other"), "other", 18).count()
    assert looked(70) < 0.1 * sharing
    assert kept <= looked(18) < sharing  # at 18 % most of these pairs are results


def test_empty(spark):
    none = frame(spark, {}, "id")
    assert J.overlaps(none, ["id"], frame(spark, {}, "other"), "other", 18).collect() == []
    assert J.best_partner(none).collect() == []
