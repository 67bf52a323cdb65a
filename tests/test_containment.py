"""Texts inside texts against all pairs, and how much is shuffled for long ones."""

import hashlib
import random
import time

import numpy as np
import pytest

from quillstream.operators import containment as C
from quillstream.operators import papers as P


def made(seed, n, letters, most):
    """Random texts, cuts out of them, repeated words and runs of one letter."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices(letters, k=k))
    texts = [word(rng.randint(0, most)) for _ in range(n)]
    for _ in range(n):
        t = rng.choice(texts)
        a = rng.randint(0, len(t))
        texts.append(rng.choice(["", word(3)]) + t[a : rng.randint(a, len(t))] + rng.choice(["", word(5)]))
    return texts + [word(3) * rng.randint(1, 60) for _ in range(8)] + [letters[0] * k for k in range(1, 200, 9)]


@pytest.mark.parametrize(("letters", "least"), [("ab", 6), ("abcdefghij", 7), ("aé𝄞", 24)])
def test_pieces(spark, letters, least):
    wholes, texts = made(1, 60, letters, 300), made(1, 60, letters, 300)[::2] + made(2, 20, letters, 60)
    parts = sorted({t for t in texts if len(t) >= least})
    frame = lambda rows, names: C.numbered(spark.createDataFrame(rows, names))
    whole = frame([(t, k) for k, t in enumerate(wholes)], "text string, number int").repartition(3)
    found = C.pieces(whole, frame([(t,) for t in parts], "text string"), least, "number").collect()
    told = {hashlib.sha256(t.encode()).hexdigest(): t for t in parts}
    got = {(r.number, told[r.digest]) for r in found if r.digest in told}
    assert got == {(k, t) for k, w in enumerate(wholes) for t in parts if t in w}
    assert any(len(t) > 8 * least for _, t in got)


def test_anchors_in_blocks(monkeypatch):
    """Anchors don't depend on the blocks in which they are found or on the texts beside."""
    texts = [t.encode() for t in made(3, 40, "abc", 400)]
    data = lambda some: np.frombuffer(b"".join(some), np.uint8)
    lengths = lambda some: np.array([len(t) for t in some], np.int64)
    rows = lambda some, at: sorted((at + t, *r) for step in C.anchors(data(some), lengths(some), 24) for t, *r in zip(*map(np.ndarray.tolist, step), strict=True))
    want = rows(texts, 0)
    assert want == sorted(r for k, t in enumerate(texts) for r in rows([t], k))
    monkeypatch.setattr(C, "BLOCK", 50)
    assert rows(texts, 0) == want


def test_long_titles_are_not_shuffled_for_each_place(spark):
    """Titles of 8000 letters in shuffled joins: what is written grows with the titles, not with their squares."""
    rng = random.Random(5)
    titles = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8000)) for _ in range(4)]
    papers = spark.createDataFrame([(k, "", t) for k, t in enumerate(titles)], "ord long, doi string, title string")
    works = spark.createDataFrame([(10 + k, "", f"On {t}") for k, t in enumerate(titles)] + [(20, "", titles[0][700:900])], "work long, doi string, title string")

    def written():
        time.sleep(1)  # totals follow the tasks
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    before, usual = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {(r.ord, r.work, r.how) for r in P.same_work(papers, works).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert found == {(k, 10 + k, 3) for k in range(4)}
    assert written() - before < 80 * sum(map(len, titles))


def test_first_of_works_around_and_inside(spark):
    """Both directions meet: the first of the works that hold a title or lie in it is taken."""
    t = "a title of quite some length that others hold"
    papers = spark.createDataFrame([(1, "", t), (2, "", f"{t} and more"), (3, "", t[:22]), (4, "10.1/x", f"{t}s"), (None, "", f"{t} again")], "ord long, doi string, title string")
    works = spark.createDataFrame([(7, "", f"On 7 {t}"), (5, "", t[2:41]), (6, "", f"{t} and more of it"), (8, "10.1/X", "another")], "work long, doi string, title string")
    found = {(r.ord, r.work, r.how) for r in P.same_work(papers, works).collect()}
    assert found == {(1, 5, 3), (2, 5, 3), (4, 8, 1), (None, 5, 3)}
