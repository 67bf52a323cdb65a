"""The audit against a plain walk of every document through every order."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from quillstream.llm import filter_audit as A


def fails_of(docs):
    out = []
    for d, _, text in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        before = any((o[2] or "") == t and o[0] is not None and (d is None or o[0] < d) for o in docs)
        out.append({
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": before,
        })
    return out


def brute(docs, labels):
    fails, good, toxic = fails_of(docs), {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows, names = {}, {s or "" for _, s, _ in docs}
    shapley = Counter()
    for part in names:
        own = [k for k, (_, s, _) in enumerate(docs) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order):
                removed = [k for k in left if fails[k][f]]
                shapley[part, f] += len(removed)
                rows[part, order, step + 1] = (
                    len(left) - len(removed), len(removed), sum(fails[k][f] for k in own) - len(removed),
                    sum(fails[k][f] and sum(fails[k].values()) == 1 for k in own),
                    sum(docs[k][0] in good and docs[k][0] is not None for k in removed), sum(docs[k][0] in toxic and docs[k][0] is not None for k in removed),
                )
                left = [k for k in left if not fails[k][f]]
    return sorted((*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in rows.items())


def found(spark, docs, labels):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], "doc_id long, source string, text string, mask int, part string, quality int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(map(tuple, A.audit(frame, marks).collect()))


def made(n):
    rng = np.random.default_rng(4)
    plain = [f"word{k}" for k in range(90)]
    rows = []
    for k in range(n):
        w = list(rng.choice(plain, int(rng.integers(30, 80)), replace=bool(rng.integers(2))))
        w += ["SHOUTED" * 3] * int(rng.integers(0, 3)) + ["50%"] * int(rng.random() < 0.3)
        rows.append((k, [None, "", "a", "b"][int(rng.integers(4))] if k % 3 else "hot", " ".join(w)))
    rows += [(n + k, rows[k % 7][1], rows[k % 5][2]) for k in range(40)]
    return rows, [(int(d), int(rng.integers(2)), int(rng.integers(2))) for d in rng.permutation(n)[: n // 2]]


def test_against_plain_walk(spark):
    docs, labels = made(150)
    assert found(spark, docs, labels) == brute(docs, labels)


def test_odd_rows(spark):
    docs = [(1, "a", None), (2, "a", ""), (None, "a", ""), (None, None, "x " * 60), (None, "", "x " * 60), (3, "a", "A" * 40), (3, "a", "A" * 40), (4, "b", "A" * 40)]
    docs += [(5, "a", " ".join("abc") + " $"), (6, "c", "word " * 60_000), (7, "c", " \t\n"), (8, "only null id", None)]
    labels = [(1, None, 1), (3, 1, None), (3, 0, 1), (None, 1, 1), (6, 1, 0), (99, 1, 1)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_texts_of_null_ids_only(spark):
    docs = [(None, "a", "same")] * 3 + [(None, "b", "same")]
    assert found(spark, docs, [(1, 1, 1)]) == brute(docs, [(1, 1, 1)])


def test_empty(spark):
    assert found(spark, [], [(1, 1, 1)]) == []
    docs, _ = made(20)
    assert found(spark, docs, []) == brute(docs, [])


@pytest.mark.parametrize("held", [1, 2])
def test_parts_handed_on_early(spark, monkeypatch, held):
    monkeypatch.setattr(A, "HELD_PARTS", held)
    docs, labels = made(60)
    assert found(spark, docs, labels) == brute(docs, labels)


def test_table():
    table = A.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    assert table[0b00010, A.ORDERS.index("ABCDE")] == 1 and table[0b11000, A.ORDERS.index("EDCBA")] == 0
