import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm.topk import top_k


def brute(rows, k=10):
    kept = []
    for d, v in rows:
        if d is not None and v and all(x is not None and math.isfinite(1024 * x) for x in v):
            kept.append((d, [math.floor(1024 * x) for x in v]))
    out = []
    for q, v in kept:
        if q % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), d) for d, w in kept if d != q and len(w) == len(v))[:k]
            out += [(q, r + 1, d, max(1 - 2**63, min(2**63 - 1, -s))) for r, (s, d) in enumerate(found)]
    return sorted(out)


def rows_of(kind):
    rng = np.random.default_rng(3)
    f = lambda a: [float(x) for x in a]
    if kind == "unit":
        v = rng.normal(size=(900, 8))
        return [(i, f(x / np.linalg.norm(x))) for i, x in enumerate(v)]
    if kind == "lengths":
        return [(i, f(x)) for i, x in enumerate(rng.normal(size=(900, 8)) * rng.lognormal(0, 2, (900, 1)))]
    if kind == "clusters":
        centre = rng.normal(size=(6, 8))
        return [(i, f(centre[i % 6] + 0.02 * rng.normal(size=8))) for i in range(900)]
    if kind == "ties":
        return [(i, [0.5, -0.25] if i % 3 else [0.0, 0.0]) for i in range(700)]
    if kind == "large":  # scores around and beyond 64 bits, lengths far apart
        v = rng.normal(size=(600, 8)) * 10.0 ** rng.integers(-2, 12, (600, 1))
        return [(i, f(x)) for i, x in enumerate(v)] + [(600 + i, [2.0**20] * 8) for i in range(20)] + [(700 + i, f(-x)) for i, x in enumerate(v[:90])]
    if kind == "huge":
        v = rng.normal(size=(150, 3)) * 10.0 ** rng.integers(-3, 304, (150, 1))
        return [(i, f(x)) for i, x in enumerate(v)] + [(200, [1.7e305, 1.7e305, 0.0]), (300, [3.4e38] * 3), (301, [3.4e38] * 3), (400, [1e307, 0.0, 0.0])]
    if kind == "negative":  # all scores lie below 64 bits
        return [(100 * i, [1e15 + i, 0.0]) for i in range(3)] + [(i + 1, [-1e16 - 1e4 * i, 5.0]) for i in range(40)]
    if kind == "few":
        return [(0, [1.0, 2.0]), (1, [3e6, 1.0]), (2, [0.5, 0.5]), (3, [1e9, -1.0]), (100, [1.0, -1.0])]
    return [(0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 0.0]), (500, [1.0]), (None, [1.0, 1.0]), (1, [-1.0, 3.0]), (2, []), (600, [1e6, -1e6]), (3, [2e5, 1e-9])]


@pytest.mark.parametrize("kind", ["unit", "lengths", "clusters", "ties", "odd", "large", "huge", "negative", "few"])
def test_against_brute_force(spark, kind):
    rows = rows_of(kind)
    frame = spark.createDataFrame([(d, v, 1, "x", 2.0) for d, v in rows], "vec_id long, embedding array<double>, bucket int, v string, score double")
    got = top_k(frame, F.col("vec_id") % 100 == 0, bucket_rows=128, block_queries=4)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []


def test_repeated_rows(spark):
    """Rows sharing a vec_id are never each other's candidates; repeated candidates rank as often as they occur."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=4) * (1 + i % 5)]) for i in range(250)]
    rows += [rows[0], rows[100], rows[7], rows[7]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(frame, F.col("vec_id") % 100 == 0, bucket_rows=32, block_queries=2)
    want = sorted({(q, r, d, s) for q, r, d, s in brute(rows)})
    assert sorted({tuple(r) for r in got.collect()}) == want
