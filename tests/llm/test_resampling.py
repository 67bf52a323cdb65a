"""Importance resampling against a plain version, text by text."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillstream.llm import resampling as R


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def buckets_of(text, longest, n):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, longest=1, n=10_000, percent=10, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text, longest, n))
    for text in target:
        t.update(buckets_of(text, longest, n))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + n) / ((s[b] + 1) * (all_t + n)))) for b in range(n)]
    rows = []
    for d, text in docs:
        own = buckets_of(text, longest, n)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = ["Bridge", "river", "straße", "日本", "x9", "don't", "A", "the", "of", "w" * 70, "b_c"]
    return [(k, " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), int(rng.integers(0, 60))))) for k in range(n)]


def found(spark, docs, target, **how):
    frame = spark.createDataFrame([(d, t, "x", 5) for d, t in docs], "doc_id long, text string, bucket string, score int")
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in R.resample(frame, wanted, **how).collect()), key=repr)


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (1, 7), (2, 1000), (3, 65_536)])
def test_against_plain_version(spark, longest, buckets):
    docs, target = made(250), [t for _, t in made(12, 2)]
    assert found(spark, docs, target, longest_run=longest, buckets=buckets, percent=30) == brute(docs, target, longest, buckets, 30)


def test_odd_texts_and_ids(spark):
    docs = [(0, None), (1, ""), (2, "!!! --"), (3, "a" * 100_000), (4, "word " * 30_000), (None, "one two " * 20), (None, "three four " * 20), (None, "one two " * 20)]
    docs += [(5, "five six " * 15)] * 6 + [(6, "\x00seven\x7feight\x1f" * 12), (7, "ÀÉ ÀÉ " * 10)]
    target = [None, "", "one five"]
    assert found(spark, docs, target, percent=60) == brute(docs, target, percent=60)


def test_ties_go_to_the_smaller_id(spark):
    frame = spark.createDataFrame([(d, 30, 30, 4, 100 if d % 2 else 90) for d in range(20)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r.doc_id: r["rank"] for r in R.draw(frame, percent=40).collect()}
    assert {d: k for d, k in got.items() if k} == {1: 1, 3: 2, 5: 3, 7: 4, 9: 5, 11: 6, 13: 7, 15: 8}
    assert len(got) == 20


def test_empty(spark):
    assert found(spark, [], ["a b"]) == []
    assert found(spark, made(30), []) == brute(made(30), [])


def test_crc_of_spans():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts, lengths = rng.integers(0, 4000, 300), rng.integers(0, 200, 300)
    assert R.crc32_of(data, starts, lengths).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)]
