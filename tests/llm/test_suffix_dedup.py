import hashlib
import random

import numpy as np
import pytest

from quillstream.llm import suffix_dedup as S


def brute(rows, length=100):
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            else:
                seen[w] = d
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), spans, kept))
    return out


def make(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join("".join(rng.choice("etaoinéß") for _ in range(rng.randrange(1, 8))) for _ in range(n))
    passage, line = text(60), text(9)
    rows = [text(rng.randrange(1, 260)) for _ in range(60)]
    rows += [rng.choice(rows) for _ in range(8)]
    for _ in range(60):
        parts = [text(rng.randrange(1, 40)), rng.choice([passage, passage[rng.randrange(50) :], line, rng.choice(rows)[: rng.randrange(400)]]), text(rng.randrange(1, 30))]
        rows.append("\n".join(parts))
    rows += ["a" * 700, "a" * 99, "a" * 100, "ab" * 300, "x" + "ab" * 200, None, "", "short", passage, passage]
    rng.shuffle(rows)
    return [(3 * i - 40, t) for i, t in enumerate(rows)]


HOT = {"shard_bytes": 2000, "bucket_bytes": 3000, "array_bytes": 4000, "hot_contexts": 3, "message_hot": 1}


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 2000, "bucket_bytes": 3000, "array_bytes": 4000, "hot_contexts": 3}, {"array_bytes": 20_000}, HOT, HOT | {"hot_contexts": 1}])
def test_against_brute_force(spark, limits):
    rows = make(len(limits))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, bucket string").repartition(5)
    got = sorted(tuple(r) for r in S.remove_repeats(docs, **limits).collect())
    assert [(*g[:4], bytes(g[4])) for g in got] == brute(rows)
    digests = {r.doc_id: bytes(r.kept) for r in S.remove_repeats(docs, with_text=False, **limits).collect()}
    assert digests == {d: hashlib.sha256(k).digest() for d, *_, k in brute(rows)}


def test_block_joints(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 105, 200_000).astype(np.uint8)
    offsets = np.array([0, 70_000, 70_000, 70_050, 200_000])
    _, _, text, pos, n = S.contexts(data, offsets, 100)
    starts = np.concatenate([offsets[t] + p + np.arange(k) for t, p, k in zip(text, pos, n)])
    want = np.concatenate([np.arange(a, b - 99) for a, b in zip(offsets[:-1], offsets[1:]) if b - a >= 100])
    assert (starts == want).all() and n.max() <= 81


def test_edges(spark):
    same = "word " * 60
    docs = spark.createDataFrame([(1, same + "b" * 120), (1, same + "b" * 120), (None, "q" * 30), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in S.remove_repeats(docs).collect()}
    alone = {(r.doc_id, r.n_bytes, r.n_removed) for r in S.remove_repeats(docs.dropDuplicates()).collect()}
    assert got == alone and (None, 30, 0) in got and (5, 0, 0) in got
    assert S.remove_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 2000, "bucket_bytes": 3000, "array_bytes": 4000, "hot_contexts": 3}, HOT])
def test_rows_that_lack_or_share_an_id(spark, limits):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 8))) for _ in range(n))
    passage = text(50)
    rows = [(d, f"{passage} {text(40)}" if i % 2 else f"{text(30)} {passage} {text(rng.randrange(60))}") for i, d in enumerate([None] * 12 + [4] * 6 + [9, 2, -3])]
    rows += [(None, rows[0][1])] * 30 + [(4, rows[13][1])] * 20 + [(None, None), (None, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keys = {(r.doc_id, r.text): r.key for r in docs.select("doc_id", "text", S.row_key().alias("key")).collect()}
    distinct = sorted(keys, key=lambda r: (r[0] is not None, r[0] or 0, keys[r]))
    cut = dict(zip(distinct, brute(list(enumerate(t for _, t in distinct))), strict=True))
    got = sorted((tuple(r) for r in S.remove_repeats(docs, **limits).collect()), key=repr)
    assert got == sorted(((r[0], *cut[r][1:4], bytearray(cut[r][4])) for r in rows), key=repr)
    assert sum(g[2] > 0 for g in got) > 20


def test_hot_anchors_are_found(spark):
    """The anchor of a line that many texts share has very many contexts; those of other lines have few."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("etaoinshr ") for _ in range(n))
    line = text(95)
    docs = spark.createDataFrame([(text(150) + line + text(150),) for _ in range(300)] + [(text(400),) for _ in range(100)], "text string").repartition(3)
    found = S.hot_anchors(docs, 100, 100)
    assert 1 <= len(found) <= 8 and len(S.hot_anchors(docs, 100, 5000)) == 0
    assert (np.diff(found.astype(object)) > 0).all()
