import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import quality
from quillstream.llm import queries as Q

SF = "/root/testdata/sf0.01"


def test_line_features_by_line():
    x, lines, size = quality.line_features(pa.array(["Ab c!\n\nxx", None, "é"]))
    assert lines.tolist() == [3, 1, 1] and size.tolist() == [5, 0, 2, 0, 2]
    assert x[0, 0] == pytest.approx(0.2) and x[0, 4] == pytest.approx(0.2)
    single, n, _ = quality.line_features(pa.array(["é"]))
    assert n.tolist() == [1] and np.allclose(single[0], x[4])


def test_repeated_words():
    data = np.frombuffer(b" a a a b\nb b\n\n", np.uint8)
    assert quality._repeats(data, np.array([0, 9, 13])).tolist() == pytest.approx([0.5, 0.5, 0])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.op4_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "x\n" * 5000, None)], "doc_id long, text string, score int")
    model = quality.fit_quality(["Good line.\nMore of it.", "BAD!! BAD!!"] * 5, [1, 0] * 5)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(docs.limit(0), model).collect() == []
    nothing = quality.learn(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score_quality(docs, nothing).collect()} == {0.5}


def test_long_documents_teach_and_repeated_ids_are_settled(spark):
    good, bad = "A calm and even line of prose.\n" * 3000, "BUY!! $$$ NOW | CLICK\n" * 3000
    rows = [(i, good if i % 2 else bad) for i in range(20)] + [(1, "short"), (3, None), (None, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, i % 2) for i in range(20)] + [(5, 0), (5, 1), (7, None), (8, 3), (None, 1), (99, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    seen = []
    fit, quality.fit_quality = quality.fit_quality, lambda texts, given: seen.append((texts, given)) or quality.QualityModel(None, 0.0, 0.5)
    try:
        quality.learn(docs, labels)
        quality.learn(docs, labels, per_label=3)
        quality.learn(docs, labels, most_bytes=200_000)
    finally:
        quality.fit_quality = fit
    (texts, given), (few, _), (small, _) = seen
    assert sorted(zip(given, texts)) == sorted([(0, bad)] * 10 + [(0, good)] + [(1, good)] * 7 + [(1, "short"), (1, "")])
    assert len(few) == 6 and all(sum(len(t.encode()) for t, g in zip(small, seen[2][1]) if g == k) <= 200_000 for k in (0, 1))
    assert len([t for t in small if len(t) > 16_384]) >= 4


def plain_scores(model, text):
    """Forward and backward sums over the lines of one text, one by one."""
    lines = (text or "").split("\n")
    x, n, size = quality.line_features(pa.array([text], pa.string()))
    assert n.tolist() == [len(lines)] and size.tolist() == [len(t.encode()) for t in lines]
    own = np.stack([np.zeros(len(x)), model.chain.odds(x)], 1)
    forward, backward = [own[0]], [np.zeros(2)]
    for o in own[1:]:
        forward.append(o + np.logaddexp(*(forward[-1][:, None] + model.chain.transitions)))
    for o in own[:0:-1]:
        backward.append(np.logaddexp(*(o + backward[-1] + model.chain.transitions).T))
    both = np.array(forward) + np.array(backward[::-1])
    chance = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
    evidence = (chance * (size + 1)).sum() / (size + 1).sum()
    return 1 / (1 + np.exp(-(model.slope * evidence + model.offset)))


def test_scores_against_a_plain_version(spark):
    good, bad = ["Good line.\nMore of it, and more.", "A text.\n\nIn parts."], ["BAD!! BAD!!\n$$$", "x | y | z\n1 2 3"]
    model = quality.fit_quality(good * 6 + bad * 6, [1] * 12 + [0] * 12)
    texts = [*good, *bad, None, "", "\n", "a\n" * 700 + "B!!", "é ü\n" * 40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([plain_scores(model, t) for t in texts], abs=1e-9)


def test_features_in_parts_are_those_of_all():
    from quillstream.llm import quality as Q

    rng = np.random.default_rng(2)
    texts = ["\n".join("word! " * int(n) for n in rng.integers(0, 9, int(k))) for k in rng.integers(0, 12, 60)] + ["", "x" * 5000, "\n\n"]
    whole, parts = Q.line_features(pa.array(texts, pa.string())), Q.features_in_parts(texts, 300)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
