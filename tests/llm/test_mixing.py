"""The mix against a plain walk along each source's shuffled line, and the schedule's evenness."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, number int, target int, taken int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def wanted(sizes, weights=(3.0, 1.0, 2.0), share=1.5, repeats=2):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * each >= repeats * sizes[s]}
        if not over:
            return target | {s: weight[s] * each for s in open_}
        for s in over:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def brute(rows, seed=11):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = defaultdict(int)
    for _, s, t in rows:
        sums[s] += size(t)
    target, out = wanted(sums), []
    taken = defaultdict(int)
    for s in sums:
        room = math.floor(target[s] + 1e-9)
        for epoch in range(2):
            key = lambda k: hashlib.md5(f"{seed}:{epoch}:{rows[k][0]}:{hashlib.md5((rows[k][2] or '').encode()).hexdigest()}:0".encode()).hexdigest()  # noqa: B023, E731
            for k in sorted((k for k in range(len(rows)) if rows[k][1] == s), key=key):
                words = min(room, size(rows[k][2]))
                taken[k] += words
                room -= words
    for k, (d, s, t) in enumerate(rows):
        out.append((d, size(t), sums[s], round(target[s], 6), taken[k]))
    return sorted(out, key=repr)


def made(n, seed=5):
    rng = np.random.default_rng(seed)
    names = ["b", "a", None, "", "é", "Z"]
    return [(k, names[0] if k % 3 == 0 else names[int(rng.integers(6))], " ".join("w" * int(x) for x in rng.integers(1, 4, int(rng.lognormal(2, 1.5))))) for k in range(n)]


def found(frame_, **how):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in M.taken_words(frame_, **how).collect()), key=repr)


@pytest.mark.parametrize("block_words", [2048, 64, 1])
def test_against_plain_walk(spark, block_words):
    rows = made(300)
    assert found(frame(spark, rows), block_words=block_words) == brute(rows)


def test_many_small_buckets_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", (7, 7))
    monkeypatch.setattr(M, "CHUNK_SLOTS", (16, 16))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    rows = made(400, 8)
    assert found(frame(spark, rows), block_words=10) == brute(rows)


def test_white_space_and_odd_texts(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, "a", " \t\n\x0b\x0c\r "), (4, "b", "a b   c"), (5, "b", "one" + " two" * 5000), (6, None, "x")]
    assert found(frame(spark, rows)) == brute(rows)


def test_rows_without_own_id(spark):
    """Equal rows are documents of their own: together they take what their line takes, none more than twice its size."""
    rows = [(7, "a", "one two three")] * 40 + [(None, "a", "four five")] * 9 + [(None, "a", "six")] + [(9, "b", "seven eight nine " * 30)] * 3
    got = found(frame(spark, rows).withColumn("part", F.lit("x")), block_words=8)
    assert len(got) == len(rows) and all(t <= 2 * s for _, s, _, _, t in got)
    target = wanted({"a": 139, "b": 270})
    assert {n: sum(r[4] for r in got if r[2] == n) for n in (139, 270)} == {139: math.floor(target["a"]), 270: math.floor(target["b"])}


def test_large_entries_are_split(spark):
    rows = [(1, "a", "one two")] * 50 + [(2, "b", "three")]
    held = M.entries(frame(spark, rows), copies=8).where("doc_id = 1").collect()
    assert sorted((r.part, r.copies) for r in held) == [*((k, 8) for k in range(6)), (6, 2)]


def test_empty(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, "a", None), (2, None, " ")])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_sources_are_spread_evenly(spark):
    """Any stretch of the schedule holds each source by its share, and each block once."""
    sources = spark.createDataFrame([("a", 0, 60_000, 1, 3.0, 60_000.0), ("b", 1, 30_000, 1, 1.0, 30_000.0), ("c", 2, 9_995, 1, 2.0, 9_995.0), ("d", 3, 5, 1, 3.0, 5.0)], "source string, number int, source_size long, entries long, weight double, target double")
    plan = M.schedule(sources, block_words=10).orderBy("slot").collect()
    for number, blocks in enumerate([6000, 3000, 1000, 1]):
        assert [r.block for r in plan if r.number == number] == list(range(blocks))
    assert len({r.slot for r in plan}) == len(plan)
    for begin in range(0, 9900, 100):
        own = [r.number for r in plan if begin <= r.slot < begin + 100]
        assert abs(own.count(0) - 60) <= 3 and abs(own.count(1) - 30) <= 3 and abs(own.count(2) - 10) <= 3


def test_pieces_fill_their_slots(spark):
    rows = made(200, 3)
    pieces, _, sources = M.mix(frame(spark, rows), block_words=32)
    of_slot = defaultdict(list)
    for r in pieces.collect():
        of_slot[r.slot].append((r.offset, r.length))
        assert r.word + r.length <= r["size"]
    for parts in of_slot.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 32
    assert sum(n for parts in of_slot.values() for _, n in parts) == sum(math.floor(r.target) for r in sources.collect())


def test_no_python_in_the_plan(spark):
    plan = M.taken_words(frame(spark, made(30)))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|RDDScan.*Python", plan)
