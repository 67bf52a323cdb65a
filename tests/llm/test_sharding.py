import zlib
from collections import Counter, defaultdict

import pytest

from quillstream.llm.sharding import LOWEST, TOLERANCE, deal_groups, shard_documents, splitters


def rows_of(kind):
    if kind == "even":
        return [(i, f"text {i} " * (i % 7 + 1)) for i in range(3000)]
    if kind == "hot":
        return [(i, "the same text everywhere" if i % 3 == 0 else f"own {i}" * 3) for i in range(3000)]
    if kind == "long":
        return [(i, "x" * (200_000 if i == 5 else i % 50)) for i in range(2000)]
    return [(1, None), (2, ""), (3, "é"), (3, "é"), (None, "ü")]


@pytest.mark.parametrize("kind", ["even", "hot", "long", "odd"])
def test_laws(spark, kind):
    rows = rows_of(kind)
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, size int").repartition(7)
    got = shard_documents(docs, range_rows=200).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, load = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    if kind in ("even", "hot"):
        mean = sum(load.values()) / 24
        assert max(load.values()) - min(load[s] for s in range(24)) < 0.05 * mean
    if kind == "even":
        where = defaultdict(set)
        for r in got:
            where[r.text_crc32].add(r.shard)
        assert all(len(x) == 1 for x in where.values())


def test_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_splitters_stand_before_their_hash():
    cuts = splitters([(5, i, 1.0) for i in range(100)] + [(9, 1, 1.0)], 10)
    assert cuts and all(h in (5, 9) and d == LOWEST for h, d in cuts)


def plain_deal(groups, shards, total, tolerance=TOLERANCE):
    """Row by row, as one would by hand: whole groups where they fit, else as many rows as there is room for."""
    mean, load, where = total / shards, [0] * shards, {h: {} for h, *_ in groups}
    waiting = [[size, h, n] for h, size, n in groups]
    while waiting:
        size, h, n = min(waiting, key=lambda g: (-g[0], g[1]))
        waiting.remove([size, h, n])
        k, row, taken = load.index(min(load)), size // n, n
        if n > 1 and load[k] + size > mean * (1 + tolerance):
            taken = 1
            while taken < n and load[k] + row * (taken + 1) <= mean:
                taken += 1
        where[h][k] = where[h].get(k, 0) + taken
        load[k] += row * taken
        if taken < n:
            waiting.append([row * (n - taken), h, n - taken])
    return where, load


@pytest.mark.parametrize("kind", ["singles", "groups", "larger", "hot"])
def test_dealing_levels_the_shards(kind):
    if kind == "singles":
        groups, shards = [(h, 10 * h, 1) for h in range(1, 30)], 6
    elif kind == "groups":
        groups, shards = [(h, 20 * 11, 20) for h in range(30)], 24
    elif kind == "larger":
        groups, shards = [(h, 7 * (h % 9 + 3), 7) for h in range(40)] + [(99, 2000, 100)], 5
    else:
        groups, shards = [(1, 9000, 900), (2, 50, 1)], 4
    held = sum(size for _, size, _ in groups)
    total = held + 1000 * shards
    where, begins = deal_groups(groups, shards, total)
    plain, load = plain_deal(groups, shards, total)
    assert {h: dict(x) for h, x in where.items()} == plain
    ends = [*begins[1:], float(total - held)]
    filled = [own + e - b for own, b, e in zip(load, begins, ends, strict=True)]
    assert max(filled) - min(filled) <= 0.01 * total / shards


def test_what_does_not_fit_beside_one_row():
    where, begins = deal_groups([(1, 900, 1), (2, 10, 1)], 4, 1000)
    assert where == {1: [(0, 1)], 2: [(1, 1)]} and begins == [0, 0, pytest.approx(23.33, abs=0.01), pytest.approx(56.67, abs=0.01)]


def by_group(rows, got):
    key = {d: t or "" for d, t in rows}
    where, sizes = defaultdict(set), Counter()
    for r in got:
        where[key[r.doc_id]].add(r.shard)
        sizes[key[r.doc_id]] += r["size"]
    return where, sizes


@pytest.mark.parametrize("kind", ["copies", "hot", "mixed", "heavy", "uneven"])
def test_law_before_groups(spark, kind):
    """Shards are level whatever the groups, and a group is cut only where the law asks for it."""
    if kind == "copies":
        rows = [(i, f"copy {i % 40} " * 5 if i % 15 == 0 else f"own text {i} of {i * 7}") for i in range(24_000)]
    elif kind == "hot":
        rows = [(i, "the same text everywhere" if i % 3 == 0 else f"own {i}" * 3) for i in range(6000)]
    elif kind == "mixed":
        rows = [(i, ("a" * 300 if i % 24 == 0 else f"g{i % 11}" * 20 if i % 3 == 0 else f"own {i}")) for i in range(4800)]
    elif kind == "heavy":  # thirty groups of more than half a shard each
        rows = [(i, f"text {i % 30:04d} " * 30 if i < 600 else f"single {i}" * 5) for i in range(840)]
    else:
        rows = [(i, "x" * (i * i % 4001) + str(i)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = shard_documents(docs, range_rows=500).collect()
    assert len(got) == len(rows)
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    mean = sum(load.values()) / 24
    spread = max(load.values()) - min(load[s] for s in range(24))
    assert spread <= (0.01 * mean if kind != "heavy" else max(r["size"] for r in got)), (spread, mean)
    where, sizes = by_group(rows, got)
    whole = [len(shards) == 1 for shards in where.values()]
    assert all(len(where[t]) == 1 for t in where if sizes[t] <= 0.001 * mean)
    if kind in ("copies", "uneven"):
        assert all(whole)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, None, 1, "a")] * 300 + [(7, "x" * 50, 2, "b")] * 300, "doc_id long, text string, shard int, h string")
    got = shard_documents(docs, range_rows=20).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == {(None, 8): 300, (7, 58): 300}
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load[s] for s in range(24)) <= 2 * 58  # one hot key is cut between its rows
