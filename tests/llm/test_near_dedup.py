import random
import re

import numpy as np
import pytest

from quillstream.llm import near_dedup as N
from quillstream.llm.components import connected_components


def brute(rows, words=3, num=85, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def noisy(rng, base, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in base.split())


def make(seed=1, cloud=120):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [text(rng.randrange(1, 200)) for _ in range(150)]
    rows += [noisy(rng, rng.choice(rows[:40]), rng.choice([0.005, 0.02, 0.04])) for _ in range(150)]
    base = text(150)
    rows += [noisy(rng, base, 0.012) for _ in range(cloud)] + [base] * 40
    rows += [None, "", " \n", "one", "ONE", "one two", "One  Two", "é ü ß", "É ü ß", "a a a a a a", "a a a", "z" * 30_000]
    rng.shuffle(rows)
    return [(i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("limits", [{}, {"region_rows": 20, "cluster_rows": 30, "broadcast_rows": 0}])
def test_against_brute_force(spark, limits):
    rows = make()
    docs = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], "doc_id long, text string, n_shingles string, least int, id int, set_a int").repartition(6)
    assert sorted(map(tuple, N.near_duplicates(docs, **limits).collect())) == brute(rows)


def test_five_words(spark):
    rows = make(2, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(docs, 5, 80, 100).collect())) == brute(rows, 5, 80, 100)


def test_edges(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, N.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 2, 7, True), (7, 2, 7, True), (None, 2, None, True), (9, 0, 9, True)], key=str)
    assert N.near_duplicates(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: parent[x] for a, b in edges if a != b for x in (a, b)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 900, np.uint64)
    sig = N.signatures(np.concatenate([x[:800], x[100:]]), np.array([800, 0, 800]))
    assert abs((sig[0] == sig[2]).mean() - 700 / 900) < 0.12
    assert N.forest_shape(85, 100) == (6, 24)


def test_neighbours_in_sorted_order():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 4, (12, 16)).astype(np.uint8)
    rows = np.array(sorted(map(bytes, np.concatenate([base, base[:6], np.where(rng.random((12, 16)) < 0.2, 9, base).astype(np.uint8)]))))
    turned = np.frombuffer(b"".join(x.ljust(16, b"\0") for x in rows.tolist()), np.uint8).reshape(-1, 16)
    common = N.common_lengths(turned)
    plain = [next((k for k in range(16) if a[k] != b[k]), 16) for a, b in zip(turned[:-1], turned[1:], strict=True)]
    assert common.tolist() == [0, *plain]
    edges = N.neighbours_joined(turned, common, 0.7)
    parent = list(range(len(turned)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(turned)):  # all pairs, by hand
        for j in range(i):
            if (turned[i] == turned[j]).sum() >= 0.7 * 16:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    found = N.Forest(len(turned))
    assert all(found.join(i, j) for i, j in edges)  # no edge too many
    assert [found.root(i) for i in range(len(turned))] == [root(i) for i in range(len(turned))]


def test_regions_across_batches():
    """A region that is cut by the end of a batch is the same region."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted((int(k), rng.integers(0, 2, N.HASHES).astype(np.uint8).tobytes(), 100 + i) for i, k in enumerate(rng.integers(0, 6, 60)))
    table = pa.table({"key": [r[0] for r in rows], "doc_id": [r[2] for r in rows], "turned": pa.array([r[1] for r in rows], pa.binary())})
    parts = lambda size: {tuple(r.values()) for b in N._regions(0.5, 0)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()}
    assert parts(7) == parts(60) == parts(1) and parts(60)


@pytest.mark.parametrize("ratio", [(85, 100), (80, 100), (1, 2), (1, 1)])
def test_similar_sets_share_a_rare_item(ratio):
    """Whatever the order of items is, two similar sets share one of the first of each."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 60, 40, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(1, 40)), replace=False), rng.integers(1, 1 << 60, int(rng.integers(0, 8)), np.uint64)])) for _ in range(120)]
    members = pa.table({"cluster": [1] * 120, "doc_id": range(120), "component": range(120), "asked": [True] * 120, "items": pa.array([s.tobytes() for s in sets], pa.binary())})
    known = pa.table({"known": pa.array([[{"item": int(x), "n": int(n)} for x, n in zip(base, rng.integers(2, 9, 40))]], pa.list_(pa.struct([("item", pa.int64()), ("n", pa.int64())])))})
    for often in (known, known.slice(0, 0)):
        marks = N._prefixes(*ratio)(members, often).to_pylist()
        own = {d: {m["item"] for m in marks if m["doc_id"] == d} for d in range(120)}
        found = 0
        for i in range(120):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if ratio[1] * both >= ratio[0] * (len(sets[i]) + len(sets[j]) - both):
                    found += 1
                    assert own[i] & own[j]
        assert found or ratio == (1, 1)


def test_dense_clusters_against_brute_force(spark):
    """Clusters of one template with more and less noise, so that many members lie outside of the largest component."""
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(2)]
    rows = [(k, noisy(rng, base[k % 2], rng.choice([0.01, 0.02, 0.03, 0.05, 0.08]))) for k in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, N.near_duplicates(docs, region_rows=10, cluster_rows=12).collect()))
    want = brute(rows)
    assert got == want and len({r[2] for r in want}) > 20
