"""Near-duplicate groups by an LSH forest of MinHash signatures, confirmed on full shingle sets.

1. Every document gets its set of word shingles, a MinHash signature and a digest of the set.
   Documents with equal sets are collapsed to one representative.
2. The forest: several orders of the signature (rotations by ``depth`` hashes), each sorted. In a
   sorted order, neighbours have the longest common prefixes: a region is a run of neighbours
   that share ``depth`` hashes and more. ``depth`` and the number of orders follow from the
   similarity: a pair at it is missed with a chance below 2e-5. Signatures without company at
   ``depth`` in an order take no part in it.
3. In a region, neighbours are candidates from the longest common prefix downwards: runs that
   share more are joined first, and what is joined already is compared through one
   of its members in the end. Signatures that agree well enough are joined. The joins of all
   regions give clusters: a superset of the true groups.
4. A cluster goes to one task with the full sets of its members, which are compared exactly
   (members already connected are not compared again) and cut into components.
5. Dense clusters, with more than ``CLUSTER_ROWS`` different sets, do not fit one task. There
   the forest goes deeper: every region that is too large splits by further hashes of its
   order until it fits, and its exact links are found in there. What this leaves outside the
   largest component of its cluster then meets the other members on its rarest shingles, of
   which similar sets share one, and is compared exactly, so no link between components is lost.

Defined results: null, empty and blank texts have the empty set, are linked with nothing and
stay; a document of fewer words than a shingle has one shingle of all its words; repeated rows
with one doc_id give one row each with the same component; rows that lack an id belong to no
component, unless rows are compared by key; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship
from .arrow_text import in_pieces, ragged, release, utf8
from .components import connected_components
from .rows import row_key, with_group

HASHES = 144
#: Representatives of a region whose signatures are compared with each other at most.
REGION_ROWS = 2000
#: Different sets that one task compares exactly at most.
CLUSTER_ROWS = 3000
#: How far the signatures' agreement may lie below the similarity (about five deviations).
TOLERANCE = 0.15
#: Orders of the forest that look for links inside dense clusters, and hashes a step deeper.
DENSE_ORDERS, DEEPER = 4, 3
#: Items of a dense cluster that are counted to tell rare ones from common ones, about.
SAMPLE_ITEMS = 300_000
#: Members are broadcast up to this count; beyond it their texts are found by a shuffled join.
BROADCAST_ROWS = 300_000

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = _RANDOM.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of each text, and their counts; repeats included."""
    low = _LOWER[data]
    gap = _GAP[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True  # texts end words
    begin = np.flatnonzero(~gap & (first | np.concatenate([[True], gap[:-1]])[: len(data)]))
    count = np.diff(np.searchsorted(begin, offsets))
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(count), np.int64)
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], begin]), np.diff(begin, prepend=0, append=len(data)))
    powers = np.cumprod(np.full(int(place.max()) + 1, _STEP, np.uint64), dtype=np.uint64)
    letters = np.where(gap, np.uint64(0), _BYTE[low]) * powers[place]
    word = _mixed(np.add.reduceat(letters, begin))
    made = np.where(count == 0, 0, np.maximum(1, count - words + 1))
    at = ragged(np.cumsum(count) - count, made)
    own = np.repeat(count, made)
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        part = word[np.minimum(at + k, len(word) - 1)]
        value = np.where(k < own, _mixed(value + part * np.uint64(2 * k + 3)), value)
    return value, made


def signatures(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima of the hashed shingles; zero for empty sets."""
    out = np.zeros((len(count), HASHES), np.uint64)
    full = np.flatnonzero(count > 0)
    if len(full):
        starts = (np.cumsum(count) - count)[full]
        # a few thousand shingles at a time stay in the cache
        cuts = [0, *np.flatnonzero(np.diff(starts // 16_384)) + 1, len(full)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            end = starts[b] if b < len(full) else len(value)
            own, at = value[starts[a] : end], starts[a:b] - starts[a]
            room = np.empty_like(own)
            for k, f in enumerate(_FACTORS):
                np.multiply(own, f, out=room)
                out[full[a:b], k] = np.minimum.reduceat(room, at)
    return _mixed(out)


def forest_shape(numerator: int, denominator: int) -> tuple[int, int]:
    """(depth, orders): the deepest prefix that misses a pair with a chance below 2e-5."""
    s = numerator / denominator
    fits = [d for d in range(1, 13) if (1 - s**d) ** (HASHES // d) < 2e-5]
    depth = max(fits, default=1)
    return depth, HASHES // depth


def _describe(words: int, depth: int, orders: int):
    names = ["id", "doc_id", "n_shingles", "set_a", "set_b", "sketch", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_pieces(whole, "text", 1 << 20):
                value, made = shingles(*utf8(batch.column("text")), words)
                ends = np.cumsum(made)
                unique = [np.unique(value[e - m : e]) for e, m in zip(ends.tolist(), made.tolist(), strict=True)]
                size = np.array([len(u) for u in unique], np.int64)
                digest = np.array([[u.sum(dtype=np.uint64), _mixed(u + _STEP).sum(dtype=np.uint64)] for u in unique], np.uint64).reshape(-1, 2)
                sig = signatures(np.concatenate(unique), size)
                keys = np.zeros((len(size), orders), np.uint64)
                for t in range(orders):
                    for k in range(depth):
                        keys[:, t] = _mixed(keys[:, t] * _STEP + sig[:, t * depth + k] + np.uint64(t))
                sketch = (sig >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), batch.column("doc_id"), pa.array(size), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
                    pa.array([s.tobytes() for s in sketch], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * orders, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                ], names)
        release()

    return run


class Forest:
    """Union-find over positions 0 .. n - 1; the smaller root stays."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def common_lengths(turned: np.ndarray) -> np.ndarray:
    """Of sorted signatures, how many first hashes each shares with the one before it; 0 for the first."""
    same = turned[1:] == turned[:-1]
    length = np.where(same.all(1), turned.shape[1], same.argmin(1))
    return np.concatenate([np.zeros(min(1, len(turned)), np.int64), length])


def neighbours_joined(turned: np.ndarray, common: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the sorted signatures of a region that agree in ``least`` of their hashes.

    Neighbours are compared from the longest common prefix downwards. Afterwards each signature is
    compared with all before it that it is not joined with yet.
    """
    part, edges, need = np.arange(len(turned)), [], least * turned.shape[1]

    def join(i: int, j: int) -> None:
        if part[i] != part[j]:
            part[part == part[j]] = part[i]
            edges.append((i, j))

    close = np.flatnonzero((turned[1:] == turned[:-1]).sum(1) >= need)
    for i in close[np.argsort(-common[1:][close], kind="stable")].tolist():
        join(i, i + 1)
    for i in range(1, len(turned)):
        others = np.flatnonzero(part[:i] != part[i])
        if len(others):
            for j in others[(turned[others] == turned[i]).sum(1) >= need].tolist():
                join(i, j)
    return edges


def _regions(least: float, depth: int):
    """Joins inside the regions of one partition: rows sorted by region and turned signature."""

    def of_region(ids: np.ndarray, turned: np.ndarray) -> list[tuple[int, int]]:
        common = common_lengths(turned)
        common[1:] = np.maximum(common[1:], depth)  # a region's prefix is known by all of its bits
        return [(ids[i], ids[j]) for i, j in neighbours_joined(turned, common, least)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_id, held_row = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HASHES), np.uint8)

        def flush(upto: int) -> pa.RecordBatch:
            """The regions that end before ``upto``."""
            cuts = [0, *(np.flatnonzero(np.diff(held_key[:upto])) + 1).tolist(), upto]
            pairs = [p for s, e in zip(cuts[:-1], cuts[1:], strict=True) if e - s > 1 for p in of_region(held_id[s:e], held_row[s:e])]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            data, _ = utf8(batch.column("turned"))
            held_key = np.concatenate([held_key, batch.column("key").to_numpy()])
            held_id = np.concatenate([held_id, batch.column("doc_id").to_numpy()])
            held_row = np.concatenate([held_row, data.reshape(-1, HASHES)])
            last = int(np.searchsorted(held_key[::-1] != held_key[-1], True)) if len(held_key) else 0
            done = len(held_key) - last  # the last region may go on
            if done:
                yield flush(done)
                held_key, held_id, held_row = held_key[done:], held_id[done:], held_row[done:]
        if len(held_key):
            yield flush(len(held_key))

    return run


def linked(sets: list[np.ndarray], numerator: int, denominator: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that are similar enough, compared exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    joined, edges = Forest(len(sets)), []
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(1, 0)] if denominator * both >= numerator * (sizes.sum() - both) else []
    item, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(number, kind="stable")
    posting = owner[order]  # the sets of each item, ascending
    start = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(item)))])
    ends = np.cumsum(sizes)
    for i in range(1, len(sets)):
        own = number[ends[i] - sizes[i] : ends[i]]
        found = posting[ragged(start[own], start[own + 1] - start[own])]
        both = np.bincount(found, minlength=len(sets))
        good = denominator * both >= numerator * (sizes + sizes[i] - both)
        good[i:] = False
        for j in np.flatnonzero(good).tolist():
            if joined.join(i, j):
                edges.append((i, j))
    return edges


def _sets_of(docs: DataFrame, members: DataFrame, rows: int, words: int, broadcast_rows: int) -> DataFrame:
    """``members`` (doc_id, ...) with the column ``items``: their sorted shingle hashes, packed."""
    texts = docs.select("doc_id", "text")
    joined = texts.join(F.broadcast(members) if rows <= broadcast_rows else members, "doc_id")
    keep = [f.name for f in joined.schema.fields if f.name != "text"]
    schema = joined.drop("text").withColumn("items", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_pieces(whole, "text", 1 << 20):
                value, made = shingles(*utf8(batch.column("text")), words)
                ends = np.cumsum(made)
                items = [np.unique(value[e - m : e]).tobytes() for e, m in zip(ends.tolist(), made.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(items, pa.binary())], schema.names)
        release()

    return joined.mapInArrow(run, schema)


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]


def _exact(numerator: int, denominator: int, group: str):
    """True links (a spanning forest) inside each value of the column ``group``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(group, "ascending"), ("doc_id", "ascending")])
        ids, of = table.column("doc_id").to_numpy(), table.column(group).to_numpy()
        sets = _unpacked(table)
        cuts = [0, *np.flatnonzero(np.diff(of)) + 1, len(of)]
        pairs = [(ids[s + i], ids[s + j]) for s, e in zip(cuts[:-1], cuts[1:], strict=True) for i, j in linked(sets[s:e], numerator, denominator)]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _dense_links(items: DataFrame, numerator: int, denominator: int, depth: int, region_rows: int) -> DataFrame:
    """Links inside dense clusters: deeper regions first, then rare shingles for the rest.

    ``items``: doc_id, cluster, sketch, items.
    """
    items = checkpointed(items)
    narrow = items.select("doc_id", "cluster", "sketch")
    turned = F.expr(f"concat(substring(sketch, t * {depth} + 1), substring(sketch, 1, t * {depth}))")
    rows = narrow.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(DENSE_ORDERS - 1))).alias("t"), "cluster", "sketch").withColumn("turned", turned)
    found, deep = None, depth
    rows = checkpointed(rows.select("doc_id", "turned", F.xxhash64("cluster", "t").alias("region")))
    while True:
        rows = rows.withColumn("region", F.xxhash64("region", F.expr(f"substring(turned, 1, {deep})")))
        sizes = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
        sized = checkpointed(rows.join(sizes.where("n > 1"), "region"))
        fits = sized.where(F.col("n") <= region_rows).select("doc_id", "region")
        at_end = deep >= HASHES
        if at_end:  # signatures that agree to the end are compared with one of them
            fits = fits.unionByName(sized.where((F.col("n") > region_rows) & (F.col("doc_id") != F.col("least"))).select(F.explode(F.array("doc_id", "least")).alias("doc_id"), F.xxhash64("region", "doc_id").alias("region")))
        found = fits if found is None else found.unionByName(fits)
        rows = sized.where(F.col("n") > region_rows).select("doc_id", "turned", "region")
        if at_end or rows.isEmpty():
            break
        deep = min(HASHES, deep + DEEPER)
    exact = _exact(numerator, denominator, "region")
    first = checkpointed(items.select("doc_id", "items").join(found, "doc_id").groupBy("region").applyInArrow(exact, "a long, b long"))

    parts = narrow.select("doc_id", "cluster").join(connected_components(first).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    parts = checkpointed(parts)
    totals = parts.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    largest = totals.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("total"), (F.sum("n") - F.max("n")).alias("rest"))
    placed = parts.join(largest.where("rest > 0"), "cluster").select("doc_id", "cluster", "component", (F.col("component") != F.col("largest")).alias("asked"))
    return first.unionByName(_rest_links(items.drop("cluster", "sketch").join(placed, "doc_id"), numerator, denominator, region_rows))


def _items_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cluster and item of every item of the members."""
    for batch in batches:
        data, offsets = utf8(batch.column("items"))
        of = np.repeat(batch.column("cluster").to_numpy(), np.diff(offsets) // 8)
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(data.view(np.int64))], ["cluster", "item"])


def _prefixes(numerator: int, denominator: int):
    """The rarest items of each member, so many that two similar members share one of them."""

    def run(members: pa.Table, known: pa.Table) -> pa.Table:
        often = known.column("known").combine_chunks().flatten() if known.num_rows else pa.array([], pa.struct([("item", pa.int64()), ("n", pa.int64())]))
        item, n = often.field("item").to_numpy().view(np.uint64), often.field("n").to_numpy()
        order = np.argsort(item)
        item, n = item[order], n[order]
        out, size = [], []
        for own in _unpacked(members):
            at = np.minimum(np.searchsorted(item, own), max(0, len(item) - 1))
            count = np.where(item[at] == own, n[at], 0) if len(item) else np.zeros(len(own), np.int64)
            keep = len(own) + (-numerator * len(own)) // denominator + 1  # two sets this similar share the rest of either
            out.append(own[np.lexsort((own, count))[:keep]])
            size.append(len(own))
        times = np.array([len(x) for x in out], np.int64)
        which = pa.array(np.repeat(np.arange(len(out)), times))
        kept = members.select(["cluster", "doc_id", "component", "asked"]).take(which)
        return kept.append_column("size", pa.array(np.repeat(np.array(size, np.int64), times))).append_column("item", pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64)))

    return run


def _verified(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("items", "others"))
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            sizes = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64)
            good = pa.array(denominator * both >= numerator * (sizes - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return run


def _rest_links(members: DataFrame, numerator: int, denominator: int, bucket_rows: int) -> DataFrame:
    """Links of the asked members (those outside the largest component of their cluster) with members of other components.

    Two sets of the least similarity share an item among the rarest of each, in any one order; so
    members meet on these alone, and pairs that sizes allow are compared exactly. Which items are
    rare is estimated on a sample of members; the order decides the work, not the result.
    ``members``: doc_id, cluster, component, asked, items.
    """
    members = checkpointed(members)
    weights = members.groupBy("cluster").agg(F.count("*").alias("total"), F.sum(F.octet_length("items") / 8).cast("long").alias("weight"))
    weights = checkpointed(weights.select("cluster", F.ceil(F.col("total") / bucket_rows).alias("buckets"), F.greatest(F.lit(1), F.floor(F.col("weight") / SAMPLE_ITEMS)).alias("step")))
    sized = members.join(weights, "cluster")
    sampled = sized.where(F.pmod(F.xxhash64("doc_id"), "step") == 0).select("cluster", "items").mapInArrow(_items_of, "cluster long, item long")
    often = sampled.groupBy("cluster", "item").agg(F.count("*").alias("n")).where("n > 1")
    known = often.groupBy("cluster").agg(F.collect_list(F.struct("item", "n")).alias("known"))  # half of SAMPLE_ITEMS, about
    known = known.join(weights, "cluster").select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"), "known")
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), "buckets")).select("cluster", "bucket", "doc_id", "component", "asked", "items")
    kind = "cluster long, doc_id long, component long, asked boolean, size long, item long"
    marks = checkpointed(dealt.groupBy("cluster", "bucket").cogroup(known.groupBy("cluster", "bucket")).applyInArrow(_prefixes(numerator, denominator), kind))
    one = marks.where("asked").select("cluster", "item", F.col("doc_id").alias("a"), F.col("component").alias("part_a"), F.col("size").alias("size_a"))
    other = marks.select("cluster", "item", F.col("doc_id").alias("b"), F.col("component").alias("part_b"), F.col("size").alias("size_b"), F.col("asked").alias("also"))
    fits = F.least("size_a", "size_b") * denominator >= F.greatest("size_a", "size_b") * numerator
    pairs = one.join(other, ["cluster", "item"]).where((F.col("part_a") != F.col("part_b")) & fits & (~F.col("also") | (F.col("a") < F.col("b")))).select("a", "b").distinct()
    sets = members.select("doc_id", "items")
    full = pairs.join(sets.withColumnRenamed("doc_id", "a"), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("others")), "b")
    return full.mapInArrow(_verified(numerator, denominator), "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 3, numerator: int = 85, denominator: int = 100,
    region_rows: int = REGION_ROWS, cluster_rows: int = CLUSTER_ROWS, broadcast_rows: int = BROADCAST_ROWS, by_row: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept for every row.

    Documents are linked when denominator * intersection >= numerator * union of their sets.
    With ``by_row``, rows without an id are compared as well, and each row is told by the column
    row_key: of a component only the row with the smallest doc_id (null after all others), then
    the smallest row_key, is kept.
    """
    spark = ship(docs.sparkSession)
    # inside, a row's key stands for it; ids come in again at the end
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), row_key().alias("doc_id"), "text")
    depth, orders = forest_shape(numerator, denominator)
    rows = checkpointed(docs.mapInArrow(_describe(words, depth, orders), "id long, doc_id long, n_shingles long, set_a long, set_b long, sketch binary, keys array<long>"))
    same = ["n_shingles", "set_a", "set_b"]
    full = rows.where("n_shingles > 0" if by_row else "n_shingles > 0 AND id IS NOT NULL")
    first = F.struct(F.col("id").isNull().alias("none"), "id", F.col("doc_id").alias("row"))
    reps = checkpointed(full.groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.min(first).alias("first"), F.any_value("sketch").alias("sketch"), F.any_value("keys").alias("keys"), F.count("*").alias("same_rows")))

    keyed = reps.select("doc_id", F.posexplode("keys").alias("t", "key"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    met = checkpointed(keyed.join(counted, "key"))
    sketches = reps.select("doc_id", "sketch").join(met.select("doc_id").distinct(), "doc_id")
    # each order sorted: a region lies in one partition, its neighbours side by side
    turned = F.expr(f"concat(substring(sketch, t * {depth} + 1), substring(sketch, 1, t * {depth}))")
    sorted_ = met.where(F.col("n") <= region_rows).join(sketches, "doc_id").select("key", "doc_id", turned.alias("turned")).repartition("key").sortWithinPartitions("key", "turned", "doc_id")
    near = sorted_.mapInArrow(_regions(numerator / denominator - TOLERANCE, depth), "a long, b long")
    crowd = met.where(F.col("n") > region_rows).select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    clusters = checkpointed(connected_components(near.unionByName(crowd)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")))

    sized = checkpointed(clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster"))
    n = sized.count()
    plain = sized.where(F.col("n") <= cluster_rows).select("doc_id", "cluster")
    bins = max(spark.sparkContext.defaultParallelism, n // cluster_rows + 1)
    sets = _sets_of(docs, plain, n, words, broadcast_rows).dropDuplicates(["doc_id"]).withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins)))
    links = sets.groupBy("bin").applyInArrow(_exact(numerator, denominator, "cluster"), "a long, b long")
    dense = sized.where(F.col("n") > cluster_rows).select("doc_id", "cluster")
    if not dense.isEmpty():
        crowded = _sets_of(docs, dense.join(reps.select("doc_id", "sketch"), "doc_id"), n, words, broadcast_rows).dropDuplicates(["doc_id"])
        links = links.unionByName(_dense_links(crowded, numerator, denominator, depth, region_rows))
    parts = connected_components(links).withColumnRenamed("node", "rep")
    linked_ = reps.select(F.col("doc_id").alias("rep"), "first").join(parts, "rep")
    parts = checkpointed(parts.join(linked_.groupBy("component").agg(F.min("first").alias("least")), "component").select("rep", "least"))
    merged = reps.select(*same, "first", "same_rows", F.col("doc_id").alias("rep")).join(parts, "rep", "left")
    merged = checkpointed(merged.select(*same, "same_rows", F.coalesce("least", "first").alias("least")))
    told = (rows if by_row else rows.where("id IS NOT NULL")).select("id", "doc_id", *same)
    found = with_group(told.where("n_shingles > 0"), merged, same, "same_rows", rows.count()).drop("same_rows")
    found = found.unionByName(told.where("n_shingles = 0"), allowMissingColumns=True)
    if by_row:
        return found.select(
            F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"),
            F.coalesce(F.col("least.row") == F.col("doc_id"), F.lit(True)).alias("kept"), F.col("doc_id").alias("row_key"),
        )
    component = F.coalesce("least.id", "id")
    found = found.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), (component == F.col("id")).alias("kept"))
    return found.unionByName(rows.where("id IS NULL").select(F.col("id").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))
