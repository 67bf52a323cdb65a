"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are grouped by length into buckets of bounded size. The buckets of the longest
vectors are searched first and give every query a global lower bound of its k-th best score.
In each further bucket a query has the local cosine threshold bound / (|query| * longest in
the bucket): over one, the whole bucket is skipped; high, candidates are found by coordinate
pruning (coordinates of a candidate must lie in the interval that the threshold leaves around
the query's largest coordinates); else by length pruning (only the longest vectors that can
still reach the bound). What remains is verified by exact integer products.

Queries meet buckets in blocks: a task holds one bucket and one block of queries. Which blocks
need which buckets is worked out on classes of lengths and levels of bounds, before any vector
moves. Blocks and buckets grow with the tables, up to ``TILE_ROWS``, as a vector moves once for
each block of queries that needs its bucket.

Products of two lengths below 2**62 are exact in 64 bits. Beyond it, doubles with a bound of
their error choose the candidates that may be among the best, and these are multiplied in
integers of any size.

Defined results: vectors that are null, empty or hold null or non-finite components (or such
that are no longer finite after scaling) take no part, nor do rows without vec_id; a score
outside of 64 bits is ranked by its exact value and shown as the nearest long; vectors of
different dimensions do not meet; rows sharing a vec_id are one another's own and so never each
other's candidates, a repeated query row is asked once and a repeated candidate row ranks as
often as it occurs; with fewer than k candidates all are returned; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, ship

K = 10
#: Vectors of a bucket and queries of a block on average, and how far both grow for large tables.
BUCKET_ROWS, BLOCK_QUERIES, TILE_ROWS = 8192, 4096, 32_768
#: Buckets (and blocks) from which they grow.
TILES = 1024
#: Length classes to an octave of squared length.
CLASSES_AN_OCTAVE = 8
#: Local cosine threshold from which coordinates prune, and how many coordinates do.
COORDINATE_COSINE, FOCUS = 0.6, 4
#: Vectors verified between two updates of the bounds.
SLICE = 1024
#: Levels of need by which queries are put into blocks.
LEVELS = 32
#: Lengths whose product stays below this have scores of 64 bits.
PLAIN = 2.0**62

#: ``beyond`` orders scores that do not fit into a long; null for all others.
_FOUND = "query_id long, vec_id long, score long, beyond string"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component), dim and squared length of usable rows."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda e: e * scale)
    finite = lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(e), F.lit(True))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(x, finite)
    whole = lambda e: F.when(F.abs(e) < 2.0**53, F.floor(e).cast("double")).otherwise(e)  # noqa: E731  larger doubles have no fraction
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e).alias("square"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of lengths below ``PLAIN``; doubles hold them up to 2**53, longs beyond."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[-1]) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _sortable(score: int) -> str | None:
    """Text that sorts as the score does, for scores that do not fit into a long."""
    if abs(score) < (1 << 63) - 1:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):04d}{digits}"
    return f"{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def best_of_any_length(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query position, vec_id, score) of the k best candidates of each query, of components of any size.

    Doubles of the query by its own power of two and of the candidates by 2**-40 do not
    overflow, and err by less than ``slack``; what is not surely behind the k-th is exact.
    """
    small = c * 2.0**-40
    reach = np.sqrt(np.square(small / max(1.0, float(np.abs(small).max(initial=0)))).sum(1)) * max(1.0, float(np.abs(small).max(initial=0)))
    for i in range(len(q)):
        other = np.flatnonzero(c_id != q_id[i])
        if not len(other):
            continue
        unit = q[i] * 2.0 ** -np.ceil(np.log2(max(1.0, float(np.abs(q[i]).max()))))
        near = small[other] @ unit
        slack = reach[other] * len(unit) ** 2 * 2.0**-50 + 1e-300
        if len(other) > k:
            least = np.partition(near - slack, len(other) - k)[len(other) - k]
            other = other[near + slack >= least]
        own = [int(x) for x in q[i].tolist()]
        found = sorted((-sum(a * int(b) for a, b in zip(own, c[j].tolist(), strict=True)), int(c_id[j])) for j in other.tolist())
        for score, vec in found[:k]:
            yield i, vec, -score


def best_in_bucket(q: np.ndarray, q_id: np.ndarray, bound: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vec_id, score) of candidates that may be among the k best.

    ``bound`` is a score that k other candidates of the query reach; -inf if unknown.
    """
    length = np.sqrt((c * c).sum(1))
    order = np.lexsort((c_id, -length))
    c, c_id, length = c[order], c_id[order], length[order]
    q_length = np.sqrt((q * q).sum(1))
    unit_q = q / np.maximum(q_length, 1e-300)[:, None]
    unit_c = c / np.maximum(length, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
    bound = bound.astype(np.float64).copy()
    out_q, out_id, out_score = [], [], []
    for a in range(0, len(c), SLICE):
        part, ids, longest = c[a : a + SLICE], c_id[a : a + SLICE], length[a]
        reach = q_length * longest
        slack = 1e-6 * reach + 1e-6
        live = np.flatnonzero(~(reach + slack < bound))  # the others skip the rest of the bucket's slice
        if not len(live):
            continue
        cosine = np.where(reach[live] > 0, np.maximum(bound[live] - slack[live], -1e300) / np.maximum(reach[live], 1e-300), -np.inf)
        by_coordinate = cosine >= COORDINATE_COSINE
        hits_q, hits_c = [], []
        plain = live[~by_coordinate]
        if len(plain):  # a prefix of the slice, as long as the weakest query needs
            need = np.where(q_length[plain] > 0, (bound[plain] - slack[plain]) / np.maximum(q_length[plain], 1e-300), -np.inf)
            last = np.searchsorted(-length[a : a + SLICE], -need, "right")
            top = int(last.max(initial=0))
            scores = _products(q[plain], part[:top])
            i, j = np.nonzero((scores >= bound[plain][:, None]) & (np.arange(top) < last[:, None]))
            hits_q.append(plain[i])
            hits_c.append(np.stack([j, scores[i, j]]))
        for i, t in zip(live[by_coordinate].tolist(), cosine[by_coordinate].tolist(), strict=True):
            t = min(1.0, t)
            keep = np.arange(len(part))
            for f in focus[i]:
                x = unit_q[i, f]
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                own = unit_c[a : a + SLICE, f][keep]
                low = x * t - spread if x > -t else -1.0
                high = x * t + spread if x < t else 1.0
                keep = keep[(own >= low - 1e-9) & (own <= high + 1e-9)]
            if len(keep):
                scores = _products(q[i : i + 1], part[keep])[0]
                good = scores >= bound[i]
                hits_q.append(np.full(int(good.sum()), i))
                hits_c.append(np.stack([keep[good], scores[good]]))
        if not hits_q:
            continue
        i, (j, s) = np.concatenate(hits_q), np.concatenate(hits_c, 1)
        other = ids[j] != q_id[i]
        i, j, s = i[other], j[other], s[other]
        out_q.append(i)
        out_id.append(ids[j])
        out_score.append(s)
        i, ids_now, s = np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)
        order = np.lexsort((ids_now, -s, i))
        i, ids_now, s = i[order], ids_now[order], s[order]
        first = np.searchsorted(i, i, "left")
        place = np.arange(len(i)) - first
        top = place < k
        out_q, out_id, out_score = [i[top]], [ids_now[top]], [s[top]]
        kth = place == k - 1
        bound[i[kth]] = np.maximum(bound[i[kth]], s[kth])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return out_q[0], out_id[0], out_score[0]


def _best(q: np.ndarray, q_id: np.ndarray, bound: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int) -> Iterator[pa.Table]:
    """The results of one bucket and block, ``BLOCK_QUERIES`` queries at a time."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    with np.errstate(over="ignore"):
        longest, lengths = np.sqrt((c * c).sum(1)).max(), np.sqrt((q * q).sum(1))
    plain = lengths * longest < PLAIN
    some = np.flatnonzero(plain)
    for a in range(0, len(some), BLOCK_QUERIES):
        part = some[a : a + BLOCK_QUERIES]
        i, vec, score = best_in_bucket(q[part], q_id[part], bound[part], c, c_id, k)
        yield pa.table([pa.array(x, t) for x, t in zip((q_id[part][i], vec, score, [None] * len(i)), kinds, strict=True)], names=_NAMES)
    wide = np.flatnonzero(~plain)
    if len(wide):
        top = (1 << 63) - 1
        rows = [(int(q_id[wide[i]]), vec, max(-top, min(top, score)), _sortable(score)) for i, vec, score in best_of_any_length(q[wide], q_id[wide], c, c_id, k)]
        yield pa.table([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], names=_NAMES)


def _search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each bucket.

    ``candidates``: vec_id, v, dim, bucket, blocks (those that need the bucket). ``queries``:
    query_id, v, dim, block, bound, buckets (those that may hold better ones).
    """
    left = candidates.select("bucket", F.explode("blocks").alias("block"), "dim", "vec_id", "v")
    right = queries.select(F.explode("buckets").alias("bucket"), "block", "query_id", F.col("v").alias("q"), "bound")

    def run(key: tuple, c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return pa.table({n: pa.array([], pa.string() if n == "beyond" else pa.int64()) for n in _NAMES})
        dim = c.column("dim")[0].as_py()
        bound = np.array(q.column("bound").fill_null(-np.inf).to_numpy())
        return pa.concat_tables(_best(_matrix(q.column("q"), dim), q.column("query_id").to_numpy(), bound, _matrix(c.column("v"), dim), c.column("vec_id").to_numpy(), k))

    return left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInArrow(run, _FOUND)


def top_k(vectors: DataFrame, asked, k: int = K, bucket_rows: int = BUCKET_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row where ``asked`` holds.

    ``asked`` is a condition on vec_id. Ties go to the smaller vec_id.
    """
    spark = ship(vectors.sparkSession)
    rows = integer_vectors(vectors)
    size_class = F.floor(F.log2(F.least(F.greatest(F.col("square"), F.lit(1.0)), F.lit(1e308))) * CLASSES_AN_OCTAVE).cast("int")
    rows = checkpointed(rows.withColumn("class", size_class))
    # a row for each dimension and length class: bounded by the range of lengths, not by the data
    classes = rows.groupBy("dim", "class").agg(F.count("*").alias("n"), F.sum(F.when(asked, 1).otherwise(0)).alias("asked"), F.sqrt(F.max("square")).alias("longest")).collect()
    if not classes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    grown = lambda rows, least: max(least, min(TILE_ROWS, rows // TILES))
    bucket_rows, block_queries = grown(sum(r["n"] for r in classes), bucket_rows), grown(sum(r["asked"] for r in classes), block_queries)
    # buckets are numbered by falling length within a dimension; the first ones, enough for k, are the seeds
    table, seeds, number = [], {}, 0
    for dim in sorted({r["dim"] for r in classes}):
        seeded, seeds[dim] = 0, []
        for r in sorted((r for r in classes if r["dim"] == dim), key=lambda r: -r["class"]):
            parts = -(-r["n"] // bucket_rows)
            table.append((dim, r["class"], parts, number, r["longest"]))
            for p in range(parts):
                if seeded < bucket_rows:
                    seeds[dim].append(number + p)
                    seeded += r["n"] // parts
            number += parts
    blocks = max(1, -(-sum(r["asked"] for r in classes) // block_queries))
    layout = F.broadcast(spark.createDataFrame([t[:4] for t in table], "dim int, class int, parts int, first int"))
    placed = rows.join(layout, ["dim", "class"]).withColumn("bucket", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), "parts")).cast("int"))
    asked_rows = rows.where(asked).select(F.col("vec_id").alias("query_id"), "v", "dim", F.sqrt("square").alias("length")).distinct()

    early = F.col("bucket").isin([b for own in seeds.values() for b in own])
    first = F.broadcast(spark.createDataFrame(list(seeds.items()), "dim int, buckets array<int>"))
    spread = asked_rows.join(first, "dim").select("*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(None).cast("double").alias("bound"))
    seed = checkpointed(_search(placed.where(early).withColumn("blocks", F.sequence(F.lit(0), F.lit(blocks - 1))), spread, k))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    if sum(map(len, seeds.values())) < number:
        bounds = seed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        # a score below all longs is no bound
        bounds = bounds.where(F.col("beyond").isNull() | (F.col("score") > 0)).select("query_id", F.col("score").cast("double").alias("bound"))
        seed = seed.unionByName(_rest(spark, placed.where(~early), asked_rows.join(bounds, "query_id", "left"), table, seeds, k, block_queries))
    return seed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rest(spark, candidates: DataFrame, queries: DataFrame, table: list[tuple], seeds: dict[int, list[int]], k: int, block_queries: int) -> DataFrame:
    """The search of all buckets but the seeds, by queries (with bound) that may find better there.

    A query needs buckets down to the length at which even a parallel vector falls below its
    bound. Queries of like need share a level, and blocks hold queries of one level, so a
    vector moves to the blocks that need its bucket, and a query to the buckets that it needs.
    """
    reach = F.when(F.col("length") > 0, (F.col("bound") - 1e-6) / (F.col("length") * (1 + 1e-6)))
    queries = checkpointed(queries.withColumn("need", F.coalesce(reach, F.lit(-1e300))))
    count = min(LEVELS, queries.count() // block_queries)  # no more levels than full blocks
    cuts = sorted(set(queries.approxQuantile("need", [i / count for i in range(1, count)], 0.005))) if count > 1 else []
    level = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("need")))
    queries = queries.withColumn("level", level)
    levels = queries.groupBy("dim", "level").agg(F.count("*").alias("n"), F.min("need").alias("need")).collect()  # LEVELS for each dimension at most
    plan, needed, number = [], {(d, c): [] for d, c, *_ in table}, 0
    for r in sorted(levels, key=lambda r: (r["dim"], r["level"])):
        own = -(-r["n"] // block_queries)
        buckets = []
        for dim, size_class, parts, first, longest in table:
            if dim == r["dim"] and longest >= r["need"]:
                buckets += [first + p for p in range(parts) if first + p not in seeds[dim]]
                needed[dim, size_class] += range(number, number + own)
        plan.append((r["dim"], r["level"], number, own, buckets))
        number += own
    plan = F.broadcast(spark.createDataFrame(plan, "dim int, level int, first_block int, level_blocks int, buckets array<int>"))
    needed = F.broadcast(spark.createDataFrame([(d, c, b) for (d, c), b in needed.items()], "dim int, class int, blocks array<int>"))
    block = (F.col("first_block") + F.pmod(F.xxhash64("query_id"), "level_blocks")).cast("int")
    return _search(candidates.join(needed, ["dim", "class"]), queries.join(plan, ["dim", "level"]).withColumn("block", block), k)
