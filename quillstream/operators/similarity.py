"""Joins of word sets by similarity: prefixes of rare words first, exact counts for what remains.

Words have one order for both sides, rare ones first. Two sets that share at least a words have
one of these among the first size - a + 1 words of each, so only these prefixes meet, in an
equality join; sizes and the places of the word in both sets rule out further pairs before
the sets are compared. A pair is compared where its first common word meets, so once.
Where one side has few words, every task holds an index of them and counts without a join.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship

#: Word and set tables up to this many rows are broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 100_000
#: Counters that a task holds at once while it counts by an index.
CELLS = 1 << 22
#: Types of ids that an index gives back.
ID_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
#: Least similarities that the search for best partners goes through, one round each.
ROUNDS = (0.75, 0.5, 0.3, 0.15, 0.0)


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def ordered_sets(sets: DataFrame, keys: list[str], frequencies: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """keys, size (of the whole set) and own: the words that ``frequencies`` (word, n) has, rare ones first.

    ``sets`` holds keys and words (an array without repeats).
    """
    rows = sets.select(*keys, F.size("words").alias("size"), F.explode("words").alias("word")).join(_small(frequencies, most), "word")
    listed = F.array_sort(F.collect_list(F.struct("n", "word")))
    return rows.groupBy(*keys).agg(F.first("size").alias("size"), F.transform(listed, lambda x: x["word"]).alias("own"))


def frequencies(sets: DataFrame) -> DataFrame:
    """How many sets hold each word: word, n."""
    return sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _prefix(rows: DataFrame, keep: Column, place: str) -> DataFrame:
    """One row for each of the first ``keep`` words, with its place from 1."""
    return rows.select("*", F.posexplode(F.slice("own", F.lit(1), F.greatest(keep, F.lit(0)))).alias(place, "word")).withColumn(place, F.col(place) + 1)


def candidates(left: DataFrame, right: DataFrame, need: Column, keep_left: Column, keep_right: Column, most: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs of ordered sets that may share ``need`` words, one row for each common word of the prefixes.

    ``left`` and ``right`` are those of ``ordered_sets`` with other column names (size and own
    are left_size, left_own, right_size and right_own); ``need`` may use both sizes, the lengths
    of prefixes those of their own side.
    """
    a = _prefix(left.withColumn("own", F.col("left_own")), keep_left, "left_place").drop("own")
    b = _prefix(right.withColumn("own", F.col("right_own")), keep_right, "right_place").drop("own")
    met = a.join(_small(b, most), "word").withColumn("need", need)
    reach = F.least(F.size("left_own") - F.col("left_place"), F.size("right_own") - F.col("right_place")) + 1
    return met.where(reach >= F.col("need"))


def verified(found: DataFrame) -> DataFrame:
    """``candidates`` with ``shared``, the number of common words, each pair once."""
    # a generator keeps the intersection from being worked out once for each use
    common = F.transform(F.array(F.array_intersect("left_own", "right_own")), lambda c: F.struct(F.get(c, F.lit(0)).alias("first"), F.size(c).alias("shared")))
    rows = found.select("*", F.inline(common))
    return rows.where((F.col("first") == F.col("word")) & (F.col("shared") >= F.col("need"))).drop("first", "word")


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = lambda df, side: df.withColumnRenamed("size", f"{side}_size").withColumnRenamed("own", f"{side}_own")
    return named(left, "left"), named(right, "right")


def overlap_candidates(sets: DataFrame, keys: list[str], others: DataFrame, other: str, least_percent: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Candidates for an overlap (shared words over the smaller size) of ``least_percent`` and more."""
    words = checkpointed(frequencies(others))
    right = checkpointed(ordered_sets(others, [other], words, most))
    smallest = right.agg(F.min("size")).first()[0] or 1
    left, right = _sides(ordered_sets(sets, keys, words, most), right)
    least = lambda size: F.greatest(F.lit(1), F.ceil(size * least_percent / 100)).cast("int")
    own = least(F.least("left_size", F.lit(smallest)))
    return candidates(left, right, least(F.least("left_size", "right_size")), F.size("left_own") - own + 1, F.size("right_own"), most)


def _by_index(sets: DataFrame, keys: list[str], others: list, other: str, kind: str, least_percent: int, words: Callable[[str], Collection[str]] | None) -> DataFrame:
    """``overlaps`` with the few ``others`` (rows of id and words) as an index in every task: a set's words count where it lies."""
    spark = ship(sets.sparkSession)
    shared = spark.sparkContext.broadcast([(r[0], list(r[1])) for r in others])
    given, id_type = "words" if words is None else "text", ID_TYPES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        sizes, index = np.array([len(w) for _, w in table], np.int64), {}
        for at, (_, own) in enumerate(table):
            for w in own:
                index.setdefault(w, []).append(at)
        number = {w: k for k, w in enumerate(index)}
        lengths = np.array([len(x) for x in index.values()], np.int64)
        begins, holders = np.cumsum(lengths) - lengths, np.array([at for x in index.values() for at in x], np.int64)
        ids = pa.array([k for k, _ in table], id_type)
        step = max(1, CELLS // max(1, len(holders)))  # no set has more counters or more hits than the index has words
        for batch in batches:
            for part in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
                held = [words(t) if words else t for t in part.column(given).to_pylist()]
                known = [[number[w] for w in own if w in number] for own in held]
                row = np.repeat(np.arange(len(held)), [len(x) for x in known])
                word = np.array([k for x in known for k in x], np.int64)
                times = lengths[word]
                inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                counts = np.bincount(np.repeat(row, times) * len(table) + holders[np.repeat(begins[word], times) + inside], minlength=len(held) * len(table))
                met = np.flatnonzero(counts)
                left, right, count = met // len(table), met % len(table), counts[met]
                smaller = np.minimum(np.array([len(x) for x in held], np.int64)[left], sizes[right])
                good = count * 100 >= smaller * least_percent
                left, right = pa.array(left[good]), pa.array(right[good])
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(left) for k in keys), ids.take(right), pa.array(count[good]), pa.array(smaller[good].astype(np.int32))], [*keys, other, "shared", "smaller"])

    schema = ", ".join([*(f"`{k}` {sets.schema[k].dataType.simpleString()}" for k in keys), f"`{other}` {kind}", "shared long, smaller int"])
    return sets.select(*keys, given).mapInArrow(run, schema)


def overlaps(sets: DataFrame, keys: list[str], others: DataFrame, other: str, least_percent: int, most: int = BROADCAST_ROWS, words: Callable[[str], Collection[str]] | None = None) -> DataFrame:
    """keys, ``other``, shared and smaller of all pairs whose overlap is ``least_percent`` and more.

    ``sets``: keys, words. ``others`` (the smaller table): other, words. Sets without words pair
    with nothing. Up to ``most`` words of all others are an index in every task; ``sets`` may then
    hold text, from which ``words`` tells the words.
    """
    others = checkpointed(others.select(other, "words").where(F.size("words") > 0))
    kind = others.schema[other].dataType.simpleString()
    if kind in ID_TYPES and (others.agg(F.sum(F.size("words"))).first()[0] or 0) <= most:
        return _by_index(sets, keys, others.collect(), other, kind, least_percent, words)
    found = verified(overlap_candidates(sets, keys, others, other, least_percent, most))
    return found.select(*keys, other, F.col("shared").cast("long").alias("shared"), F.least("left_size", "right_size").alias("smaller"))


def best_partner(items: DataFrame, rounds: tuple[float, ...] = ROUNDS, most: int = BROADCAST_ROWS) -> DataFrame:
    """id, other, similarity: for each set (id, words) the other one with the largest share of common words in the larger set.

    Ties go to the smallest id; a set that shares no word has no row. Each round joins the sets
    that have no partner yet at a lower least similarity, at which nothing above it is missed,
    so only sets without a near partner come to the rounds with long prefixes.
    """
    words = checkpointed(frequencies(items))
    whole = checkpointed(ordered_sets(items, ["id"], words, most))
    todo, done = whole, None
    for least in rounds:
        # shared >= least * larger size, so both sizes differ by that factor at most
        share = lambda size, t=least: F.greatest(F.lit(1), F.ceil(F.lit(t) * size)).cast("int")
        left, right = _sides(todo, whole.withColumnRenamed("id", "other"))
        need = share(F.greatest("left_size", "right_size"))
        found = candidates(left, right, need, F.col("left_size") - share(F.col("left_size")) + 1, F.col("right_size") - share(F.col("right_size")) + 1, most)
        pairs = verified(found.where((F.col("id") != F.col("other")) & (F.least("left_size", "right_size") >= F.col("need"))))
        similarity = F.col("shared") / F.greatest("left_size", "right_size")
        best = pairs.groupBy("id").agg(F.min(F.struct((-similarity).alias("s"), "other")).alias("m")).select("id", "m.other", (-F.col("m.s")).alias("similarity"))
        best = checkpointed(best)
        done = best if done is None else done.unionByName(best)
        todo = checkpointed(todo.join(best.select("id"), "id", "left_anti"))
        if todo.isEmpty():
            break
    return done
