"""Importance resampling towards a target distribution, by an external sort-count of feature buckets.

Features are runs of words, hashed into buckets. Texts are read once: each batch is written as one
packed stream of 16-bit bucket numbers with the offsets of its documents. To count, each stream
is sorted and run-length encoded, and the run lengths of a task are summed before they are
shuffled. The gain of a bucket (a log ratio of smoothed frequencies in target and corpus) is
then gathered along the streams, and np.add.reduceat sums it by document. Documents are drawn
without replacement by weight plus Gumbel noise (the highest scores), the noise being a
function of doc_id.

Ranks need no global sort: scores are integers of a bounded range, so the counts of scores
carry the ranks from score to score, and only documents of one score are ordered together.

Defined results: a null text has no features, weight 0 and is not eligible; an empty target
table counts as T = 0; a null doc_id has the noise of the text '<seed>:' and comes after all
ids of its score; rows sharing a doc_id share its noise and count each on their own, with
n_features deciding between equal scores; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, ship
from .arrow_text import in_pieces, ragged, release, utf8

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Features of more bytes are hashed one by one.
LONG_FEATURE = 48
#: Scores of one range: ranks are carried on by ranges, and inside a range by scores.
SCORE_RANGE = 128

_STREAM = "doc_id array<long>, n_words array<long>, offsets array<long>, stream binary"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1)).astype(np.uint32)
    return table


_CRC = _crc_table()
#: What each byte becomes: A-Z in lower case, bytes of words as they are, all others 0.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The crc32 of each span of ``data``: all spans advance together, byte by byte."""
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(lengths > LONG_FEATURE).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes())
    short = np.flatnonzero(lengths <= LONG_FEATURE)
    order = short[np.argsort(-lengths[short], kind="stable")]  # longest first: those that go on are a prefix
    own, at = -lengths[order], starts[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(-own[0]) if len(own) else 0):
        live = int(np.searchsorted(own, -k, "left"))
        state[:live] = _CRC[(state[:live] ^ data[at[:live] + k]) & 0xFF] ^ (state[:live] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, offsets of its features (n + 1), and the buckets of all features in order of run length within a text."""
    folded = _FOLD[data]
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]  # a word ends with its text
    starts = np.flatnonzero(first)
    stop = np.append(starts, len(data))[1:]
    gaps = np.flatnonzero(~inside)
    if len(gaps):
        after = np.searchsorted(gaps, starts)
        stop = np.minimum(stop, np.where(after < len(gaps), gaps[np.minimum(after, len(gaps) - 1)], len(data)))
    lengths = stop - starts
    owner = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(owner, minlength=len(offsets) - 1)[: len(offsets) - 1] if len(starts) else np.zeros(len(offsets) - 1, np.int64)
    if longest_run == 1:
        found, of = crc32_of(folded, starts, lengths) % np.uint32(buckets), owner
    else:  # runs are spans of the words written with one space after each
        line = np.full(int((lengths + 1).sum()), 32, np.uint8)
        at = np.cumsum(lengths + 1) - (lengths + 1)
        line[ragged(at, lengths)] = folded[ragged(starts, lengths)]
        runs, owners, kinds = [], [], []
        for n in range(1, longest_run + 1):
            head = np.flatnonzero(owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :])
            runs.append(crc32_of(line, at[head], at[head + n - 1] + lengths[head + n - 1] - at[head]) % np.uint32(buckets))
            owners.append(owner[head])
            kinds.append(np.full(len(head), n))
        found, of = np.concatenate(runs), np.concatenate(owners)
        order = np.lexsort((np.concatenate(kinds), of))
        found, of = found[order], of[order]
    cuts = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(of, minlength=len(offsets) - 1)[: len(offsets) - 1] if len(of) else np.zeros(len(offsets) - 1, np.int64), out=cuts[1:])
    return n_words.astype(np.int64), cuts, found.astype("<u2")


def bucket_streams(docs: DataFrame, longest_run: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """One row per batch of documents (doc_id, text): ids, words, offsets and the packed buckets of their features."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("bucket numbers are of 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_pieces(batch, "text"):
                n_words, cuts, found = features(*utf8(part.column("text")), longest_run, buckets)
                packed = pa.array([found.tobytes()], pa.binary())
                one = lambda x: pa.array([x], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([one(part.column("doc_id").to_pylist()), one(n_words), one(cuts), packed], ["doc_id", "n_words", "offsets", "stream"])
        release()

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _STREAM)


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all streams fall into each bucket; ``buckets`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column("stream"):
                stream = np.sort(np.frombuffer(packed.as_buffer(), "<u2"))
                heads = np.flatnonzero(np.diff(stream, prepend=-1 if not len(stream) else int(stream[0]) - 1))
                held[stream[heads]] += np.diff(heads, append=len(stream))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for bucket, n in streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed frequencies) of each bucket."""
    buckets, s, t = len(corpus), corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of each document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, words, cuts = (batch.column(k)[row].values for k in range(3))
                cuts = cuts.to_numpy()
                n = np.diff(cuts)
                some, weight = np.flatnonzero(n), np.zeros(len(n), np.int64)
                if len(some):
                    gathered = gains[np.frombuffer(batch.column(3)[row].as_buffer(), "<u2")]
                    weight[some] = np.add.reduceat(gathered, cuts[:-1][some]) // n[some]
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
        release()

    return streams.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """With score: weight plus Gumbel noise in thousandths, from the first 32 bits of sha256('<seed>:<doc_id>')."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: rank is 1, 2, 3... of the drawn, null for all others.

    Rows equal in all of these count together (no task orders them) and come out as often as
    they went in.
    """
    keys = ["doc_id", "n_features", "weight", "score", "eligible"]
    held = checkpointed(rows.withColumn("eligible", F.col("n_words") >= least_words).groupBy(*keys).agg(F.count("*").alias("n")))
    scores = held.where("eligible").groupBy("score").agg(F.sum("n").alias("of_score")).withColumn("range", F.floor(F.col("score") / SCORE_RANGE))
    ranges = scores.groupBy("range").agg(F.sum("of_score").alias("of_range"))
    higher = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("of_range").over(higher), F.lit(0)).alias("above_range"))
    inside = Window.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = (held.where("eligible").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
    # the range of scores is bounded by that of gains and noise: some ten thousands of integers
    above = scores.join(F.broadcast(ranges), "range").withColumn("above", F.col("above_range") + F.coalesce(F.sum("of_score").over(inside), F.lit(0)))
    above = F.broadcast(above.where(F.col("above") < wanted).select("score", "above"))
    near = held.where("eligible").join(above, "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("first", F.col("above") + F.sum("n").over(order) - F.col("n"))
    near = near.select(*keys, F.explode(F.expr("sequence(first + 1, first + n)")).alias("rank"))
    near = near.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = held.join(above.select("score", F.lit(True).alias("near")), "score", "left").where("NOT eligible OR near IS NULL")
    rest = rest.select(*keys, F.explode(F.expr("sequence(1L, n)")).alias("rank")).withColumn("rank", F.lit(None).cast("long"))
    return near.unionByName(rest).drop("eligible")


def resample(docs: DataFrame, target: DataFrame, longest_run: int = LONGEST_RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The ``draw`` of documents (doc_id, text) towards the texts of ``target`` (text)."""
    streams = checkpointed(bucket_streams(docs, longest_run, buckets))
    wanted = bucket_counts(bucket_streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest_run, buckets), buckets)
    gains = gains_of(bucket_counts(streams, buckets), wanted)
    return draw(scored(weigh(streams, gains), seed), percent, least_words)
