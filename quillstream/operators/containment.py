"""Texts inside longer texts, found without comparing pairs and without shuffling text for each place.

A part of ``least`` bytes or more has a head: its first least, 2 * least, 4 * least, ... bytes, as many
as it holds. Each window of such a width has an anchor that its content selects: the place
of the smallest hash among its grams of half that width, the first of equal ones. Where a part lies
inside a whole, its head is a window there with the same anchor, so both meet in an equality join on the
hash of the anchor's gram. Windows that follow one another mostly share their anchor: a whole has
about one anchor for each seven bytes at the least width of 24 and half as many at each further one.

Rows hold places, never text. A place meets the lengths of the parts with its gram, not the parts,
so near copies of one text do not make pairs of all of them. Hashes only lead to what is compared:
pieces are cut out of the whole at these places and told by their SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship

#: Longest heads are least << (STEPS - 1) bytes.
STEPS = 16
#: Bytes of text that are hashed at once (one text at least), windows whose anchors are found at once.
PIECE_BYTES, BLOCK = 4 << 20, 1 << 21
#: An anchor is told by the upper bits of its hash, then by its place in the block.
LOW = np.uint64((1 << 24) - 1)
ODD = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    """The value ``n`` places further on; 0 beyond the end."""
    return np.concatenate([x[n:], np.zeros(min(n, len(x)), x.dtype)])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def anchors(data: np.ndarray, lengths: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each width the anchors of all texts: text, place, hash, and their places in the last and the first window that selects them."""
    gram, text = least // 2, np.arange(len(lengths))
    hashes = np.zeros(len(data), np.uint64)
    for k in range(gram):
        hashes = hashes * ODD + _ahead(data, k) + np.uint64(1)
    hashes = _mixed(hashes)
    for step in range(STEPS):
        width = least << step
        long = lengths >= width
        if not long.any():
            return
        if not long.all():
            hashes, text, lengths = hashes[np.repeat(long, lengths)], text[long], lengths[long]
        begins = np.cumsum(lengths) - lengths
        chosen = np.empty(len(hashes) - width + 1, np.int64)
        for s in range(0, len(chosen), BLOCK):
            e = min(s + BLOCK, len(chosen))
            x = hashes[s : e + width - gram]
            x = _least((x & ~LOW) | np.arange(len(x), dtype=np.uint64), width - gram + 1)
            chosen[s:e] = (x & LOW).astype(np.int64) + s
        starts = _ranges(begins, lengths - width + 1)
        at = chosen[starts]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        at, own = at[first], np.repeat(np.arange(len(lengths)), lengths - width + 1)[first]
        yield text[own], at - begins[own], hashes[at].view(np.int64), at - starts[last], at - starts[first]
        hashes, gram = _mixed(hashes * ODD + _ahead(hashes, gram)), 2 * gram


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first row, bytes and lengths of the texts, about PIECE_BYTES at a time."""
    column, n, start = batch.column("text").cast(pa.large_binary()), batch.num_rows, 0
    _, offsets, data = column.buffers()
    if not n or data is None:
        return
    offsets, data = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8), np.frombuffer(data, np.uint8)
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PIECE_BYTES, "right")) - 1)
        yield start, data[offsets[start] : offsets[end]], np.diff(offsets[start : end + 1])
        start = end


def _places(wholes: DataFrame, least: int) -> DataFrame:
    """id, key, place, low, high: all anchors of the texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for start, data, lengths in _pieces(batch):
                for text, place, key, low, high in anchors(data, lengths, least):
                    small = [pa.array(x.astype(np.int32)) for x in (place, low, high)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[start + text]), pa.array(key), *small], ["id", "key", "place", "low", "high"])

    return wholes.select("id", "text").mapInArrow(run, "id long, key long, place int, low int, high int")


def _heads(parts: DataFrame, least: int) -> DataFrame:
    """key, ahead, size: the anchor's hash and place in the heads of the texts, and the lengths of these, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, sizes in _pieces(batch):
                steps = np.minimum(np.log2(np.maximum(sizes // least, 1)).astype(np.int64), STEPS - 1)
                lengths = np.minimum(sizes, least << steps)
                for step, (text, place, key, _, _) in enumerate(anchors(data[_ranges(np.cumsum(sizes) - sizes, lengths)], lengths, least)):
                    own = (steps[text] == step) & (sizes[text] >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(place[own].astype(np.int32)), pa.array(sizes[text[own]].astype(np.int32))], ["key", "ahead", "size"])

    return parts.select("text").mapInArrow(run, "key long, ahead int, size int").distinct()


def pieces(wholes: DataFrame, parts: DataFrame, least: int, *more: str) -> DataFrame:
    """``more`` of the wholes and the digests (SHA-256) of pieces of theirs, among them all that equal one of ``parts``.

    wholes: id (long), text, and the columns ``more``; parts: text, of ``least`` bytes or more. Both are read twice
    and should be checkpointed.
    """
    ship(wholes.sparkSession)
    met = _places(wholes, least).join(_heads(parts, least), "key").where(F.col("ahead").between(F.col("low"), F.col("high")))
    met = met.select("id", (F.col("place") - F.col("ahead")).alias("start"), "size")
    raw = F.col("text").cast("binary")
    cut = wholes.select("id", "text", *more).join(met, "id").where(F.col("start") + F.col("size") <= F.octet_length("text"))
    return cut.select(*more, F.sha2(F.substring(raw, F.col("start") + 1, F.col("size")), 256).alias("digest"))


def numbered(texts: DataFrame) -> DataFrame:
    """``texts`` with an id and the digest of the column ``text``, checkpointed."""
    return checkpointed(texts.select(F.monotonically_increasing_id().alias("id"), "*", F.sha2(F.col("text").cast("binary"), 256).alias("digest")))
