"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Every row gets a fingerprint of its normalised text (white space of ``[\\x20\\x09-\\x0D]``
   deleted); only these narrow rows are kept.
2. Each source partition sorts its distinct fingerprints and sends them, Golomb-Rice coded, to
   the owner of their range.
3. Owners decode what all sources sent and answer every message with a bitmap: bit i says
   that its i-th fingerprint was also sent by another message.
4. Rows whose bit is set (or that repeat inside their own message) are suspects. Only their
   texts are read again, shuffled and grouped by the bytes themselves, which settles equality.

A message carries each fingerprint once, so a text that a third of all rows share costs an
owner one entry a message; the byte check pre-aggregates before its shuffle.

Defined results: null text counts as empty; empty texts form one group; a null doc_id comes
after all others, and a group of null ids alone has a null keep_id; a row that repeats
another's doc_id and text counts in ``group_size`` and only one of the two is ``kept``; an
empty table gives an empty result; other columns of the input are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship
from .rows import row_key, with_group

#: Rows whose fingerprints one message holds at most.
MESSAGE_ROWS = 200_000
#: Fingerprints that one owner receives on average at most.
OWNER_ROWS = 500_000
#: Suspect ids are broadcast up to this count (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 500_000

_SENT = "seq long, owner int, n int, bits int, unary binary, low binary, uids binary, heads binary"


def golomb_encode(values: np.ndarray, universe_bits: int) -> tuple[int, bytes, bytes]:
    """Rice code of sorted distinct unsigned values: (parameter, unary quotients, low bits)."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    bits = max(0, universe_bits - int(np.ceil(np.log2(len(values) + 1))))
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    low = (gaps & np.uint64((1 << bits) - 1)).astype(">u8").view(np.uint8).reshape(-1, 8)
    low = np.unpackbits(low, axis=1)[:, 64 - bits :] if bits else np.zeros(0, np.uint8)
    return bits, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def golomb_decode(n: int, bits: int, unary: bytes, low: bytes) -> np.ndarray:
    """The values that :func:`golomb_encode` coded."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(bits)
    if bits:
        raw = np.unpackbits(np.frombuffer(low, np.uint8), count=n * bits).reshape(n, bits)
        wide = np.zeros((n, 64), np.uint8)
        wide[:, 64 - bits :] = raw
        gaps |= np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _send(owner_bits: int, print_bits: int):
    def message(uid: np.ndarray, value: np.ndarray) -> Iterator[tuple]:
        order = np.lexsort((uid, value))
        uid, value = uid[order], value[order]
        owner = (value >> np.uint64(print_bits - owner_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=1 << 40))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            head = np.diff(value[a:b], prepend=value[a] + np.uint64(1)) != 0
            own = value[a:b][head] & np.uint64((1 << (print_bits - owner_bits)) - 1)
            coded = golomb_encode(own, print_bits - owner_bits)
            yield (int(uid.min()), int(owner[a]), len(own), *coded, uid[a:b].tobytes(), np.packbits(head).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names = [x.split()[0] for x in _SENT.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]

        def flush() -> pa.RecordBatch:
            rows = list(message(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - print_bits)))
            if sum(len(u) for u, _ in held) >= MESSAGE_ROWS:
                yield flush()
        if held:
            yield flush()

    return run


def _answer(messages: pa.Table) -> pa.Table:
    """For one owner: which fingerprints of each message another message holds as well."""
    parts = [golomb_decode(*(messages.column(c)[i].as_py() for c in ("n", "bits", "unary", "low"))) for i in range(messages.num_rows)]
    value = np.concatenate(parts)
    _, back, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = np.split((count > 1)[back], np.cumsum([len(p) for p in parts])[:-1])
    return pa.table({"seq": messages.column("seq"), "owner": messages.column("owner"), "bitmap": pa.array([np.packbits(s).tobytes() for s in shared], pa.binary())})


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            uid = np.frombuffer(row["uids"], np.int64)
            which = np.cumsum(np.unpackbits(np.frombuffer(row["heads"], np.uint8), count=len(uid))) - 1
            shared = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8), count=row["n"]).astype(bool)
            repeated = np.bincount(which, minlength=row["n"]) > 1
            yield pa.RecordBatch.from_arrays([pa.array(uid[(shared | repeated)[which]])], ["uid"])


def normalised(text: str = "text"):
    """The text without the white space that does not count; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]", "")


def exact_duplicates(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS, owner_rows: int = OWNER_ROWS, keys: bool = False) -> DataFrame:
    """One row per document: its group's keeper, the group's size, whether it stays, its digest.

    Of equal texts the row with the most code points in the original text stays, then the
    one with the smallest doc_id. With ``keys``, the column row_key tells which row it is, where
    ids are null or repeated.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    norm = normalised()
    prints = checkpointed(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.xxhash64(norm).alias("print"),
            "doc_id",
            row_key().alias("row_key"),
            F.coalesce(F.char_length("text"), F.lit(0)).alias("points"),
            F.unhex(F.sha2(norm, 256)).alias("sha"),
        )
    )
    n = prints.count()
    owner_bits = max(5, int(np.ceil(np.log2(max(1, n / owner_rows)))))
    print_bits = min(64, max(owner_bits + 8, int(np.ceil(np.log2(n + 2))) + 16))
    sent = checkpointed(prints.select("uid", "print").mapInArrow(_send(owner_bits, print_bits), _SENT))
    replies = sent.select("seq", "owner", "n", "bits", "unary", "low").groupBy("owner").applyInArrow(_answer, "seq long, owner int, bitmap binary")
    marked = sent.select("seq", "owner", "n", "uids", "heads").join(replies, ["seq", "owner"])
    suspects = checkpointed(prints.join(marked.mapInArrow(_suspects, "uid long"), "uid", "left_semi"))

    ids = suspects.select("row_key").distinct()
    if suspects.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    same = (
        docs.withColumn("row_key", row_key()).join(ids, "row_key", "left_semi")
        .select(norm.alias("norm"))
        .groupBy(F.xxhash64("norm").alias("print"), "norm")
        .agg(F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("print", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    )
    first = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    groups = suspects.groupBy("print", "sha").agg(first).join(same, ["print", "sha"])
    groups = checkpointed(groups.select("print", "sha", F.col("first.doc_id").alias("keep_id"), F.col("first.uid").alias("keep_uid"), "group_size"))
    members = with_group(suspects.select("uid", "print", "sha"), groups, ["print", "sha"], "group_size", n).drop("print", "sha")
    return prints.join(members, "uid", "left").select(
        "doc_id",
        F.when(F.col("keep_uid").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *(["row_key"] if keys else []),
    )
