"""Removal of repeated byte strings, found by suffix arrays over shards of suspect text.

Every ``length``-byte string (window) of a document belongs to the anchor that its content
selects: the place of the smallest hash among its ``GRAM``-byte grams. Equal windows have equal
anchors, and the windows of one anchor are consecutive, so a text falls into contexts: an
anchor, its run of window starts, and the bytes that these windows cover.

1. Where documents are read, contexts are cut and their digests sent to the anchor's shard
   (packed, one entry for contexts that repeat within a message). A first pass finds the hot
   anchors, those of very many different contexts (a very common line): their contexts go to
   shards by anchor and digest together, so no shard gets all of them.
2. A shard sorts by anchor and context. A context seen before is repeated as a whole. Anchors
   with several different contexts need the bytes of the first of each.
3. Texts, grouped in buckets of documents, deliver these bytes to the shards.
4. A shard lays the contexts out in document order, builds the suffix array by induced sorting
   and the permuted common prefixes; runs of suffixes with a common prefix of ``length``
   bytes are equal windows, and all but the first in the text are repeated. The windows of hot
   anchors are matched by digests of the windows themselves instead; of windows that are equal
   in a bucket of documents, one is sent.
5. The buckets of documents receive all repeated ranges and cut their union.

Digests of contexts, windows and rows have 64 bits.

Defined results: null and empty texts have nothing to remove. Rows are told apart by a digest
of doc_id and text: each text is a document of its own, in the order of doc_id (null before all
others) and, within an id or without one, of the digest. Rows with doc_id and text both equal
(a null id equals a null id) count as one document: none is a repetition of another, and all
lose the same ranges. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, ship
from .arrow_text import binary_array, in_pieces, ragged, release, utf8
from .near_dedup import _mixed
from .rows import row_key
from .suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 100, 20
#: Bytes of text for each shard of anchors and each bucket of documents.
SHARD_BYTES, BUCKET_BYTES = 8 << 20, 2 << 20
#: Contexts in a message, bytes of a suffix array, different contexts of an anchor at most.
MESSAGE_ROWS, ARRAY_BYTES, HOT_CONTEXTS = 150_000, 1 << 20, 4096
#: Different contexts of an anchor in one message from which it may be hot; hot anchors are at most this many of all bytes.
MESSAGE_HOT, HOT_SHARE = 16, 1 << 18
#: What a row without text takes in a bucket.
ROW_BYTES = 64
BLOCK = 1 << 16
LOWEST = -(1 << 63)

_RANDOM = np.random.default_rng(20240610)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK + 4 * LENGTH, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


class Buckets:
    """Buckets of rows by their key. A key whose rows overfill a bucket has several in a row.

    Its rows are dealt over them, and what is sent to the key goes to each of them.
    """

    def __init__(self, count: int, spread: dict[int, int]):
        self.count, self.spread = count, {k: min(v, count) for k, v in spread.items()}
        self.wide = np.array(sorted(self.spread), np.int64)
        self.width = np.array([self.spread[k] for k in self.wide.tolist()], np.int64)

    def column(self, docs: DataFrame) -> DataFrame:
        """``docs`` (row_key, ...) with the column ``bucket``."""
        first = F.pmod("row_key", F.lit(self.count))
        if not self.spread:
            return docs.withColumn("bucket", first.cast("int"))
        wide = docs.sparkSession.createDataFrame(list(self.spread.items()), "_wide long, _width long")
        rows = docs.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(wide), F.col("row_key") == F.col("_wide"), "left")
        dealt = F.pmod("_row", F.coalesce("_width", F.lit(1)))
        return rows.withColumn("bucket", F.pmod(first + dealt, F.lit(self.count)).cast("int")).drop("_row", "_wide", "_width")

    def by_key(self, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket with the positions in ``key`` of what goes there."""
        if not len(self.wide):
            yield from _by_key(key % self.count)
            return
        at = np.minimum(np.searchsorted(self.wide, key), len(self.wide) - 1)
        times = np.where(self.wide[at] == key, self.width[at], 1)
        own = np.repeat(np.arange(len(key)), times)
        for bucket, which in _by_key((key[own] % self.count + ragged(np.zeros(len(key), np.int64), times)) % self.count):
            yield bucket, own[which]


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _grams(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place."""
    sums, have = {1: _BYTE[b]}, 1
    while 2 * have <= GRAM:
        x = sums[have]
        sums[2 * have] = x[: len(x) - have] + x[have:] * _POWER[have]
        have *= 2
    out, done = None, 0
    for k in sorted(sums, reverse=True):
        if GRAM & k:
            part = sums[k][done:]
            out = part if out is None else out[: len(part)] + part[: len(out)] * _POWER[done]
            done += k
    return _mixed(out)


def contexts(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """anchor hash, digest, text number, position and window starts of every context."""
    anchor, digest, at, count = [], [], [], []
    last = np.repeat(offsets[1:], np.diff(offsets)) - length  # the last window start of a byte's text
    for s in range(0, len(data) - length + 1, BLOCK):
        b = data[s : s + BLOCK + length - 1]
        gram = _grams(b)
        least = _slide((gram & ~np.uint64(0x1FFFF)) | np.arange(len(gram), dtype=np.uint64), length - GRAM + 1)
        place = (least & np.uint64(0x1FFFF)).astype(np.int64)
        ok = np.arange(s, s + len(place)) <= last[s : s + len(place)]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
        begin = np.flatnonzero(new & ok)
        stop = np.append(begin[1:], len(place))
        bad = np.flatnonzero(~ok)
        if len(bad):
            stop = np.minimum(stop, np.append(bad, len(place))[np.searchsorted(bad, begin)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _INVERSE[: len(b)], dtype=np.uint64)])
        end = stop + length - 1
        anchor.append(_mixed(gram[place[begin]] + _BYTE[0]))  # smallest hashes lie close together; shards need them spread
        digest.append(_mixed((sums[end] - sums[begin]) * _POWER[begin] + (end - begin).astype(np.uint64) * _BYTE[7]))
        at.append(begin + s)
        count.append(stop - begin)
    if not anchor:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    at = np.concatenate(at)
    text = np.searchsorted(offsets, at, "right") - 1
    return np.concatenate(anchor), np.concatenate(digest), text, at - offsets[text], np.concatenate(count)


def window_digests(contexts_: list[bytes], length: int) -> list[np.ndarray]:
    """Digest of every window of each context."""
    out = []
    for c in contexts_:
        b = np.frombuffer(c, np.uint8)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _INVERSE[: len(b)], dtype=np.uint64)])
        n = len(b) - length + 1
        out.append(_mixed((sums[length:] - sums[:n]) * _POWER[:n]))
    return out


def _packed(columns: dict[str, np.ndarray]) -> dict[str, bytes]:
    return {k: np.ascontiguousarray(v).tobytes() for k, v in columns.items()}


def _joined(table: pa.Table, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """Packed columns of all rows as one array each."""
    return {k: np.concatenate([np.frombuffer(x, t) for x in table.column(k).to_pylist()] or [np.zeros(0, t)]) for k, t in kinds.items()}


def _by_key(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order], prepend=-1, append=-2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(key[order[a]]), order[a:b]


#: Packed columns of each exchange: name and numpy type.
_MESSAGE = {"anchor": "<u8", "digest": "<u8", "doc": "<i8", "row": "<i8", "pos": "<u4", "n": "<u1"}
_CUT = {"row": "<i8", "pos": "<u4", "size": "<u4"}
_NEED = {"need_doc": "<i8", "need_row": "<i8", "need_pos": "<u4", "need_n": "<u1", "need_anchor": "<u8", "hot": "<u1"}
_CONTEXT = {"anchor": "<u8", "doc": "<i8", "row": "<i8", "pos": "<u4", "n": "<u1"}
_WINDOW = {"window": "<u8", "window_doc": "<i8", "window_row": "<i8", "window_pos": "<u4"}


def _schema(key: str, *packed: dict[str, str], extra: str = "") -> str:
    return ", ".join([f"{key} int", *(f"{k} binary" for p in packed for k in p)]) + extra


def _batch(rows: list[dict], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n, b"") for r in rows], pa.int32() if k == 0 else pa.binary()) for k, n in enumerate(names)})


def _repeats(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by anchor, digest, document, row and position; where a context is new; where it is seen again."""
    order = np.lexsort((pos, row, doc, digest, anchor))
    a, g, r, p = anchor[order], digest[order], row[order], pos[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (g[1:] != g[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    return order, new, ~new & ((r != r[first]) | (p != p[first]))


def _count_anchors(length: int, message_hot: int):
    """Anchors with many different contexts in a message, and how many."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        anchor, digest = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((digest, anchor))
        anchor, digest = anchor[order], digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])
        own = anchor[new]
        head = np.flatnonzero(np.diff(own, prepend=own[:1] ^ np.uint64(1)) != 0)
        n = np.diff(head, append=len(own))
        many = n >= message_hot
        return pa.RecordBatch.from_arrays([pa.array(own[head][many].view(np.int64)), pa.array(n[many])], ["anchor", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for whole in batches:
            for batch in in_pieces(whole, "text", 1 << 20):
                held.append(contexts(*utf8(batch.column("text")), length)[:2])
                if sum(len(a) for a, _ in held) >= MESSAGE_ROWS:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)
        del held
        release()

    return run


def hot_anchors(docs: DataFrame, length: int, least: int, message_hot: int = MESSAGE_HOT) -> np.ndarray:
    """Sorted hashes of the anchors with ``least`` and more contexts, as messages count them.

    What a message has few of is not counted; an anchor that a part of all text shares is hot in
    some messages at least. Any set of anchors gives right results, as only the way of
    their contexts depends on it.
    """
    counts = docs.select("text").mapInArrow(_count_anchors(length, message_hot), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = [r[0] for r in counts.where(F.col("n") >= least).select("anchor").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _send(length: int, shard_bits: int, hot: np.ndarray):
    schema = _schema("to", _MESSAGE, {"cut_" + k: v for k, v in _CUT.items()})

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.Table:
        anchor, digest, doc, row, pos, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order, new, again = _repeats(anchor, digest, doc, row, pos)
        rows, keep, drop = [], order[new], order[again]
        place = np.where(_among(anchor[keep], hot), _mixed(anchor[keep] ^ digest[keep]), anchor[keep])
        for shard, own in _by_key((place >> np.uint64(64 - shard_bits)).astype(np.int64)):
            at = keep[own]
            rows.append({"to": shard} | _packed({"anchor": anchor[at], "digest": digest[at], "doc": doc[at], "row": row[at], "pos": pos[at].astype(np.uint32), "n": n[at].astype(np.uint8)}))
        # repeated inside this message: known already, and only passed on by some shard
        for shard, own in _by_key(row[drop] & ((1 << shard_bits) - 1)):
            at = drop[own]
            rows.append({"to": shard} | _packed({"cut_row": row[at], "cut_pos": pos[at].astype(np.uint32), "cut_size": (n[at] + length - 1).astype(np.uint32)}))
        return _batch(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for whole in batches:
            for batch in in_pieces(whole, "text", 1 << 20):
                data, offsets = utf8(batch.column("text"))
                ids = batch.column("doc_id").fill_null(LOWEST).to_numpy()
                keys = batch.column("row_key").to_numpy()
                anchor, digest, text, pos, n = contexts(data, offsets, length)
                held.append((anchor, digest, ids[text], keys[text], pos, n))
                if sum(len(h[0]) for h in held) >= MESSAGE_ROWS:
                    yield from flush(held).to_batches()
                    held = []
        if held:
            yield from flush(held).to_batches()
        del held
        release()

    return run, schema


def _sort(length: int, buckets: Buckets, hot_contexts: int, hot: np.ndarray):
    schema = _schema("bucket", _CUT, _NEED)

    def run(table: pa.Table) -> pa.Table:
        m = _joined(table, _MESSAGE)
        passed = _joined(table, {"cut_" + k: v for k, v in _CUT.items()})
        order, new, again = _repeats(m["anchor"], m["digest"], m["doc"], m["row"], m["pos"])
        drop = order[again]
        cut = [np.concatenate(x) for x in zip((m["row"][drop], m["pos"][drop], m["n"][drop].astype(np.uint32) + np.uint32(length - 1)), passed.values(), strict=True)]
        first = order[new]
        anchor = m["anchor"][first]
        head = np.flatnonzero(np.diff(anchor, prepend=anchor[:1] ^ np.uint64(1)) != 0)
        several = np.repeat(np.diff(head, append=len(anchor)), np.diff(head, append=len(anchor)))
        split = _among(anchor, hot)  # others of these anchors are in other shards
        wanted = (several > 1) | split
        need, many = first[wanted], (split | (several > hot_contexts))[wanted]
        rows: dict[int, dict] = {}
        for bucket, own in buckets.by_key(cut[0]):
            rows.setdefault(bucket, {"bucket": bucket}).update(_packed({k: c[own] for k, c in zip(_CUT, cut, strict=True)}))
        for bucket, own in buckets.by_key(m["row"][need]):
            at = need[own]
            rows.setdefault(bucket, {"bucket": bucket}).update(_packed({"need_doc": m["doc"][at], "need_row": m["row"][at], "need_pos": m["pos"][at], "need_n": m["n"][at], "need_anchor": m["anchor"][at], "hot": many[own].astype(np.uint8)}))
        return _batch(list(rows.values()), schema)

    return run, schema


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row keys in order, bytes and offsets of their texts, and the order."""
    keys = table.column("row_key").to_numpy()
    order = np.argsort(keys, kind="stable")
    data, offsets = utf8(table.column("text").take(pa.array(order)))
    return keys[order], data, offsets, order


def _deliver(length: int, shard_bits: int):
    """The bytes that shards need, from one bucket of documents."""
    schema = _schema("shard", _CONTEXT, {"bytes": ""}, _WINDOW, {"cut_" + k: v for k, v in _CUT.items()})

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        need = _joined(asked, _NEED)
        if not len(need["need_row"]) or not docs.num_rows:
            return _batch([], schema)
        keys, data, offsets, _ = _texts(docs)
        row = np.searchsorted(keys, need["need_row"])
        here = keys[np.minimum(row, len(keys) - 1)] == need["need_row"]  # a bucket of a wide key may hold no row of it
        need, row = {k: v[here] for k, v in need.items()}, row[here]
        start = offsets[row] + need["need_pos"]
        size = need["need_n"].astype(np.int64) + length - 1
        rows: dict[int, dict] = {}
        cold, hot = np.flatnonzero(need["hot"] == 0), np.flatnonzero(need["hot"] == 1)
        for shard, own in _by_key((need["need_anchor"][cold] >> np.uint64(64 - shard_bits)).astype(np.int64)):
            at = cold[own]
            rows[shard] = {"shard": shard, "bytes": data[ragged(start[at], size[at])].tobytes()} | _packed({"anchor": need["need_anchor"][at], "doc": need["need_doc"][at], "row": need["need_row"][at], "pos": need["need_pos"][at], "n": need["need_n"][at]})
        if len(hot):
            window = np.concatenate(window_digests([data[s : s + k].tobytes() for s, k in zip(start[hot].tolist(), size[hot].tolist(), strict=True)], length))
            n = need["need_n"][hot].astype(np.int64)
            doc, key = np.repeat(need["need_doc"][hot], n), np.repeat(need["need_row"][hot], n)
            pos = ragged(need["need_pos"][hot], n).astype(np.uint32)
            order, new, again = _repeats(window, np.zeros(len(window), np.uint64), doc, key, pos)
            keep, drop = order[new], order[again]  # of equal windows the first goes on, the others are known already
            for shard, own in _by_key((window[keep] >> np.uint64(64 - shard_bits)).astype(np.int64)):
                at = keep[own]
                rows.setdefault(shard, {"shard": shard}).update(_packed({"window": window[at], "window_doc": doc[at], "window_row": key[at], "window_pos": pos[at]}))
            cut = _merged(key[drop], pos[drop], length)
            for shard, own in _by_key(cut["row"] & ((1 << shard_bits) - 1)):
                rows.setdefault(shard, {"shard": shard}).update(_packed({"cut_" + k: c[own] for k, c in cut.items()}))
        return _batch(list(rows.values()), schema)

    return run, schema


def repeated_windows(parts: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """For the contexts laid one after another: which windows (by start) an earlier one equals.

    Contexts must come in document order; context i has ``counts[i]`` windows.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    start = np.cumsum(sizes + 1) - sizes - 1
    text = raw.astype(np.uint16) + 2
    text[start + sizes] = 1  # between contexts
    room = np.repeat(start + sizes, sizes + 1) - np.arange(len(text))
    sa = suffix_array(text)
    prefix = common_prefixes(raw, sa, np.maximum(room, 0))
    same = prefix[sa] >= length
    runs = np.flatnonzero(~same)
    least = np.minimum.reduceat(sa, runs)
    again = np.zeros(len(text), bool)
    again[sa] = sa != np.repeat(least, np.diff(runs, append=len(sa)))
    return again[ragged(start, counts)]


def _merged(row: np.ndarray, pos: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Ranges that windows at (row, pos) cover; neighbours joined."""
    order = np.lexsort((pos, row))
    r, p = row[order], pos[order].astype(np.int64)
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    at = np.flatnonzero(new)
    return {"row": r[at], "pos": p[at].astype(np.uint32), "size": (np.diff(at, append=len(r)) + length - 1).astype(np.uint32)}


def _match(length: int, buckets: Buckets, array_bytes: int):
    schema = _schema("bucket", _CUT)

    def run(table: pa.Table) -> pa.Table:
        m = _joined(table, _CONTEXT)
        size = m["n"].astype(np.int64) + length - 1
        data = b"".join(table.column("bytes").to_pylist())
        start = np.cumsum(size) - size
        row, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(m["anchor"], kind="stable")
        last = np.flatnonzero(np.diff(m["anchor"][order], append=np.uint64(0)) != 0) + 1 if len(order) else []
        begin, filled, before = 0, 0, 0
        cuts = []
        for e in np.append(last, len(order)).tolist() if len(order) else []:  # whole anchors, up to array_bytes together
            filled += int(size[order[before:e]].sum())
            if filled >= array_bytes or e == len(order):
                cuts.append((begin, e))
                begin, filled = e, 0
            before = e
        for a, e in cuts:
            own = order[a:e]
            own = own[np.lexsort((m["pos"][own], m["row"][own], m["doc"][own]))]
            # several buckets of a wide key may deliver one context
            own = own[(np.diff(m["row"][own], prepend=0) != 0) | (np.diff(m["pos"][own].astype(np.int64), prepend=-1) != 0)]
            if len(own) < 2:
                continue
            parts = [data[s : s + k] for s, k in zip(start[own].tolist(), size[own].tolist(), strict=True)]
            n = m["n"][own].astype(np.int64)
            again = repeated_windows(parts, n, length)
            row.append(np.repeat(m["row"][own], n)[again])
            pos.append(ragged(m["pos"][own], n)[again])
        w = _joined(table, _WINDOW)
        order, _, again = _repeats(w["window"], np.zeros(len(w["window"]), np.uint64), w["window_doc"], w["window_row"], w["window_pos"])
        row.append(w["window_row"][order[again]])
        pos.append(w["window_pos"][order[again]].astype(np.int64))
        cut = _merged(np.concatenate(row), np.concatenate(pos), length)
        passed = _joined(table, {"cut_" + k: v for k, v in _CUT.items()})
        cut = {k: np.concatenate([c, passed["cut_" + k]]) for k, c in cut.items()}
        found = _batch([{"bucket": b} | _packed({k: c[own] for k, c in cut.items()}) for b, own in buckets.by_key(cut["row"])], schema)
        release()
        return found

    return run, schema


_RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]


def _remove(with_text: bool, characters: bool, carried: list[str]):
    kind = pa.string() if characters else pa.binary()

    def run(docs: pa.Table, cuts: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([*(pa.array([], kind if n == "kept" else pa.int64()) for n in _RESULT), *(docs.column(c) for c in carried)], names=_RESULT + carried)
        keys, data, offsets, order = _texts(docs)
        cut = _joined(cuts, _CUT)
        change = np.zeros(len(data) + 1, np.int32)
        low, high = np.searchsorted(keys, cut["row"], "left"), np.searchsorted(keys, cut["row"], "right")
        row, on = ragged(low, high - low), np.repeat(np.arange(len(low)), high - low)  # one row a cut, but for repeated rows
        a = np.minimum(offsets[row] + cut["pos"][on], offsets[row + 1])
        np.add.at(change, a, 1)
        np.add.at(change, np.minimum(a + cut["size"][on], offsets[row + 1]), -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        begins = offsets[:-1][np.diff(offsets) > 0]
        edge[begins] = gone[begins]
        left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        spans = np.diff(np.concatenate([[0], np.cumsum(edge)])[offsets])
        kept = binary_array(data[~gone], left)
        if characters:
            kept = pa.array([k.decode("utf-8", "ignore") for k in kept.to_pylist()], kind)
        elif not with_text:
            kept = pa.array([hashlib.sha256(k).digest() for k in kept.to_pylist()], pa.binary())
        size = np.diff(offsets)
        others = docs.select(carried).take(pa.array(order))
        found = pa.table([docs.column("doc_id").take(pa.array(order)), pa.array(size), pa.array(size - np.diff(left)), pa.array(spans), kept, *others.columns], names=_RESULT + carried)
        release()
        return found

    return run


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, with_text: bool = True, carry: tuple[str, ...] = (), characters: bool = False,
    shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES, array_bytes: int = ARRAY_BYTES, hot_contexts: int = HOT_CONTEXTS, message_hot: int = MESSAGE_HOT,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` of each document.

    ``kept`` holds the bytes that stay (which may cut characters), or with
    ``with_text=False`` only their SHA-256, or with ``characters=True`` the text of those
    that stay, without the characters that lost bytes. Columns named in ``carry`` pass through; their
    names must not be those of the result.
    """
    ship(docs.sparkSession)
    others = docs.select(*carry)
    with_others = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row_key().alias("row_key"), *carry)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row_key().alias("row_key"))
    room = F.octet_length("text").cast("long") + ROW_BYTES
    held = docs.groupBy("row_key").agg(F.count("*").alias("n"), F.sum(room).alias("room"))
    wide = F.when((F.col("n") > 1) & (F.col("room") > bucket_bytes), F.struct("row_key", F.ceil(F.col("room") / bucket_bytes)))
    total, rows, wide = held.agg(F.sum("room"), F.sum("n"), F.collect_list(wide)).first()  # less than one wide key for each bucket_bytes
    total, rows = total or 0, rows or 0
    shard_bits = max(5, int(np.ceil(np.log2((total - rows * ROW_BYTES) / shard_bytes + 1))))
    buckets = Buckets(max(16, -(-total // bucket_bytes)), dict(map(tuple, wide)))

    hot = hot_anchors(docs, length, max(hot_contexts, (total - rows * ROW_BYTES) // HOT_SHARE), message_hot)
    send, send_schema = _send(length, shard_bits, hot)
    sort, sort_schema = _sort(length, buckets, hot_contexts, hot)
    sorted_ = checkpointed(docs.mapInArrow(send, send_schema).groupBy("to").applyInArrow(sort, sort_schema))
    placed = buckets.column(with_others)  # one exchange serves both uses
    deliver, deliver_schema = _deliver(length, shard_bits)
    asked = sorted_.where("length(need_row) > 0").select("bucket", *_NEED)
    sent = placed.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(deliver, deliver_schema)
    match, match_schema = _match(length, buckets, array_bytes)
    found = sent.groupBy("shard").applyInArrow(match, match_schema)
    cuts = found.unionByName(sorted_.where("length(row) > 0").select("bucket", *_CUT))
    kept = T.StringType() if characters else T.BinaryType()
    schema = T.StructType([T.StructField(n, kept if n == "kept" else T.LongType()) for n in _RESULT] + list(others.schema.fields))
    return placed.groupBy("bucket").cogroup(cuts.groupBy("bucket")).applyInArrow(_remove(with_text, characters, list(carry)), schema)
