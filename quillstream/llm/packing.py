"""Packing token sequences into fixed windows by best-fit decreasing.

Documents are tokenised where they are read and cut at once: full windows first, then the
rest. The rests are dealt into groups of bounded size by a hash; inside a group, pieces are
taken by falling length and go to the tightest open window that still holds them, found in
a segment tree indexed by remaining capacity. Only narrow rows (no token ids) move.

Words of plain letters and punctuation up to ``LONG_WORD`` characters are tokenised by shared
merge rounds, all others by the library itself, with the same ids.

Defined results: a null or empty text is the end token alone; rows that lack a doc_id or repeat
one, or are equal in all columns, are packed each on its own (a null id stays null); an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrow_text import binary_array, in_pieces, ragged, release, utf8
from .pieces import PairTable, _Index

WINDOW, END_ID = 2048, 1
#: Documents, and bytes of text, that one group packs on average at most.
GROUP_DOCS, GROUP_BYTES = 20_000, 256 << 20
#: Words that went to the library, and parts of words, that a worker remembers; beyond it, it starts anew.
CACHE_WORDS, CACHE_PARTS = 50_000, 300_000
#: Bytes of text whose words are told apart together.
PIECE_BYTES = 2 << 20

#: Words that the tokenizer surely splits into their letters and their punctuation alone.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)$"
LONG_WORD = 200
#: Bytes of texts with blanks for line ends and tabs.
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[9, 10, 13]] = 32
#: Parts of words that merge at once.
NEW_WORDS = 50_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


class WordTokens:
    """Token ids of texts by a tokenizer that never joins across white space.

    Words of plain letters and punctuation are merged here, in rounds over many words at once
    and in the library's order; all others go to the library itself.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        ids = self.tokenizer.get_vocab()
        merges = [m if isinstance(m, list) else m.split(" ") for m in json.loads(tokenizer_json)["model"]["merges"]]
        width = max(ids.values()) + 1
        self.table = PairTable({ids[a] * width + ids[b]: (r, ids[a + b]) for r, (a, b) in enumerate(merges)}, width)
        # byte-level alphabets write printable bytes as themselves and the rest from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*printable}))}
        self.inner = np.array([ids[char[b]] for b in range(256)], np.int64)
        self.final = np.array([ids[char[b] + "</w>"] for b in range(256)], np.int64)
        self.others: dict[str, np.ndarray] = {}
        self._clear_parts()

    def _clear_parts(self) -> None:
        self.parts, self.part_flat, self.part_counts = _Index(), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.parts[""] = 0

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of distinct runs of letters or of punctuation, by merge rounds."""
        raw = [p.encode() for p in parts]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        last = np.cumsum(size) - 1
        sym[last] = self.final[data[last]]
        ids, word = self.table.merge(sym, np.repeat(np.arange(len(parts)), size))
        return ids.astype(np.uint32), np.bincount(word, minlength=len(parts))

    def _library(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words by the library itself, which sees each of them once as long as it is remembered."""
        if len(self.others) > CACHE_WORDS:
            self.others.clear()
        new = [w for w in words if w not in self.others]
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.others[w] = np.array(e.ids, np.uint32)
        return [self.others[w] for w in words]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of distinct words; plain ones are put together from their parts."""
        forms = pc.extract_regex(words, _PLAIN)
        fits = forms.is_valid().to_numpy(zero_copy_only=False) & (pc.utf8_length(words).to_numpy() <= LONG_WORD)
        plain, other = np.flatnonzero(fits), np.flatnonzero(~fits)
        kept = forms.take(pa.array(plain))
        parts = pa.concat_arrays([pc.utf8_lower(kept.field("letters")), kept.field("marks")]).dictionary_encode()
        known = np.fromiter(map(self.parts.__getitem__, parts.dictionary.to_pylist()), np.int64, len(parts.dictionary))
        number = known[parts.indices.to_numpy()].reshape(2, -1).T.ravel()  # letters and marks of a word side by side
        new, self.parts.new = self.parts.new, []
        for k in range(0, len(new), NEW_WORDS):
            ids, sizes = self._encode_parts(new[k : k + NEW_WORDS])
            self.part_flat, self.part_counts = np.concatenate([self.part_flat, ids]), np.concatenate([self.part_counts, sizes])
        single = self._library(words.take(pa.array(other)).to_pylist())
        sizes = self.part_counts[number]
        counts = np.zeros(len(words), np.int64)
        counts[plain] = sizes.reshape(-1, 2).sum(1)
        counts[other] = [len(x) for x in single]
        flat = np.zeros(int(counts.sum()), np.uint32)
        starts = np.cumsum(counts) - counts
        at = np.cumsum(self.part_counts) - self.part_counts
        flat[ragged(starts[plain], counts[plain])] = self.part_flat[ragged(at[number], sizes)]
        flat[ragged(starts[other], counts[other])] = np.concatenate([np.zeros(0, np.uint32), *single])
        return flat, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and n + 1 offsets; each distinct word of ``texts`` is put together once."""
        if len(self.parts) > CACHE_PARTS:
            self._clear_parts()
        data, offsets = utf8(texts)
        words = pc.split_pattern(binary_array(_BLANK[data], offsets, pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        flat, counts = self._encode_words(coded.dictionary)
        number, starts = coded.indices.to_numpy(), np.cumsum(counts) - counts
        sizes = counts[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return flat[ragged(starts[number], sizes)], ends[words.offsets.to_numpy()]


def window_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``window`` ids (little-endian unsigned 32-bit), full ones first."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = ship(docs.sparkSession).sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        words = None
        for whole in batches:
            for batch in in_pieces(whole, "text", PIECE_BYTES):
                words = words or WordTokens(shared.value)
                flat, at = words.encode(batch.column("text"))
                doc, start, length, ids, total = [], [], [], [], []
                for d, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), window):
                        piece = own[s : s + window]
                        doc.append(d)
                        start.append(s)
                        length.append(len(piece))
                        ids.append(piece.tobytes())
                        total.append(len(own))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((doc, start, length, ids, total), kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])
        del words
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class OpenWindows:
    """Segment tree over remaining capacities: which ones some open window has."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.windows[capacity].append(number)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out a window of the least capacity >= size: (capacity, window)."""
        count, i = self.count, size + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces must come by falling length."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, n = OpenWindows(window), 0
    for k, size in enumerate(lengths.tolist()):
        found = free.tightest(size)
        if found is None:
            found, n = (window, n), n + 1
        capacity, number = found
        where[k], offset[k] = number, window - capacity
        if capacity > size:
            free.add(capacity - size, number)
    return where, offset


def extent(docs: DataFrame) -> tuple[int, int]:
    """Number of documents and bytes of their texts."""
    return tuple(docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first())


def pack(pieces: DataFrame, documents: int, size: int = 0, window: int = WINDOW, group_docs: int = GROUP_DOCS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``pieces`` (with doc_id, start and length; leave ids out) with sequence_id and offset.

    The number of groups follows from the number of ``documents`` and the ``size`` of their texts,
    so that neither many short nor a few long ones fill a group beyond its bound.
    """
    groups = max(1, -(-documents // group_docs), -(-size // group_bytes))
    # the row's own number deals repeated rows as well
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    kept = [f for f in pieces.schema.fields]
    schema = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        where, offset = best_fit_decreasing(group.column("length").to_numpy(), window)
        number = group.column("pack_group")[0].as_py()
        return pa.table([*(group.column(f.name) for f in kept), pa.array(where + (number << 40)), pa.array(offset)], names=schema.names)

    return dealt.groupBy("pack_group").applyInArrow(run, schema)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (at most one window each)."""
    rows = pieces.select("doc_id", "start", "ids").join(placed.select("doc_id", "start", "sequence_id", "offset"), ["doc_id", "start"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most a window's ids
    return rows.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))


