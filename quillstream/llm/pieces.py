"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text is cut into words before each run of spaces; no piece of a BPE model crosses such a
place, so words encode on their own. All distinct words of a batch lie in flat numpy arrays
of symbols. A round finds the best (lowest) pair rank of every word with a segmented minimum,
merges the pairs of that rank in all words at once, from the left, looks up the ranks of the
pairs that changed, and compacts the arrays; words without a mergeable pair leave. A round
stops in a word where the library would turn to another pair, so the ids are the library's,
whatever the length of a word.

Encoding and decoding share one Python worker in ``round_trip``: two that feed one another in
a task cost memory and can wait for each other.

Defined results: null and empty texts have no ids and decode to the empty text; characters
unknown to the model become byte pieces; repeated rows are encoded one by one; other columns
pass through unchanged, but one with the name of a result gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship
from .arrow_text import binary_array, in_pieces, ragged, release

SPACE = "▁"
#: Distinct words that a worker remembers; beyond it, it starts anew.
CACHE_WORDS = 250_000
NONE = np.iinfo(np.int32).max
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")


class PairTable:
    """Rank and result of merging two symbols: pairs maps left * width + right to (rank, merged)."""

    def __init__(self, pairs: dict[int, tuple[int, int]], width: int):
        self.width = width
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no pair) and merged symbol of each pair of symbols."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.width + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words after all merges, in word order.

        ``word`` ascends. The library merges the leftmost best pair of a word, again and
        again. A round does so with all pairs of a word's best rank at once, from the left, up
        to the first that brings a new pair of this rank or a better one, so the order of
        merges stays the same and a long word takes no more rounds than it has ranks.
        """
        done_sym, done_word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        same = np.append(word[1:] == word[:-1], False)
        rank, merged = self.look_up(sym, np.where(same, np.append(sym[1:], -1), -1)) if len(sym) else (sym, sym)
        while len(sym):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            spread = np.repeat(best, np.diff(starts, append=len(word)))
            stay = spread < NONE
            if not stay.all():
                done_sym.append(sym[~stay])
                done_word.append(word[~stay])
                sym, word, rank, merged, spread = sym[stay], word[stay], rank[stay], merged[stay], spread[stay]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == spread)
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-9) != 1, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]  # of overlapping pairs every other one, from the left
            made, own = merged[at], word[at]
            # the neighbours at the time of each merge: merged already on the left, not yet on the right
            joint = np.append(False, (np.diff(at) == 2) & (own[1:] == own[:-1]))
            before = np.maximum(at - 1, 0)
            left = np.where((at > 0) & (word[before] == own), np.where(joint, np.append(0, made[:-1]), sym[before]), -1)
            after = np.minimum(at + 2, len(sym) - 1)
            right = np.where((at + 2 < len(sym)) & (word[after] == own), sym[after], -1)
            left_rank, left_made = self.look_up(left, made)
            right_rank, right_made = self.look_up(made, right)
            early = (np.minimum(left_rank, right_rank) <= rank[at]).astype(np.int64)
            if early.any():  # what follows such a merge in its word waits for the next round
                first = np.flatnonzero(np.diff(own, prepend=-1))
                passed = np.cumsum(early) - early
                fit = passed == np.repeat(passed[first], np.diff(first, append=len(own)))
                at, made, own, joint = at[fit], made[fit], own[fit], joint[fit]
                left, left_rank, left_made, right_rank, right_made = left[fit], left_rank[fit], left_made[fit], right_rank[fit], right_made[fit]
            sym[at] = made
            rank[at], merged[at] = right_rank, right_made
            inside = left >= 0
            # a merged symbol's pair with a merged left neighbour starts at that neighbour
            where = np.where(joint, at - 2, at - 1)[inside]
            rank[where], merged[where] = left_rank[inside], left_made[inside]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]


class Vocabulary:
    """Pieces, pair ranks and byte ids of a model file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        score = [sp.get_score(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        symbol = {text[i]: i for i in normal}
        self.size = n
        for i in normal:  # characters that are no pieces themselves
            for c in text[i]:
                symbol.setdefault(c, len(symbol) + n)
        self.width = max(symbol.values()) + 1
        ranks = {s: r for r, s in enumerate(sorted({score[i] for i in normal}, reverse=True))}
        pairs = {}
        for i in normal:
            for k in range(1, len(text[i])):
                left, right = symbol.get(text[i][:k]), symbol.get(text[i][k:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (ranks[score[i]], i)
        self.table = PairTable(pairs, self.width)
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.byte_id = np.zeros(256, np.int32)
        raw: list[bytes] = []
        self.is_byte = np.zeros(n, bool)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(text[i][3:5], 16)] = i
                self.is_byte[i] = True
                raw.append(bytes([int(text[i][3:5], 16)]))
            elif sp.is_unknown(i):
                raw.append(" ⁇ ".encode())
            else:
                raw.append(b"" if sp.is_control(i) else text[i].replace(SPACE, " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.spaced = np.array([t.startswith(SPACE) for t in text])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and their counts."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.of_char[points]
        sym = np.where(sym < 0, -1 - points, sym).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return self._spelled(*self.table.merge(sym, np.repeat(np.arange(len(words)), sizes)), len(words))

    def _spelled(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """In word order, with symbols that are no pieces turned into byte ids."""
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        lost = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(lost):
            names = {int(v): k for k, v in enumerate(self.of_char) if v >= self.size} if (sym >= self.size).any() else {}
            spelled = [np.frombuffer(chr(-1 - s if s < 0 else names[s]).encode("utf-8", "surrogatepass"), np.uint8) for s in sym[lost].tolist()]
            counts = np.ones(len(sym), np.int64)
            counts[lost] = [len(x) for x in spelled]
            first = np.cumsum(counts) - counts
            out = np.repeat(sym, counts)
            out[ragged(first[lost], counts[lost])] = self.byte_id[np.concatenate(spelled)]
            sym, word = out, np.repeat(word, counts)
        return sym.astype(np.int32), np.bincount(word, minlength=n)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of flat ids cut at the n + 1 offsets."""
        sizes = self.raw_len[ids].copy()
        starts = self.raw_at[ids].copy()
        heads = offsets[:-1][np.diff(offsets) > 0]
        heads = heads[self.spaced[ids[heads]]]
        starts[heads] += 1  # the space before the text is not part of it
        sizes[heads] -= 1
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        data = self.raw[ragged(starts, sizes)]
        if self.is_byte[ids].any():
            texts = [_repaired(data[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            data, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        return data, ends


def _repaired(raw: bytes) -> bytes:
    """Each byte that is no part of a character becomes U+FFFD."""
    out = b""
    while raw:
        try:
            raw.decode()
            return out + raw
        except UnicodeDecodeError as e:
            out += raw[: e.start] + "�".encode()
            raw = raw[e.start + 1 :]
    return out


class _Index(dict):
    """Numbers words as they come; the new ones wait in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes batches of texts; remembers the ids of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.index, self.flat, self.counts = _Index(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    @staticmethod
    def _split(text: str) -> list[str]:
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        # words that a single space does not lead are kept with all their spaces
        words = _WORDS.findall(SPACE + text.replace(" ", SPACE))
        return [w if w.startswith(SPACE * 2) or w == SPACE else w[1:] for w in words]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and n + 1 offsets."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        words: list[str] = []
        counts = []
        for t in texts:
            own = self._split(t or "")
            counts.append(len(own))
            words += own
        number = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if new := self.index.new:
            self.index.new = []
            for k in range(0, len(new), 100_000):
                part = [w if w.startswith(SPACE) else SPACE + w for w in new[k : k + 100_000]]
                ids, n = self.vocabulary.encode_words(part)
                self.flat, self.counts = np.concatenate([self.flat, ids]), np.concatenate([self.counts, n])
        starts = np.cumsum(self.counts) - self.counts
        sizes = self.counts[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[ragged(starts[number], sizes)], ends[np.concatenate([[0], np.cumsum(counts)])]


def list_array(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def id_digests(ids: np.ndarray, offsets: np.ndarray, width: int) -> list[str]:
    """SHA-256 of each text's decimal ids joined by commas."""
    names = [f"{i},".encode() for i in range(width)]
    size = np.array([len(n) for n in names], np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(names), np.uint8)[ragged(at[ids], size[ids])].tobytes()
    ends = np.concatenate([[0], np.cumsum(size[ids])])[offsets].tolist()
    return [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@dataclass
class Encoded:
    """What the texts of a batch became: flat ids, and the bytes that they spell."""

    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    ends: np.ndarray
    vocabulary: Vocabulary

    def digests(self) -> list[pa.Array]:
        """n_tokens, ids_sha256 and decoded_sha256 of each text."""
        raw, ends = self.data.tobytes(), self.ends.tolist()
        return [
            pa.array(np.diff(self.offsets), pa.int64()),
            pa.array(id_digests(self.ids, self.offsets, self.vocabulary.size), pa.string()),
            pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
        ]

    def whole(self) -> list[pa.Array]:
        """The ids and the decoded text."""
        return [list_array(self.ids, self.offsets), binary_array(self.data, self.ends, pa.binary()).cast(pa.string())]


#: Columns that the forms of a round trip add.
WHOLE, DIGESTS = "ids array<int>, decoded string", "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _model(path: str, df: DataFrame):
    with open(path, "rb") as f:
        return ship(df.sparkSession).sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, model_path: str, text: str, added: str, columns: Callable[[Encoder, pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` without ``text`` and with the ``added`` columns, made of pieces of batches."""
    model = _model(model_path, df)
    new = T.StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name != text and f.name not in new.names]
    schema = T.StructType([*kept, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            for batch in in_pieces(whole, text):
                encoder = encoder or Encoder(Vocabulary(model.value))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns(encoder, batch)], schema.names)
        del encoder
        release()

    return df.mapInArrow(run, schema)


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` without the column ``text`` and with the column ``ids``: array<int>."""
    return _mapped(df, model_path, text, f"`{ids}` array<int>", lambda encoder, batch: [list_array(*encoder.encode(batch.column(text).to_pylist()))])


def round_trip(df: DataFrame, model_path: str, text: str = "text", added: str = WHOLE, form: Callable[[Encoded], list[pa.Array]] = Encoded.whole) -> DataFrame:
    """``df`` without ``text``, with what the texts' ids and the ids' texts give.

    By default these are the columns ids and decoded; with ``DIGESTS`` and
    ``Encoded.digests`` their number and digests, so that no ids leave the worker.
    """

    def columns(encoder: Encoder, batch: pa.RecordBatch) -> list[pa.Array]:
        ids, offsets = encoder.encode(batch.column(text).to_pylist())
        return form(Encoded(ids, offsets, *encoder.vocabulary.decode(ids, offsets), encoder.vocabulary))

    return _mapped(df, model_path, text, added, columns)


def decode_pieces(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` without the column ``ids`` and with the text that they spell."""
    model = _model(model_path, df)
    schema = T.StructType([f for f in df.schema.fields if f.name not in (ids, text)] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(model.value)
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = part.column(ids).fill_null([]) if part.column(ids).null_count else part.column(ids)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                column = binary_array(*vocabulary.decode(flat, offsets), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in schema.fields[:-1]), column], schema.names)

    return df.mapInArrow(run, schema)
