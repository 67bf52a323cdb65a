"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of it. A
text is parsed greedily into the longest phrases that the automaton knows (an unknown
character is a phrase of its own); the language with the fewest phrases, each costing log2 of
the labelled text's length and normalised by the length of the text, wins. The automata are
laid out as a transition table in which a failing step goes back to the root and sets a flag,
so texts parse in lockstep: one look-up for each character and language. The table is dense
for the most frequent letters and sparse (sorted keys) for all others.

Texts are parsed whole. For speed, the parse of each ``SEGMENT`` characters begins before it
is known where a phrase of the segment before ends; that phrase and those after it are then
followed into the segment up to a place where both parses begin a phrase, from where on they
are one. So the count is that of one parse of the unbroken text. Letters count in lower case;
all other characters look the same.

Defined results: a null text or one without any letter is ``und`` with score 0; ties go to
the language that sorts first; with nothing to learn from, all texts are ``und``; a null
doc_id counts as the empty text where its crc32 decides what teaches; repeated rows are judged one by one, and other columns pass through, but for lang_pred and score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .arrow_text import in_pieces

#: Learned from: windows of so many characters, of at most so many rows a language.
WINDOW_CHARS, ROWS_A_LANGUAGE = 256, 128
SEGMENT = 1024
#: Bytes of the dense part of the table at most; rarer letters have sparse transitions.
TABLE_BYTES = 128 << 20
FLAG = np.uint32(1 << 31)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of ``codes``."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
        last = new
    return moves


class Parser:
    """Counts the phrases of texts for each language."""

    def __init__(self, texts: dict[str, list[str]], table_bytes: int = TABLE_BYTES):
        self.languages = sorted(texts)
        seen = Counter(c for parts in texts.values() for t in parts for c in t.lower() if c.isalpha())
        self.code = np.where(_letters(), 0, 1).astype(np.uint32)
        for k, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))):
            for form in (c, c.upper()):
                if len(form) == 1:
                    self.code[ord(form)] = k + 2
        codes = {name: [k for t in texts[name] for k in [*self._codes(t).tolist(), 0]] for name in self.languages}
        states = sum(2 * len(own) + 1 for own in codes.values())  # at most
        self.width = min(2 + len(seen), max(2, table_bytes // (4 * max(1, states))))
        self.cost = [np.log2(len(codes[name])) for name in self.languages]
        tables, keys, targets, roots, base = [], [], [], [], 0
        self.begin = []
        for name in self.languages:
            own, rare = suffix_automaton(codes[name]), []
            ended = len(own)  # the state after an unknown character: any next one starts a phrase
            root = np.full(2 + len(seen), FLAG | np.uint32(base + ended), np.uint32)
            for c, s in own[0].items():
                root[c] = FLAG | np.uint32(base + s)
            root[0] = FLAG | np.uint32(base + ended)  # neither the joints nor unknown letters match
            table = np.tile(root[: self.width], (ended + 1, 1))
            for s, steps in enumerate(own):
                for c, to in steps.items():
                    if c == 0:
                        continue
                    if c < self.width:
                        table[s, c] = base + to
                    else:
                        rare.append(((base + s) * (2 + len(seen)) + c, base + to))
            rare = np.array(rare, np.int64).reshape(-1, 2)
            keys.append(rare[:, 0])
            targets.append(rare[:, 1])
            tables.append(table)
            roots.append(root)
            self.begin.append(base + ended)
            base += ended + 1
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.uint32)
        self.roots = np.stack(roots) if roots else np.zeros((0, 2), np.uint32)
        keys, targets = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *targets])
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], targets[order].astype(np.uint32)

    def _codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _step(self, state: np.ndarray, code: np.ndarray, language: np.ndarray) -> np.ndarray:
        """The next state of each lane, flagged where a phrase begins."""
        rare = code >= self.width
        to = self.table[state.astype(np.int64) * self.width + np.where(rare, 0, code)]
        if rare.any():
            at = np.flatnonzero(rare)
            key = state[at].astype(np.int64) * self.roots.shape[1] + code[at]
            found = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[found] == key if len(self.keys) else np.zeros(len(at), bool)
            to[at] = self.roots[language[at], code[at]]
            to[at[hit]] = self.targets[found[hit]]
        return to

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) phrase counts."""
        lengths = np.array([len(t) for t in texts], np.int64)
        many = len(self.languages)
        if not many or not lengths.sum():
            return np.zeros((len(texts), many), np.int64)
        codes = self._codes("".join(texts))
        lanes = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), lanes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        starts = (np.cumsum(lengths) - lengths)[owner] + place * SEGMENT
        sizes = np.minimum(SEGMENT, lengths[owner] - place * SEGMENT)
        dense = not bool((codes >= self.width).any())
        order = np.argsort(-sizes, kind="stable")
        first, size = starts[order], sizes[order]
        state = np.repeat(np.array(self.begin, np.uint32)[:, None], len(owner), 1)
        tongue = np.repeat(np.arange(many)[:, None], len(owner), 1)
        begins = np.zeros((many, len(codes)), bool)  # where the parse of each segment begins a phrase
        alive = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        for t, n in enumerate(alive.tolist()):
            here = codes[first[:n] + t]
            if dense:
                at = state[:, :n] * np.uint32(self.width)
                at += here
                to = self.table[at]
            else:
                to = self._step(state[:, :n].ravel(), np.tile(here, many), tongue[:, :n].ravel()).reshape(many, n)
            begins[:, first[:n] + t] = to >> 31
            np.bitwise_and(to, ~FLAG, out=state[:, :n])
        ended = np.empty_like(state)
        ended[:, order] = state
        self._join(codes, begins, ended, place, starts, sizes)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        return np.stack([np.diff(np.concatenate([[0], np.cumsum(b)])[edges]) for b in begins], 1)

    def _join(self, codes: np.ndarray, begins: np.ndarray, ended: np.ndarray, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Follow the last phrase of each segment into the next, in ``begins`` itself."""
        joint = np.flatnonzero(place > 0)
        language = np.repeat(np.arange(len(begins)), len(joint))
        lane = np.tile(joint, len(begins))
        state = ended[language, lane - 1].copy()
        at, end = starts[lane], starts[lane] + sizes[lane]
        late = []
        while len(lane):
            to = self._step(state, codes[at], language)
            new = to >> 31 > 0
            done = new & begins[language, at]
            begins[language[~done], at[~done]] = new[~done]
            at = at + 1
            over = ~done & (at == end)  # still apart at the end of the segment
            late += zip(lane[over].tolist(), language[over].tolist(), (to[over] & ~FLAG).tolist(), strict=True)
            stay = ~done & ~over
            language, lane, at, end, state = language[stay], lane[stay], at[stay], end[stay], to[stay] & ~FLAG
        taken = set()
        for k, which, now in sorted(late):  # one after another, in the order of the text
            if (k, which) in taken:
                continue
            while k + 1 < len(place) and place[k + 1]:
                k += 1
                now, apart = self._alone(codes, begins[which], which, now, int(starts[k]), int(sizes[k]))
                taken.add((k, which))  # what was found for it began in a wrong state
                if not apart:
                    break

    def _alone(self, codes: np.ndarray, begins: np.ndarray, language: int, state: int, start: int, size: int) -> tuple[int, bool]:
        """Go through one segment from ``state`` until the parses meet: the state and whether they are apart."""
        again = self._segment(codes, language, self.begin[language], start, size)[0]
        flags, now = self._segment(codes, language, state, start, size)
        both = np.flatnonzero(again & flags)
        meet = int(both[0]) if len(both) else size
        begins[start : start + size] = np.where(np.arange(size) < meet, flags, again)
        return now, not len(both)

    def _segment(self, codes: np.ndarray, language: int, state: int, start: int, size: int) -> tuple[np.ndarray, int]:
        flags, width, whole = np.zeros(size, bool), self.width, self.roots.shape[1]
        table = memoryview(self.table)
        for t, c in enumerate(codes[start : start + size].tolist()):
            if c < width:
                to = table[state * width + c]
            else:
                key = state * whole + c
                k = int(np.searchsorted(self.keys, key))
                to = int(self.targets[k]) if k < len(self.keys) and self.keys[k] == key else int(self.roots[language, c])
            if to >> 31:
                flags[t] = True
                to &= 0x7FFFFFFF
            state = to
        return flags, state

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and certainty of each text."""
        texts = [t or "" for t in texts]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.phrases(texts) * np.array(self.cost)
        if not texts:
            return [], np.zeros(0)
        best = bits.argmin(1)
        score = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits) / 4).sum(1)
        lettered = [bool(t) and bool(_letters()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for t in texts]
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered, strict=True)], np.where(lettered, score, 0.0)


def learn(docs: DataFrame, rows: int = ROWS_A_LANGUAGE, chars: int = WINDOW_CHARS) -> dict[str, list[str]]:
    """Labelled windows by language: at most ``rows`` * ``chars`` characters each.

    ``docs`` must hold training rows alone; rows with the lowest hashes of id and text teach.
    Windows are cut where the texts are read, and of the range of hashes only the part that
    surely holds the lowest ``rows`` of a language (by its count) moves at all.
    """
    able = docs.where(F.col("lang").isNotNull() & (F.char_length("text") > 0))
    counts = able.groupBy("lang").agg(F.count("*").alias("n"))
    begin = (F.lit(1) + F.pmod("h", F.greatest(F.lit(1), F.char_length("text") - chars + 1))).cast("int")
    windows = able.withColumn("h", F.xxhash64("doc_id", "text")).select("lang", "h", F.substring("text", begin, F.lit(chars)).alias("part"))
    place = F.col("h").cast("double") / 2.0**64 + 0.5
    # one row a language; a language is a tag, and their number does not follow that of the documents
    drawn = windows.join(F.broadcast(counts), "lang").where(place < (4 * rows + 64) / F.col("n"))
    picked = drawn.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).where(F.col("at") <= rows)
    found: dict[str, list[str]] = {}
    for r in sorted(picked.select("lang", "at", "part").collect()):
        found.setdefault(r.lang, []).append(r.part)
    return found


def identify(docs: DataFrame, learned: dict[str, list[str]], text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with lang_pred and score."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(learned)  # bounded windows
    keep = [f.name for f in docs.schema.fields if f.name not in (text, "lang_pred", "score")]
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for whole in batches:
            for batch in in_pieces(whole, text):
                parser = parser or Parser(shared.value)
                names, score = parser.predict(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)
