"""Document quality from a linear-chain conditional random field over lines.

Each line is an item with features of its own characters and of the lines before and after
it. The chain learns from documents labelled good or bad (their lines take the label; lines
of bad documents that look good to a first fit change over for the second). A document's
evidence is the length-weighted mean of its lines' forward-backward marginals; a logistic
curve fitted on the same training documents turns it into the score.

Defined results: a null or empty text is one empty line and gets that line's score; with no
training documents of a class every score is the share of label 1 among the training
documents (0.5 with none at all); null labels and labels other than 0 and 1 teach nothing, nor
do rows without an id; repeated rows are scored one by one; other columns pass through, but for
one with the name of the result. A null doc_id counts as the empty text where its crc32 decides
what teaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, ship
from . import crf
from .arrow_text import in_pieces, release, utf8

#: The model learns from at most so many documents of each label, whole, of so many bytes together.
TRAIN_DOCS, TRAIN_BYTES = 1000, 4 << 20
#: Characters of whole documents whose features are worked out together while the model is fitted.
FIT_BYTES = 256 << 10

_CLASSES = ("upper", "lower", "digit", "space", "bang", "bar", "symbol", "stop", "mark", "lead", "trail", "other")
_OF_BYTE = np.full(256, 11, np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "!", "|", "#$%&*@^~<>{}[]=+\\_/`", ".?;:", ",'\"()-")):
    _OF_BYTE[[ord(c) for c in _chars]] = _k
_OF_BYTE[0xC0:], _OF_BYTE[0x80:0xC0] = 9, 10
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _repeats(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each line, the share of its words that equal the word before."""
    gap = (data == 32) | (data == 9) | (data == 10)
    begin = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(begin):
        return np.zeros(len(starts))
    mixed = np.where(gap, np.uint64(0), _MIX[data])
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], begin]), np.diff(begin, prepend=0, append=len(data)))
    mixed *= _POWERS[place & 63]
    word = np.add.reduceat(mixed, begin)
    line = np.searchsorted(starts, begin, "right") - 1
    same = np.concatenate([[False], (word[1:] == word[:-1]) & (line[1:] == line[:-1])])
    return np.bincount(line, same, len(starts)) / np.maximum(np.bincount(line, minlength=len(starts)), 1)


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with its neighbours', lines of each document, bytes of each line."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts, ""), "\n", "")
    data, offsets = utf8(ended)
    ends = np.flatnonzero(data == 10)
    lines = np.diff(np.searchsorted(ends, offsets))
    size = np.diff(ends, prepend=-1) - 1
    kind = _OF_BYTE[data]
    key = np.repeat(np.arange(len(ends), dtype=np.int64) * 16, size + 1) + kind
    count = np.bincount(key, minlength=16 * len(ends)).reshape(-1, 16)[:, : len(_CLASSES)].astype(np.float64)
    count[:, -1] -= 1  # the line end
    share = count / np.maximum(size, 1)[:, None]
    words = count[:, 3] + 1
    starts = ends - size
    first = kind[np.minimum(starts, len(data) - 1)]
    own = np.hstack([
        share, np.minimum(share, 0.05) * 20,
        np.stack([np.log1p(size), size == 0, np.minimum(size / words, 30) / 10, count[:, 5] / words, count[:, 4] / words, count[:, 6] / words, (first == 0) & (size > 0), _repeats(data, starts)], 1),
    ]).astype(np.float32)
    edge = np.zeros(len(ends), bool)
    edge[(np.cumsum(lines) - lines)] = True
    before = np.where(edge[:, None], np.float32(0), np.roll(own, 1, 0))
    tail = np.roll(edge, -1)
    after = np.where(tail[:, None], np.float32(0), np.roll(own, -1, 0))
    return np.hstack([own, before, after, edge[:, None], tail[:, None]]), lines, size


def features_in_parts(texts: list[str], part_bytes: int = FIT_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of whole documents, some at a time: what is needed on the way is several times their text."""
    parts, held, size = [], [], 0
    for k, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= part_bytes or k + 1 == len(texts):
            parts.append(line_features(pa.array(held, pa.string())))
            held, size = [], 0
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass
class QualityModel:
    chain: crf.Chain | None
    slope: float
    offset: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.chain is None:
            return np.full(len(texts), self.offset)
        return 1 / (1 + np.exp(-np.clip(self.slope * self._evidence(texts) + self.offset, -30, 30)))

    def _evidence(self, texts: pa.Array) -> np.ndarray:
        x, lines, size = line_features(texts)
        return weighted(self.chain.marginals(x, lines), lines, size)


def weighted(p: np.ndarray, lines: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean of the line marginals of each document, by line length."""
    starts = np.cumsum(lines) - lines
    weight = size + 1.0
    return np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts) if len(lines) else np.zeros(0)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a = b = 0.0
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((y - p) * m).sum() - 0.02 * a, (y - p).sum() - 0.02 * b])
        r = p * (1 - p)
        h = np.array([[(r * m * m).sum() + 0.02, (r * m).sum()], [(r * m).sum(), r.sum() + 0.02]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -5, 5)), b + float(np.clip(d[1], -5, 5))
    return a, b


def fit_quality(texts: list[str], labels: list[int]) -> QualityModel:
    """Fit on whole texts with labels 0 and 1."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return QualityModel(None, 0.0, float(y.mean()) if len(y) else 0.5)
    x, lines, size = features_in_parts(texts)
    spread = np.repeat(y, lines)
    chain = crf.fit(x, spread, lines)
    alone = crf.Chain(chain.weights, np.zeros((2, 2)), chain.mean, chain.scale)  # what a line says without its chain
    looks = 1 / (1 + np.exp(-alone.odds(x)))
    relabelled = np.where((spread == 0) & (looks > 0.5), 1, spread)
    starts = np.cumsum(lines) - lines
    if (np.add.reduceat(relabelled == 0, starts) > 0)[y == 0].mean() > 0.5:
        chain = crf.fit(x, relabelled, lines)
    return QualityModel(chain, *_logistic(weighted(chain.marginals(x, lines), lines, size), y))


def learn(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> QualityModel:
    """Fit on a bounded sample: of each label the documents whose ids hash lowest, of any length.

    ``docs`` and ``labels`` must hold training rows alone. Of each label at most ``per_label``
    documents and ``most_bytes`` bytes of whole texts reach the driver: one that no longer fits
    is passed over. An id that both labels have, or that several rows share, teaches nothing
    certain: its smallest label and its shortest text count.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))  # no texts move
    sized = checkpointed(sizes.join(marked, "doc_id").groupBy("quality", "doc_id").agg(F.min("size").alias("size")))
    counts = {r["quality"]: r["count"] for r in sized.groupBy("quality").count().collect()}
    # of a hash's whole range a part that surely holds the lowest ``per_label``; so few reach the driver
    part = {k: min(1.0, 4 * per_label / n + 64 / n) for k, n in counts.items()}
    place = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    drawn = sized.where(place < F.when(F.col("quality") == 1, part.get(1, 0.0)).otherwise(part.get(0, 0.0)) + 1e-12).withColumn("h", F.xxhash64("doc_id"))
    chosen: dict[int, int] = {}
    held, taken = [0, 0], [0, 0]
    for r in sorted(drawn.collect(), key=lambda r: (r["h"], r["doc_id"])):
        k = r["quality"]
        if taken[k] < per_label:
            taken[k] += 1
            if held[k] + r["size"] <= most_bytes:
                held[k] += r["size"]
                chosen[r["doc_id"]] = k
    text = F.coalesce("text", F.lit(""))
    texts = docs.where(F.col("doc_id").isin(list(chosen))).groupBy("doc_id").agg(F.min_by(text, F.struct(F.octet_length(text), text)).alias("text"))
    found = sorted((chosen[r.doc_id], r.text) for r in texts.collect())
    model = fit_quality([t for _, t in found], [label for label, _ in found])
    release()  # the driver lives on
    return model


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: the chance of label 1."""
    model = ship(docs.sparkSession).sparkContext.broadcast(model)  # a few kilobytes
    keep = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_pieces(whole, text, 1 << 20):
                scores = pa.array(model.value.score(batch.column(text).cast(pa.string())), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), scores], schema.names)
        release()

    return docs.mapInArrow(run, schema)


def remainder(divisor: int):
    """crc32 of the doc_id's decimal text, modulo ``divisor``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def training_rows(df: DataFrame) -> DataFrame:
    """The rows that may teach: those whose id's crc32 modulo 3 is not 1."""
    return df.where(remainder(3) != 1)
