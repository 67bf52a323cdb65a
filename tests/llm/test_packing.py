import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F

from quillstream.llm import packing as K

PATH = P.path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t ", "Hello World's 12 things!", "a b", "É é éx", "İ ẞ Σας", "x\x1cy z", "<|endoftext|> <|startoftext|>mid<|endoftext|>", "😀 a😀b", "́start ́", "they're'll", "word " * 5000, "z" * 9000]


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("aB c, d. Él#-_*%\n\t'.é́ \x1c1中😀s") for _ in range(rng.randrange(300))) for _ in range(400)]
    words = K.WordTokens(open(PATH).read())
    for part in (texts[:200], texts[200:]):
        flat, at = words.encode(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            assert flat[at[i] : at[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 65, 400))[::-1]
    where, offset = K.best_fit_decreasing(lengths, 64)
    free = []
    for size, w, o in zip(lengths, where, offset):
        fits = [c for c in free if c >= size]
        best = min(fits, default=64)
        assert 64 - o == best
        if fits:
            free.remove(best)
        if best > size:
            free.append(best - size)
    used = np.bincount(where, lengths)
    assert used.max() <= 64


def test_every_id_once(spark, tokenizer):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string, offset int").repartition(3)
    pieces = K.window_pieces(docs, PATH)
    rows = K.pack(pieces.withColumn("crc", F.crc32("ids")).drop("ids"), docs.count(), group_docs=10).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS * 3):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.crc == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    built = K.sequences(pieces, K.pack(pieces.drop("ids"), docs.count())).collect()
    assert sum(len(r.ids) for r in built) == 4 * sum(r.length for r in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert K.pack(K.window_pieces(docs, PATH).drop("ids"), 0).collect() == []


def test_groups_follow_documents_and_bytes(spark):
    """Few long documents, and rows equal in all columns, do not fill one group."""
    n = 20 * 600
    pieces = spark.range(n).selectExpr("id div 600 AS doc_id", "(id % 600) * 2048 AS start", "IF(id % 600 = 599, id % 2047 + 1, 2048) AS length", "0L AS ids_crc32", "1L AS doc_tokens")
    got = K.pack(pieces, 20, 20 * 5_000_000, group_bytes=10_000_000).collect()
    sizes = Counter(r.sequence_id >> 40 for r in got)
    assert len(got) == n and len(sizes) == 10 and max(sizes.values()) < 2 * n / 10
    same = spark.range(5000).selectExpr("7L AS doc_id", "0L AS start", "100L AS length", "0L AS ids_crc32", "1L AS doc_tokens")
    got = K.pack(same, 5000, 0, group_docs=500).collect()
    sizes = Counter(r.sequence_id >> 40 for r in got)
    assert len(sizes) == 10 and max(sizes.values()) < 800 and len({(r.sequence_id, r.offset) for r in got}) == 5000


def test_null_ids_and_clashing_columns(spark, tokenizer):
    rows = [(None, "one two three"), (None, "one two three"), (None, None), (5, "four"), (5, "five six")]
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "x") for d, t in rows], "doc_id long, text string, pack_group int, sequence_id int, length int, ids string")
    pieces = K.window_pieces(docs, PATH)
    got = K.pack(pieces.drop("ids"), *K.extent(docs)).collect()
    want = sorted((str(d), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got) == want and all(r.start == 0 and r.length == r.doc_tokens for r in got)
    ends = sorted((r.offset, r.length) for r in got)
    assert [o for o, _ in ends] == [0, *np.cumsum([n for _, n in ends])[:-1]]  # one sequence without gaps
