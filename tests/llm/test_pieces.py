import hashlib
import random
import time

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

from quillstream.llm.pieces import DIGESTS, Encoded, Encoder, Vocabulary, decode_pieces, encode_pieces, round_trip

PATH = P.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "x\ty", "é ñ ü ß", "▁", "a▁b ▁▁ c", "日本語 テキスト", "😀 ok 😀😀", "<s> </s> <unk> <0x0A>", "a" * 3000, "the the the", "ab" * 400 + " end", "\u0000 nul", "word " * 500, "مرحبا بالعالم", "​﻿"]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(open(PATH, "rb").read()))


def test_random_texts_match_the_library(sp, encoder):
    rng = random.Random(3)
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(259, 32000, 7)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["".join(rng.choice("abc de\n éß中😀") for _ in range(rng.randrange(900))) for _ in range(200)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(200, 700))) for _ in range(60)] + [t or "" for t in TEXTS]
    flat, at = encoder.encode(texts)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == sp.encode(t), t[:80]
    data, ends = encoder.vocabulary.decode(flat, at)
    for i, t in enumerate(texts):
        assert data[ends[i] : ends[i + 1]].tobytes().decode() == sp.decode(sp.encode(t))


def test_frames(spark, sp):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, decoded string")
    rows = decode_pieces(encode_pieces(docs, PATH), PATH, text="again").collect()
    assert [r.again for r in sorted(rows, key=lambda r: r.doc_id)] == [sp.decode(sp.encode(t or "")) for t in TEXTS]
    assert encode_pieces(docs.limit(0), PATH).collect() == []


def test_long_words_merge_in_rounds(sp, encoder):
    rng = random.Random(8)
    letters = lambda k, n: "".join(rng.choice(k) for _ in range(n))
    texts = ["a" * 20_000, "=-" * 9000, letters("acgt", 30_000), letters("etaoin shrdlu".replace(" ", ""), 8000), "abcabcab" * 2000, "中文字" * 3000, "x" * 999 + " " + letters("ab", 3000)]
    texts += [letters(rng.choice(["ab", "the", "inga", "0123", "ersti"]), rng.randrange(2, 400)) for _ in range(300)]
    begun = time.time()
    flat, at = encoder.encode(texts)
    assert time.time() - begun < 60
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == sp.encode(t), t[:80]


def test_rounds_stop_where_a_better_pair_arises():
    """With ranks that no trained model has, the result is that of one merge at a time."""
    from quillstream.llm.pieces import NONE, PairTable
    import numpy as np

    rng = random.Random(9)
    for _ in range(300):
        width, pairs = 12, {}
        for _ in range(rng.randrange(3, 30)):
            pairs[rng.randrange(6) * width + rng.randrange(8)] = (rng.randrange(5), rng.randrange(12))
        table = PairTable(pairs, width)
        word = [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        plain = list(word)
        while True:
            ranks = [pairs.get(a * width + b, (NONE, 0)) for a, b in zip(plain, plain[1:])]
            if not ranks or min(r for r, _ in ranks) == NONE:
                break
            k = min(range(len(ranks)), key=lambda i: (ranks[i][0], i))
            plain[k : k + 2] = [ranks[k][1]]
        got, _ = table.merge(np.array(word + [3]), np.array([0] * len(word) + [1]))
        assert got.tolist() == [*plain, 3]


def test_round_trip_with_repeated_rows_and_clashing_columns(spark, sp):
    rows = [(1, "the cat", 5, "x"), (1, "the cat", 5, "x"), (None, None, 6, "y"), (2, "", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = round_trip(docs, PATH, added=DIGESTS, form=Encoded.digests)
    assert got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(d, i, len(sp.encode(t or "")), sha(",".join(map(str, sp.encode(t or "")))), sha(sp.decode(sp.encode(t or "")))) for d, t, _, i in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    whole = sorted(round_trip(docs, PATH).select("doc_id", "ids", "decoded").collect(), key=str)
    assert [(r.ids, r.decoded) for r in whole] == [(sp.encode(t or ""), t or "") for _, t, _, _ in sorted(rows, key=lambda r: str(r))]
    assert round_trip(docs.limit(0), PATH).collect() == []
