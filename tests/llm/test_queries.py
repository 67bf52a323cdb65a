import hashlib
import os

import pytest

from quillstream.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_pieces_match_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Q.PIECE_MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q.op5_pieces(spark, SF).collect():
        ids = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_near_duplicates_match_brute_force(spark):
    from test_near_dedup import brute

    assert sorted(tuple(r) for r in Q.op6_near_dedup(spark, SF).collect()) == brute(list(documents(spark).items()))


def test_repeats_match_brute_force(spark):
    from test_suffix_dedup import brute

    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(list(documents(spark).items()))]
    assert sorted(tuple(r) for r in Q.op10_suffix_dedup(spark, SF).collect()) == want


def test_packing_holds_every_id_once(spark):
    import zlib
    from collections import defaultdict

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.WORD_MODEL)
    found, used = defaultdict(list), defaultdict(list)
    for r in Q.op7_packing(spark, SF).collect():
        found[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    for d, t in documents(spark).items():
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(found[d], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for parts in used.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_shards_follow_the_law_of_bytes(spark):
    import zlib

    rows, load = Q.op8_sharding(spark, SF).collect(), [0] * 24
    texts = documents(spark)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts.items())
    for r in rows:
        load[r.shard] += r["size"]
    assert max(load) - min(load) <= 2 * max(r["size"] for r in rows)
