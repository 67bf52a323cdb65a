import os
import random
import zlib

import numpy as np
import pytest

from quillstream.llm import langid as L
from quillstream.llm import queries as Q

SF = "/root/testdata/sf0.01"


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(1)
    for _ in range(20):
        text = [rng.randrange(3) for _ in range(rng.randrange(1, 14))]
        moves = L.suffix_automaton(text)
        inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
        found, front = {()}, [((), 0)]
        while front:
            w, s = front.pop()
            for c, t in moves[s].items():
                found.add((*w, c))
                front.append(((*w, c), t))
        assert found == inside


def greedy(text, training):
    """Phrases of the unbroken text."""
    training = ["".join(c if c.isalpha() else " " for c in t.lower()) for t in training]
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    count, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and any(text[i : j + 1] in t for t in training):
            j += 1
        count, i = count + 1, j
    return count


def test_phrases_match_a_greedy_parse():
    learned = {"aa": ["the cat sat on the mat", "a dog"], "bb": ["le chat est là", "été"]}
    parser = L.Parser(learned)
    texts = ["The cat, là!", "dog dog été", "zzz", "", "the mat " * 300, "Ünknown 字 là"]
    got = parser.phrases(texts)
    for i, t in enumerate(texts):
        for k, name in enumerate(parser.languages):
            assert got[i, k] == greedy(t, learned[name]), (t, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op2_langid(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id][0] for r in rows if r.held_out and lang[r.doc_id][1]]
    assert np.mean(held) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, "123 !?"), (3, ""), (None, "the cat " * 9000), (3, "été là")], "doc_id long, text string").selectExpr("*", "1 AS score")
    learned = {"aa": ["the cat sat on the mat"], "bb": ["le chat est là été"]}
    got = {(r.doc_id, r.lang_pred) for r in L.identify(docs, learned).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "aa"), (3, "bb")}
    assert {r.lang_pred for r in L.identify(docs, {}).collect()} == {"und"}
    assert L.learn(docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")) == {}
    assert L.identify(docs.limit(0), learned).collect() == []


@pytest.mark.parametrize("table_bytes", [128 << 20, 3000, 0])
def test_long_texts_parse_unbroken(table_bytes):
    """Also where parses of segments never meet (repeats) and where letters are rare (sparse part)."""
    rng = random.Random(4)
    words = ["aaaaa", "abab", "cat", "sat", "mat", "字母表", "漢字", "été"]
    learned = {"aa": [" ".join(rng.choice(words) for _ in range(60)), "a" * 7], "bb": ["ab" * 40 + "字" * 11, "catsat"]}
    parser = L.Parser(learned, table_bytes)
    texts = ["a" * 7001, "ab" * 4000, "aab" * 2500, "字" * 5000, "cat sat " * 900, "", "x" * 3000, "abcab" * 1900]
    texts += ["".join(rng.choice(words + [" ", "q"]) for _ in range(rng.randrange(1, 2500))) for _ in range(25)]
    texts += ["a" * rng.randrange(900, 2100) + rng.choice(["cat", "b"]) + "a" * rng.randrange(3000) for _ in range(10)]
    got = parser.phrases(texts)
    assert got.tolist() == [[greedy(t, learned[k]) for k in parser.languages] for t in texts]


def test_thousands_of_letters():
    """No letter that was learned is left out, however many there are."""
    rng = random.Random(6)
    scripts = {"aa": range(0x4E00, 0x5A00), "bb": range(0x6000, 0x6C00)}
    text = lambda k, n: "".join(chr(rng.choice(scripts[k])) for _ in range(n))
    learned = {k: [text(k, 256) for _ in range(64)] for k in scripts}
    for table_bytes in (128 << 20, 1 << 20):
        parser = L.Parser(learned, table_bytes)
        parts = [(k, t[a : a + 40]) for k in scripts for t in learned[k][:20] for a in (0, 90)]
        assert parser.phrases([t for _, t in parts])[:, 0].tolist() == [1 if k == "aa" else 40 for k, _ in parts]
        assert parser.predict([t for _, t in parts])[0] == [k for k, _ in parts]


def test_scores_against_a_plain_version():
    learned = {"aa": ["the cat sat on the mat", "a dog"], "bb": ["le chat est là", "été"], "cc": ["xyz"]}
    parser = L.Parser(learned)
    texts = ["The cat", "là là", "zz", "the mat est là", "12", None, "!" * 9]
    names, scores = parser.predict(texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        if not any(c.isalpha() for c in t or ""):
            assert (name, score) == ("und", 0)
            continue
        bits = {k: greedy(t, v) * np.log2(sum(len(x) + 1 for x in v)) for k, v in learned.items()}
        assert name == min(sorted(bits), key=bits.get)
        assert score == pytest.approx(1 / sum(2 ** min(0, (min(bits.values()) - b) / 4) for b in bits.values()))
