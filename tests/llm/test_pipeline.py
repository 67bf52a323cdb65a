import os
import zlib

import numpy as np
import pytest
from test_exact_dedup import brute as exact
from test_near_dedup import brute as near
from test_suffix_dedup import brute as repeats

from quillstream.llm import stages
from quillstream.llm.queries import WORD_MODEL

SF = "/root/testdata/sf0.001"


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_against_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = dict(corpus_pipeline.STAGES)
    good = stages.written(steps["quality"](spark, docs, SF))
    assert good.columns == columns
    stayed = {r.doc_id for r in good.collect()}
    assert np.mean([(d in stayed) == bool(q) for d, q in labels.items()]) > 0.95

    once = stages.written(steps["exact_dedup"](spark, good, SF))
    assert once.columns == columns
    kept = {d for d, _, _, stays, _ in exact(texts(good)) if stays}
    assert texts(once) == [r for r in texts(good) if r[0] in kept]

    single = stages.written(steps["near_dedup"](spark, once, SF))
    assert single.columns == columns
    kept = {d for d, _, _, stays in near(texts(once), 5, 80, 100) if stays}
    assert texts(single) == [r for r in texts(once) if r[0] in kept]

    cut = stages.written(steps["suffix_dedup"](spark, single, SF))
    assert cut.columns == columns
    want = [(d, k.decode("utf-8", "ignore")) for d, *_, k in repeats(texts(single))]
    assert texts(cut) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    tokenizer = Tokenizer.from_file(WORD_MODEL)
    source = dict(texts(cut))
    total = 0
    result = corpus_pipeline.run(spark, SF).collect()
    for r in result:
        ids = np.array([*tokenizer.encode(source[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(ids) == r.doc_tokens
        total += r.length
    assert total == sum(r.doc_tokens for r in result if r.start == 0) and {r.doc_id for r in result} == set(source)


@pytest.mark.parametrize("broadcast_ids", [0, 1000])
def test_copies_with_repeated_rows(spark, broadcast_ids):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (3, "c"), (None, "d"), (None, "d"), (4, None), (5, " ")], "doc_id long, text string")
    assert texts(stages.drop_copies(spark, docs, "", broadcast_ids)) == [(None, "d"), (1, "a b"), (3, "c"), (5, " ")]


@pytest.mark.parametrize("broadcast_ids", [0, 1000])
def test_copies_of_rows_that_lack_or_share_an_id(spark, broadcast_ids):
    docs = spark.createDataFrame([(None, "a b"), (None, "a  b"), (None, "c"), (None, "d"), (1, "e f"), (1, "e  f g"), (2, "e   f"), (3, "d  "), (None, "c")], "doc_id long, text string")
    got = stages.drop_copies(spark, docs, "", broadcast_ids)
    assert texts(got) == [(None, "a  b"), (None, "c"), (1, "e  f g"), (2, "e   f"), (3, "d  ")]


@pytest.mark.parametrize("broadcast_ids", [0, 1000])
def test_near_copies_of_rows_that_lack_or_share_an_id(spark, broadcast_ids):
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(None, text(0)), (None, text(0) + " more"), (None, text(1)), (5, text(1) + " more"), (4, text(2)), (4, text(3)), (4, text(3) + " more"), (6, text(2) + " more"), (None, None), (None, "")]
    got = texts(stages.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "", broadcast_ids).fillna("", "text"))
    assert len(got) == 6
    assert [r for r in got if r[0] is None and not r[1]] == [(None, "")] * 2
    assert [r[1] in (text(0), text(0) + " more") for r in got if r[0] is None and r[1]] == [True]
    assert [r for r in got if r[0] == 5] == [(5, text(1) + " more")] and not [r for r in got if r[0] == 6]
    assert sorted(r[1].split()[0] for r in got if r[0] == 4) == ["w2x0", "w3x0"]


def clash(spark, rows):
    """Documents with extra columns that have names used inside the operators."""
    names = ["kept", "n_bytes", "n_removed", "n_spans", "_text", "_quality", "score", "row_key", "id_to_match", "key_to_match", "carried_0", "bucket", "size", "lang", "n_chars", "a.b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` {'long' if n == 'n_chars' else 'string'}" for n in names)
    return spark.createDataFrame([(d, t, *[None if n == "n_chars" else f"{n}-{d}" for n in names]) for d, t in rows], schema)


STAGES = {"quality": stages.keep_good, "exact": stages.drop_copies, "near": stages.drop_near_copies, "suffix": stages.cut_repeats}


def passage(k, n=60):
    return " ".join(f"word{k}x{i}" for i in range(n))


@pytest.mark.parametrize("name", STAGES)
def test_stages_with_nulls_repeats_and_clashing_columns(spark, tmp_path, name):
    rows = [(1, passage(1)), (1, passage(1)), (2, passage(1)), (None, passage(2)), (None, None), (4, ""), (5, None), (6, passage(3, 20_000)), (7, "é ü")]
    spark.createDataFrame([(1, None), (2, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clash(spark, rows)
    got = STAGES[name](spark, docs, str(tmp_path))
    assert got.columns == docs.columns and [f.dataType for f in got.schema.fields] == [f.dataType for f in docs.schema.fields]
    found = got.collect()
    assert all(r["kept"] == f"kept-{r.doc_id}" and r["a.b"] == f"a.b-{r.doc_id}" and r["_quality"] == f"_quality-{r.doc_id}" for r in found)
    ids = sorted([r.doc_id for r in found], key=str)
    if name == "quality":  # one label alone teaches its share: all stay
        assert len(found) == len(rows)
    elif name == "exact":
        assert len(found) == 5 and [i for i in ids if i in (1, 2)] == [1] and 6 in ids and 7 in ids
    elif name == "near":
        assert [i for i in ids if i in (1, 2)] == [1, 1] and ids.count(None) == 2 and {4, 5, 6, 7} <= set(ids)
    else:
        assert len(found) == len(rows)
        text = {r.doc_id: r.text for r in found}
        assert text[1] == passage(1) and text[2] == "" and text[5] == text[4] == "" and text[6] == passage(3, 20_000)
        assert all(r.n_chars == len(r.text) for r in found)
    again = STAGES[name](spark, docs.limit(0), str(tmp_path))
    assert again.columns == docs.columns and again.collect() == []


def test_packing_stage_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (2, "")]
    got = stages.pack(spark, clash(spark, rows), "").collect()
    assert sorted((r.doc_id is None, r.doc_id, r.doc_tokens) for r in got if r.doc_tokens == 1) == [(False, 2, 1), (True, None, 1)]
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4
    assert stages.pack(spark, clash(spark, []), "").collect() == []
