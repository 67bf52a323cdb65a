import pytest
from pyspark.sql import functions as F

from quillstream.operators import semantics
from quillstream.plans import analysis, stubs
from quillstream.sources import works

TITLE = "Quantum Widgets: Reliable Gadget Assembly"


def test_statuses(spark):
    reference = "References\n\n[7] A. Author. Quantum widgets: reliable gadget assembly. Proc. vol. 3, 2001, 2002."
    pages = [
        (1, 1, "Intro text.\n\nWe apply the widgets of [7] to assembly.\n\nOther text."), (1, 2, reference),
        (2, 1, "Nothing here at all."), (2, 2, reference),
        (3, 1, "Plain page."), (3, 2, "Another plain page."),
    ]
    got = {r.doc_id: (r.status, r.citation_index) for r in analysis.analyse_papers(spark.createDataFrame(pages, "doc_id long, page int, text string"), TITLE).collect()}
    assert got == {1: ("fulltext_analyzed", 7), 2: ("reference_only", 7), 3: ("fulltext_no_finding", None)}


@pytest.mark.parametrize(("query", "kind"), [("10.1/x", "doi"), ("2401.01234", "arxiv"), ("A title of things", "title"), ("10.48550/arXiv.2401.01234", "arxiv")])
def test_query_kinds(query, kind):
    assert works.query_kind(query) == kind


def test_resolve(spark):
    w = spark.createDataFrame([(1, "A title", 2020, "V", "10.1/x", "2401.01234", 5), (2, "A title of things", 2021, "V", "", "", 9)], "ord int, title string, year int, venue string, doi string, arxiv_id string, citations long")
    assert [(r.ord, r.citations) for r in works.resolve_target(w, "https://doi.org/10.1/X").collect()] == [(1, None)]
    assert [r.ord for r in works.resolve_target(w, "title of things").collect()] == [2]


def test_paged_scan_and_fallback(spark):
    good = works.paged_source("paged_good", "n int", lambda offset, count: [(k,) for k in range(offset, min(offset + count, 250))], 400)

    def fails(offset, count):
        raise RuntimeError("unreachable")

    bad = works.paged_source("paged_bad", "n int", fails, 100)
    assert works.scan(spark, good).agg(F.count("*"), F.sum("n")).first() == (250, sum(range(250)))
    assert works.scan(spark, bad, good).count() == 250

    def fails_late(offset, count):
        if offset >= 300:
            raise RuntimeError("unreachable")
        return [(k,) for k in range(offset, offset + count)]

    late = works.paged_source("paged_late", "n int", fails_late, 400)
    assert works.scan(spark, late, good).count() == 250
    with pytest.raises(Exception):
        works.scan(spark, bad)


def test_weak_findings_reach_the_status(spark):
    """Without a kept finding, a top span at the paper's number counts as a weak mention."""
    reference = "References\n\n[7] A. Author. Quantum widgets: reliable gadget assembly. Proc. vol. 3, 2001, 2002."
    pages = spark.createDataFrame([(1, 1, "Intro text.\n\nPlain words of [7] here.\n\nOther text."), (1, 2, reference)], "doc_id long, page int, text string")
    quiet = lambda spans: semantics.cue_findings(spans).withColumn("keep", F.lit(False))
    got = analysis.analyse_papers(pages, TITLE, analyse=quiet).collect()
    assert [(r.status, r.findings) for r in got] == [("mention_only", 1)]


REFERENCE = "References\n\n[7] A. Author. Quantum widgets: reliable gadget assembly. Proc. vol. 3, 2001, 2002."


def test_each_failure_is_a_status(spark):
    """What a stage could not do is told once, by the first stage that failed, and no document is dropped."""
    text = "Intro text.\n\nWe apply the widgets of [7] to assembly.\n\nOther text."
    pages = spark.createDataFrame([(d, p, t) for d in range(1, 7) for p, t in ((1, text), (2, REFERENCE))], "doc_id long, page int, text string")
    downloads = spark.createDataFrame([(d, d not in (2, 7), "no_url" if d in (2, 7) else None) for d in (1, 2, 3, 4, 5, 7, 8)], "doc_id long, ok boolean, error_type string")
    extraction = spark.createDataFrame([(2, "odd"), (3, "pdf_encrypted"), (4, None), (8, "empty_text_pdf")], "doc_id long, error_type string")

    def analyse(spans):
        lost = spans.where("doc_id = 5").select("doc_id", F.lit("blank_model_output").alias("error_type")).distinct()
        return semantics.cue_findings(spans.where("doc_id <> 5")).unionByName(lost, allowMissingColumns=True)

    got = {r.doc_id: (r.status, r.error_type, r.findings) for r in analysis.analyse_papers(pages, TITLE, downloads=downloads, extraction=extraction, analyse=analyse).collect()}
    assert got == {
        1: ("fulltext_analyzed", None, 3), 2: ("context_only", "no_url", 0), 3: ("fulltext_extract_failed", "pdf_encrypted", 0), 4: ("fulltext_analyzed", None, 3),
        5: ("analysis_failed", "blank_model_output", 0), 6: ("fulltext_analyzed", None, 3), 7: ("context_only", "no_url", 0), 8: ("fulltext_extract_failed", "empty_text_pdf", 0),
    }


def test_analysis_by_prompts(spark):
    """The endpoint sees one prompt a paper; its findings and refusals reach the statuses."""
    text = "Intro.\n\nWe apply the widgets of [7], paper %d, to assembly.\n\nOther text."
    pages = spark.createDataFrame([(d, p, t) for d in (2, 6, 12, 23) for p, t in ((1, text % d), (2, REFERENCE))], "doc_id long, page int, text string")
    asked = analysis.prompted("Quantum Widgets", "2001", ["QW"], lambda payloads: semantics.single_model(payloads, stubs.answering))
    got = {r.doc_id: (r.status, r.error_type) for r in analysis.analyse_papers(pages, TITLE, analyse=asked).collect()}
    assert got[2] == ("analysis_failed", "single_model_request_failed") and got[6] == ("analysis_failed", "single_model_json_parse_failed")
    assert got[12][1] is None and got[23][1] is None


def test_pages_are_cut_once_for_body_and_references(spark):
    """Both parts come from one checkpoint; before, each cut all pages anew."""
    pages = spark.createDataFrame([(1, 1, "one\n\ntwo"), (1, 2, "References\n\n[1] three")], "doc_id long, page int, text string")
    parts = analysis.sections(pages)
    assert [[r.text for r in p.orderBy("seq").collect()] for p in parts] == [["one", "two"], ["References", "[1] three"]]
    assert not any("Generate" in p._jdf.queryExecution().optimizedPlan().toString() for p in parts)
