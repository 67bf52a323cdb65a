import json

import pytest
from pyspark.sql import functions as F

from quillstream.plans import reports
from quillstream.sources import fulltext, html, registries
from quillstream.sources import works as W


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"name": " Ann ", "tag_type": "acm_fellow", "aliases": ["A", "A", " "]}, {"name": "", "tag_type": "acm_fellow"}, {"name": "Bo", "tag_type": "odd"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"name": "Cy", "tags": [{"type": "ieee_fellow"}, {"type": "acm_fellow", "note": "n"}]}]))
    items = registries.read_json(spark, str(tmp_path / "*.json"))
    assert [(r.name, r.aliases) for r in registries.entries(items).collect()] == [("Ann", ["A"])]
    assert {(r.name, r.tag_type) for r in registries.expand_tags(items.where("name = 'Cy'")).collect()} == {("Cy", "ieee_fellow"), ("Cy", "acm_fellow")}
    (tmp_path / "c.csv").write_text("\ufeffname,tag_type,aliases,note\nDi,acm_fellow,x; y|x,hello\nEd,none,,\n")
    r = registries.read_csv(spark, str(tmp_path / "c.csv")).collect()
    assert [(x.name, x.aliases, x.note) for x in r] == [("Di", ["x", "y"], "hello")]


def test_award_table(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Name\nAward\nYear\nRegion\nDL\nAnn Lee\tACM Fellows\t2019\tX\nBo Su ACM Fellows 2020 Europe\nann lee\tACM Fellows\t2021\n")
    got = registries.award_table(registries.read_lines(spark, str(tmp_path / "t.txt")))
    assert {(r.name, r.note) for r in got.collect()} == {("Ann Lee", "ACM Fellow, elected 2019"), ("Bo Su", "ACM Fellow, elected 2020")}


def test_wiki_table_and_list(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("Year\tFellow\tCitation\n2004\tTodd\tAustin [de]\tfor contributions\n2005\t\tJane Doe\tfor work\n")
    got = registries.wiki_table(registries.read_lines(spark, str(tmp_path / "w.tsv")))
    assert {(r.name, r.year, r.citation) for r in got.collect()} == {("Todd Austin", "2004", "for contributions"), ("Jane Doe", "2005", "for work")}
    (tmp_path / "l.txt").write_text("* Ann Lee – for contributions to x\nBo Su for work on y\nVisit the page for details\nplain\n")
    got = registries.fellow_list(registries.read_lines(spark, str(tmp_path / "l.txt")))
    assert {(r.name, r.citation) for r in got.collect()} == {("Ann Lee", "for contributions to x"), ("Bo Su", "for work on y")}


def test_award_html(spark):
    page = spark.createDataFrame([(1, "<tr><td>Ann Lee</td><td>ACM Fellows</td><td>2019</td></tr><tr><td>x</td><td>ACM Fellows</td><td>no</td></tr>")], "page_id long, html string")
    assert [(r.name, r.year) for r in html.award_rows(html.text_nodes(page, "page_id", "html"), "page_id", "ACM Fellows").collect()] == [("Ann Lee", 2019)]


def test_plan_and_cache(spark):
    c = spark.createDataFrame([(1, "arxiv", 0, "u2"), (1, "local", 0, "u1"), (1, "core", 0, "u1"), (1, "odd", 0, "u3"), (1, "core", 1, "")], "paper long, source string, ord int, url string")
    assert [(r.url, r.source, r.place) for r in fulltext.download_plan(c).orderBy("place").collect()] == [("u1", "local", 1), ("u2", "arxiv", 2)]
    done = spark.createDataFrame([("u1", 200), ("u2", 500)], "url string, status int").select(F.sha1("url").alias("key"), "status")
    assert [r.url for r in fulltext.missing_urls(c.where("url like 'u%'"), done).orderBy("url").collect()] == ["u2", "u3"]


def test_local_files(spark):
    papers = spark.createDataFrame([(1, "A Study of Things"), (2, "Nothing Alike")], "paper long, title string")
    files = spark.createDataFrame([("/x/a study of things.pdf",), ("/x/other things.pdf",)], "path string")
    assert [(r.paper, r.path, r.similarity) for r in fulltext.local_files(papers, files).collect()] == [(1, "/x/a study of things.pdf", 1.0)]


def test_extraction_chain(spark):
    def broken(content):
        raise ValueError("EOF marker not found")

    def plain(content):
        if content == b"locked":
            raise ValueError("file is encrypted")
        return content.decode().split("|")

    files = spark.createDataFrame([("a", bytearray(b"page one has text|page two")), ("b", bytearray(b"locked")), ("c", bytearray(b"x"))], "path string, content binary")
    pages = fulltext.extract_pages(files, [broken, plain])
    assert {(r.doc_id, r.page) for r in pages.collect()} == {("a", 1), ("a", 2), ("b", None), ("c", None)}
    assert {(r.doc_id, r.error_type) for r in fulltext.failures(pages).collect()} == {("b", "pdf_encrypted"), ("c", "pdf_corrupted_or_malformed")}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "session_id string, n int")
    assert "| s1 | 1 |" in reports.markdown_report("T", {"part": df})
    assert json.loads(reports.json_report({"part": df}))["part"][1]["n"] == 2
    reports.write_partition(df, str(tmp_path / "t"))
    reports.write_partition(df.where("session_id = 's2'").withColumn("n", F.lit(9)), str(tmp_path / "t"))
    assert {(r.session_id, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("s1", 1), ("s2", 9)}


@pytest.mark.parametrize("kind", ["arrivals", "tasks"])
def test_streams(spark, tmp_path, kind):
    from quillstream.streaming import tasks

    source, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    if kind == "arrivals":
        schema = "ord long, corpus_id string, doi string, arxiv_id string, title string, arrived timestamp"
        df = spark.sql("SELECT 1L AS ord, 'C1' AS corpus_id, '' AS doi, '' AS arxiv_id, 't' AS title, timestamp'2024-01-01 00:00:00' AS arrived UNION ALL SELECT 2L, 'C1', '', '', 'u', timestamp'2024-01-01 00:01:00' UNION ALL SELECT 3L, '', '', '', 'v', timestamp'2024-01-01 00:02:00'")
        df.coalesce(1).write.parquet(str(source))
        stream = tasks.arrivals(spark.readStream.schema(schema).parquet(str(source)))
        q = stream.writeStream.foreachBatch(tasks.upsert_papers(spark, str(out))).option("checkpointLocation", str(ck)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {r.key for r in spark.read.parquet(str(out)).collect()} == {"C1", "v"}
    else:
        df = spark.sql("SELECT 's' AS session, k AS kind, timestamp_seconds(1700000000 + i) AS at FROM VALUES ('start', 1), ('start', 2), ('succeed', 3), ('fail', 4), ('start', 5) AS t(k, i)")
        df.coalesce(1).write.parquet(str(source))
        stream = tasks.single_flight(spark.readStream.schema("session string, kind string, at timestamp").parquet(str(source)))
        q = stream.writeStream.format("memory").queryName("task_states").option("checkpointLocation", str(ck)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = [(r.state, r.accepted) for r in spark.table("task_states").orderBy("at").collect()]
        assert got == [("running", True), ("running", False), ("succeeded", True), ("succeeded", False), ("running", True)]


def test_local_files_by_hints(spark):
    papers = spark.createDataFrame([(1, "One Thing Here", "10.1/ab", None), (2, "Two", None, "2401.00001v2"), (3, "", None, None)], "paper long, title string, doi string, arxiv_id string")
    files = spark.createDataFrame([("/x/paper 10.1_abc.pdf",), ("/x/2401.00001.pdf",), ("/x/else.pdf",)], "path string")
    got = {(r.paper, r.path, r.similarity) for r in fulltext.local_files(papers, files).collect()}
    assert got == {(1, "/x/paper 10.1_abc.pdf", 0.95), (2, "/x/2401.00001.pdf", 1.0)}


def test_source_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"name": "Ann", "tag_type": "acm_fellow", "note": "j"}]))
    (tmp_path / "b.csv").write_text("name,tag_type,note\nBo,ieee_fellow,c\n")
    (tmp_path / "c.txt").write_text("Cy Lee\tACM Fellows\t2019\n")
    (tmp_path / "d.tsv").write_text("Year\tFellow\tCitation\n2004\tDi\tfor work\n")
    (tmp_path / "e.txt").write_text("IEEE Computer Society Fellows\nEd Mo – for things\n")
    (tmp_path / "f.txt").write_text("nothing known\n")
    (tmp_path / "README.md").write_text("ACM Fellows")
    got = {(r.name, r.tag_type, r.note) for r in registries.read_sources(spark, str(tmp_path)).collect()}
    assert got == {("Ann", "acm_fellow", "j"), ("Bo", "ieee_fellow", "c"), ("Cy Lee", "acm_fellow", "ACM Fellow, elected 2019"), ("Di", "ieee_fellow", "for work"), ("Ed Mo", "ieee_fellow", "for things")}


def test_downloads_in_order(spark):
    plan = spark.createDataFrame([(1, "bad", 1), (1, "html", 2), (1, "good", 3), (1, "late", 4), (2, "html", 1), (3, "gone", 1)], "paper long, url string, place int")

    def fetch(url):
        if url == "bad":
            raise OSError("unreachable")
        return {"html": (200, "text/html", b"<html>"), "good": (200, "application/pdf", b"%PDF-1"), "gone": (404, "", b"")}[url]

    got = {(r.paper, r.url, r.content and bytes(r.content), r.error) for r in fulltext.download(plan, fetch).collect()}
    assert got == {(1, "good", b"%PDF-1", None), (2, None, None, "downloaded_non_pdf"), (3, None, None, "status 404")}


def test_retries():
    answers = iter([(429, "", b""), (500, "", b""), (200, "", b"x")])
    assert fulltext.with_retries(lambda url: next(answers), (0, 0, 0), 0)("u") == (200, "", b"x")
    assert fulltext.with_retries(lambda url: (503, "", b""), (0, 0), 0)("u") == (503, "", b"")

    def fails(url):
        raise OSError("no")

    with pytest.raises(OSError):
        fulltext.with_retries(fails, (0, 0), 0)("u")


def test_upper_letter_by_letter(spark):
    """As in SQL: ß has a capital of its own, and letters without one stay."""
    from quillstream.functions import text as X

    con = pytest.importorskip("duckdb").connect()
    said = "".join(X._WIDE) + "straße ﬁn éας ŉ"
    assert spark.range(1).select(X.upper(F.lit(said))).first()[0] == con.execute("SELECT upper(?)", [said]).fetchall()[0][0]
    assert spark.range(1).select(X.title_key(F.lit("İzmir İ"))).first()[0] == "izmir i"


def test_hits_without_letters(spark):
    """Titles without letters equal a query without letters; the newest of them is taken."""
    hits = spark.createDataFrame([(1, "—", 0, "Words", 2020), (1, "—", 1, "", 2001), (1, "—", 2, "…", 2005), (2, "Words", 0, "", 2020)], "query_id long, query string, hit_ord int, title string, year int")
    assert {r.query_id: (r.hit_ord, r.similarity) for r in W.best_hits(hits).collect()} == {1: (2, 1.0), 2: (0, 0.0)}
