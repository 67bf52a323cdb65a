"""Queries over sources: targets, hits, files, links, extraction, registries, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as X
from ..session import scratch
from ..sources import cache as K
from ..sources import cursors as C
from ..sources import fulltext as L
from ..sources import html as H
from ..sources import registries as G
from ..sources import works as W
from . import stubs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_TK = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
_SIM = "CASE WHEN {0} = {1} THEN 1.0 WHEN len({2}) = 0 OR len({3}) = 0 THEN 0.0 ELSE len(list_intersect({2}, {3}))::DOUBLE / greatest(len({2}), len({3})) END"


def works(spark, sf_dir):
    p = A.papers(spark, sf_dir)
    arxiv = F.when(F.col("ord") % 5 == 0, F.concat(F.lpad((F.col("ord") % 9000 + 1000).cast("string"), 4, "0"), F.lit("."), F.lpad(F.col("ord").cast("string"), 5, "0")))
    return p.select("ord", "title", "year", "venue", "doi", arxiv.alias("arxiv_id"), (F.col("ord") * 3).alias("citations"))


_WORKS = f"""{A.PAPERS_SQL}, works AS (SELECT ord, title, year, venue, doi, CASE WHEN ord % 5 = 0 THEN lpad(CAST(ord % 9000 + 1000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(ord AS VARCHAR), 5, '0') END AS arxiv_id, ord * 3 AS citations FROM papers)"""
_TARGETS = ["https://doi.org/10.1000/7", "1035.00035v2", "10.48550/arXiv.1040.00040", "10.1000/none", "The of and River", "Der die und zu"]


@query(f"""WITH {_WORKS}, d AS (SELECT 0 AS asked, ord, citations FROM works WHERE lower(trim(coalesce(doi, ''))) = '10.1000/7' ORDER BY ord LIMIT 1), a AS (SELECT 1 AS asked, ord, citations FROM works WHERE arxiv_id = '1035.00035' ORDER BY ord LIMIT 1), b AS (SELECT 2 AS asked, ord, citations FROM works WHERE arxiv_id = '1040.00040' ORDER BY ord LIMIT 1),
k AS (SELECT asked, {_TK.format('q')} AS a, {_TK.format('title')} AS b, ord, citations FROM works, (VALUES (4, 'The of and River'), (5, 'Der die und zu')) t(asked, q)), w AS (SELECT *, {_WORDS.format('a')} AS x, {_WORDS.format('b')} AS y FROM k),
t AS (SELECT asked, ord, citations FROM (SELECT *, {_SIM.format('a', 'b', 'x', 'y')} AS similarity FROM w) WHERE similarity > 0 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY similarity DESC, ord) = 1)
SELECT CAST(asked AS INTEGER) AS asked, ord, CASE WHEN asked = 0 THEN NULL ELSE citations END AS citations FROM (SELECT * FROM d UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM t)""")
def resolve_target(spark, sf_dir):
    w = works(spark, sf_dir)
    found = [W.resolve_target(w, q).select(F.lit(k).alias("asked"), "ord", "citations") for k, q in enumerate(_TARGETS)]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows


@query(f"""WITH {A.PAPERS_SQL}, h AS (SELECT ord // 3 AS query_id, CAST(ord % 3 AS INTEGER) AS hit_ord, title, year FROM papers), q AS (SELECT query_id, arg_min(title, hit_ord) AS query FROM h GROUP BY 1),
k AS (SELECT h.*, {_TK.format('query')} AS a, {_TK.format('title')} AS b FROM h JOIN q USING (query_id)), w AS (SELECT *, {_WORDS.format('a')} AS x, {_WORDS.format('b')} AS y FROM k),
s AS (SELECT *, {_SIM.format('a', 'b', 'x', 'y')} AS similarity FROM w)
SELECT query_id, hit_ord, title, year, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, coalesce(year, 0) DESC, hit_ord) = 1""")
def lookup_best(spark, sf_dir):
    hits = A.papers(spark, sf_dir).select(F.floor(F.col("ord") / 3).alias("query_id"), (F.col("ord") % 3).cast("int").alias("hit_ord"), "title", "year")
    asked = hits.groupBy("query_id").agg(F.min_by("title", "hit_ord").alias("query"))
    return W.best_hits(hits.join(asked, "query_id"))


@query("""SELECT page_id AS ord, coalesce(nullif(CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'T' || page_id END, ''), 'Unknown Title') AS title, CAST(2000 + page_id % 20 AS INTEGER) AS year, CASE WHEN page_id % 3 = 0 THEN 'Unknown Venue' ELSE 'V' || page_id END AS venue,
CASE WHEN page_id % 2 = 0 THEN '10.1/' || page_id ELSE '' END AS doi, 'A' || page_id || ':' || CASE WHEN page_id % 4 = 0 THEN 'I' ELSE '' END AS authors FROM pages""")
def common_schema(spark, sf_dir):
    d = F.col("page_id")
    t = d.cast("string")
    inst = F.array(F.struct(F.when(d % 4 == 0, "I").alias("display_name"), F.lit("i").alias("id")))
    foreign = A.table(spark, sf_dir, "pages").select(
        d.alias("ord"), F.when(d % 5 != 0, F.concat(F.lit("T"), t)).alias("title"), (2000 + d % 20).alias("publication_year"), F.when(d % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), t)).alias("doi"),
        F.struct(F.struct(F.when(d % 3 != 0, F.concat(F.lit("V"), t)).alias("display_name")).alias("source")).alias("primary_location"),
        F.array(F.struct(F.struct(F.concat(F.lit("A"), t).alias("display_name"), F.lit("x").alias("id")).alias("author"), inst.alias("institutions"))).alias("authorships"),
    )
    who = F.array_join(F.transform("authors", lambda a: F.concat(a["name"], F.lit(":"), F.array_join(F.transform(a["institutions"], lambda i: i["display_name"]), ","))), ";")
    return W.common_schema(foreign).withColumn("authors", who)


@query("SELECT page_id, url FROM pages")
def paged_scan(spark, sf_dir):
    """Pages of a service by offset; the first service fails on a late page, so all rows are those of the second."""
    service = stubs.TableService(f"{sf_dir}/pages.parquet", ["page_id", "url"])
    wanted = A.table(spark, sf_dir, "pages").count()
    good = W.paged_source("quill_secondary", "page_id long, url string", service.page, wanted)
    return W.scan(spark, W.paged_source("quill_primary", "page_id long, url string", stubs.late_failure(service, 100), wanted + 100), good)


@query("SELECT page_id, url FROM pages")
def cursor_scan(spark, sf_dir):
    """All pages of a service that gives the next cursor with each page."""
    service = stubs.TableService(f"{sf_dir}/pages.parquet", ["page_id", "url"])
    return C.cursor_rows(spark, "quill_cursors", "page_id long, url string", service.at, service.following)


@query("""WITH u AS (SELECT url, min(page_id) AS first, list_sum(list_transform(range(octet_length(encode(url))), lambda i: ('0x' || substr(hex(encode(url)), 2 * i + 1, 2))::BIGINT)) AS k FROM pages WHERE url IS NOT NULL GROUP BY url),
s AS (SELECT url, first, CASE WHEN k % 5 = 0 THEN 'status 404' WHEN k % 7 = 0 THEN 'timed out' END AS error FROM u)
SELECT url, CASE WHEN error IS NULL THEN 'page of ' || url END AS text, error, error IS NULL AND first % 2 = 0 AS cached FROM s""")
def cached_fetch(spark, sf_dir):
    """Half of the pages are in the cache when all of them are wanted."""
    pages = A.table(spark, sf_dir, "pages")
    path = scratch(spark)
    first = pages.where("url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("page_id")).where("page_id % 2 = 0")
    K.read_through(first, path, stubs.fetching, waits=(0.0,), pause=0)
    return K.read_through(pages, path, stubs.fetching, waits=(0.0, 0.0), pause=0)


_SOURCES = "['local', 'open_access', 'unpaywall', 'landing_page', 'openalex', 'arxiv', 'core', 'odd']"


@query(f"""WITH c AS (SELECT l_orderkey AS paper, l_linenumber AS ord, ({_SOURCES})[CAST(l_partkey % 8 AS INTEGER) + 1] AS source, CASE WHEN l_suppkey % 5 = 0 THEN ' ' ELSE 'https://x/' || l_suppkey % 4 END AS url FROM lineitem),
r AS (SELECT *, list_position({_SOURCES}, source) AS rank FROM c WHERE trim(url) <> '' AND source <> 'odd'), o AS (SELECT paper, url, min(rank * 1000 + ord) AS k, arg_min(source, rank * 1000 + ord) AS source FROM r GROUP BY 1, 2)
SELECT paper, url, source, CAST(row_number() OVER (PARTITION BY paper ORDER BY k, url) AS INTEGER) AS place FROM o""")
def download_plan(spark, sf_dir):
    names = ["local", "open_access", "unpaywall", "landing_page", "openalex", "arxiv", "core", "odd"]
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("ord"), A.pick(names, F.col("l_partkey") % 8).alias("source"), F.when(F.col("l_suppkey") % 5 == 0, " ").otherwise(F.concat(F.lit("https://x/"), (F.col("l_suppkey") % 4).cast("string"))).alias("url"))
    return L.download_plan(rows)


@query("""WITH w AS (SELECT DISTINCT url FROM pages), f AS (SELECT sha1(url) AS key, CASE WHEN page_id % 3 = 0 THEN 200 ELSE 429 END AS status FROM pages) SELECT url, sha1(url) AS key FROM w WHERE sha1(url) NOT IN (SELECT key FROM f WHERE status = 200)""")
def missing_urls(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages")
    return L.missing_urls(pages, pages.select(F.sha1("url").alias("key"), F.when(F.col("page_id") % 3 == 0, 200).otherwise(429).alias("status")))


_FN = "(CASE WHEN trim(regexp_replace({0}, '[/\\\\\\\\:*?\"<>|]', '_', 'g')) = '' THEN 'paper' ELSE left(trim(regexp_replace({0}, '[/\\\\\\\\:*?\"<>|]', '_', 'g')), 180) END)".replace("\\\\\\\\", "\\\\")


@query(f"""WITH p AS (SELECT item_id AS paper, text AS title, CASE WHEN item_id % 4 = 1 THEN '10.1000/' || item_id END AS doi, CASE WHEN item_id % 4 = 2 THEN '2401.' || lpad(item_id::VARCHAR, 5, '0') || 'v2' END AS arxiv_id FROM benchmark),
f AS (SELECT '/pdf/' || CASE item_id % 4 WHEN 0 THEN {_FN.format('text')} || '.pdf' WHEN 1 THEN 'x 10.1000_' || item_id || ' final.pdf' WHEN 2 THEN '2401.' || lpad(item_id::VARCHAR, 5, '0') || '.pdf' ELSE upper({_FN.format('text')}) || ' more words.pdf' END AS path FROM benchmark),
n AS (SELECT path, regexp_replace(list_last(string_split(path, '/')), '\\.[A-Za-z0-9]+$', '') AS name FROM f),
s AS (SELECT paper, path, greatest(CASE WHEN arxiv_id IS NOT NULL AND {_TK.format("regexp_replace(arxiv_id, 'v2$', '')")} = {_TK.format('name')} THEN 1.0 ELSE 0 END, CASE WHEN lower({_FN.format('title')}) = lower(name) THEN 1.0 ELSE 0 END,
  CASE WHEN doi IS NOT NULL AND contains(lower(path), replace(lower(doi), '/', '_')) THEN 0.95 ELSE 0 END, {_SIM.format(_TK.format('title'), _TK.format('name'), _WORDS.format(_TK.format('title')), _WORDS.format(_TK.format('name')))}) AS similarity FROM p CROSS JOIN n)
SELECT paper, path, similarity::DOUBLE AS similarity FROM s WHERE similarity >= 0.75 QUALIFY row_number() OVER (PARTITION BY paper ORDER BY similarity DESC, length(path) DESC, path DESC) = 1""")
def local_file_match(spark, sf_dir):
    d = F.col("item_id")
    t = d.cast("string")
    rows = A.table(spark, sf_dir, "benchmark")
    preprint = F.concat(F.lit("2401."), F.lpad(t, 5, "0"))
    papers = rows.select(d.alias("paper"), F.col("text").alias("title"), F.when(d % 4 == 1, F.concat(F.lit("10.1000/"), t)).alias("doi"), F.when(d % 4 == 2, F.concat(preprint, F.lit("v2"))).alias("arxiv_id"))
    name = F.when(d % 4 == 0, F.concat(X.file_name("text"), F.lit(".pdf"))).when(d % 4 == 1, F.concat(F.lit("x 10.1000_"), t, F.lit(" final.pdf"))).when(d % 4 == 2, F.concat(preprint, F.lit(".pdf"))).otherwise(F.concat(X.upper(X.file_name("text")), F.lit(" more words.pdf")))
    return L.local_files(papers, rows.select(F.concat(F.lit("/pdf/"), name).alias("path")))


_NAMES = ["a/b\\c:d*e?f\"g<h>i|j", "", "  ", " plain "]


@query(f"""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a/b' || chr(92) || 'c:d*e?f"g<h>i|j' WHEN 3 THEN ' plain' ELSE '' END || CASE WHEN doc_id % 4 = 2 THEN '' ELSE left(split_part(coalesce(text, ''), chr(10), 1), 200) END AS raw FROM documents)
SELECT doc_id, {_FN.format('raw')} AS name FROM r""")
def file_names(spark, sf_dir):
    """Names made of the first lines of texts, with signs that file systems refuse in front of some."""
    d = F.col("doc_id")
    line = F.substring(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1), 1, 200)
    raw = F.concat(F.rtrim(A.pick(_NAMES, d % 4)), F.when(d % 4 == 2, "").otherwise(line))
    return A.table(spark, sf_dir, "documents").select("doc_id", X.file_name(raw).alias("name"))


_NUMBER = "lpad(CAST(doc_id % 9000 + 1000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 4 END, '0')"


@query(rf"""WITH v AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'arXiv:' || {_NUMBER} || 'v3' WHEN 1 THEN {_NUMBER} WHEN 2 THEN '10.48550/arXiv.' || {_NUMBER} WHEN 3 THEN ' ' || {_NUMBER} || ' ' WHEN 4 THEN 'ARXIV : ' || {_NUMBER} || 'V12' WHEN 5 THEN {_NUMBER} || ' ' || left(coalesce(text, ''), 30) ELSE left(coalesce(text, ''), 40) END AS value FROM documents)
SELECT doc_id, value, regexp_matches(trim(regexp_replace(value, '10\.48550/ar[xX]iv\.|ar[xX]iv:', '', 'g')), '^\d') AND contains(trim(regexp_replace(value, '10\.48550/ar[xX]iv\.|ar[xX]iv:', '', 'g')), '.') AS loose, nullif(regexp_extract(lower(trim(value)), '^(?:10\.48550/arxiv\.)?(?:arxiv\s*:\s*)?(\d{{4}}\.\d{{4,5}})(?:v\d+)?$', 1), '') AS strict FROM v""")
def arxiv_ids(spark, sf_dir):
    """Numbers of preprints in all forms, and texts that hold or are none."""
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    number = F.concat(F.lpad((d % 9000 + 1000).cast("string"), 4, "0"), F.lit("."), F.when(d % 2 == 0, F.lpad(d.cast("string"), 5, "0")).otherwise(F.lpad(d.cast("string"), 4, "0")))
    value = (
        F.when(d % 7 == 0, F.concat(F.lit("arXiv:"), number, F.lit("v3"))).when(d % 7 == 1, number).when(d % 7 == 2, F.concat(F.lit("10.48550/arXiv."), number)).when(d % 7 == 3, F.concat(F.lit(" "), number, F.lit(" ")))
        .when(d % 7 == 4, F.concat(F.lit("ARXIV : "), number, F.lit("V12"))).when(d % 7 == 5, F.concat(number, F.lit(" "), F.substring(text, 1, 30))).otherwise(F.substring(text, 1, 40))
    )
    rows = A.table(spark, sf_dir, "documents").select("doc_id", value.alias("value"))
    return rows.select("doc_id", "value", X.arxiv_loose("value").alias("loose"), X.arxiv_strict("value").alias("strict"))


_LINKS = [("https://o.org/x.pdf?a=1", "https://o.org/x.pdf?a=1"), ("//cdn.org/y.pdf", "https://cdn.org/y.pdf"), ("/f/z.pdf", "https://h.org/f/z.pdf"), ("q.pdf", "https://h.org/a/b/q.pdf"), ("../up.pdf?p=2&amp;q=3", "https://h.org/a/up.pdf?p=2&q=3"), ("./../../../top.pdf", "https://h.org/top.pdf")]


@query("SELECT page_id, (" + A._quoted([b for _, b in _LINKS]) + ")[CAST(page_id % 6 AS INTEGER) + 1] AS url, CAST(1 AS INTEGER) AS n FROM pages")
def pdf_link_urls(spark, sf_dir):
    page = F.concat(F.coalesce("html", F.lit("")), F.lit('<a href="'), A.pick([a for a, _ in _LINKS], F.col("page_id") % 6), F.lit('">PDF</a>'), F.lit('<meta name="x">'))
    found = A.table(spark, sf_dir, "pages").select("page_id", H.pdf_urls(F.lit("https://h.org/a/b/c?d=e#f"), page).alias("urls"))
    return found.select("page_id", F.element_at("urls", 1).alias("url"), F.size("urls").alias("n"))


@query("""WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS ord, max(l_partkey) % 3 <> 0 AS opened, max(l_suppkey) % 5 * 8 AS chars, max(l_suppkey) % 2 AS pages_with_text, max(l_partkey) % 4 AS images, CASE max(l_partkey) % 6 WHEN 0 THEN 'is encrypted' WHEN 1 THEN 'EOF marker not found' END AS error FROM lineitem GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, ['pypdf', 'pymupdf', 'pdfplumber'][CAST(ord % 3 AS INTEGER) + 1] AS extractor, chars >= 20 AND pages_with_text > 0 AND error IS NULL AS good, ord = 0 AND coalesce(contains(error, 'encrypted'), FALSE) AS locked FROM a)),
u AS (SELECT *, min(CASE WHEN good OR locked THEN ord END) OVER (PARTITION BY doc_id) AS last FROM t), v AS (SELECT * FROM u WHERE last IS NULL OR ord <= last),
g AS (SELECT doc_id, arg_min(extractor, ord) FILTER (good) AS extractor, bool_or(locked) AS locked, bool_or(opened) AS opened, bool_or(opened AND images > 0) AS scanned, count(*) AS attempts, coalesce(string_agg(extractor || ': ' || error, '；' ORDER BY ord) FILTER (error IS NOT NULL), '') AS errors FROM v GROUP BY 1),
k AS (SELECT o_orderkey AS doc_id, o_orderkey % 10 <> 0 AS here, g.* EXCLUDE (doc_id) FROM orders LEFT JOIN g ON g.doc_id = o_orderkey),
r AS (SELECT *, CASE WHEN NOT here THEN 'pdf_file_missing' WHEN extractor IS NOT NULL THEN NULL WHEN locked THEN 'pdf_encrypted' WHEN opened AND scanned THEN 'likely_scanned_pdf' WHEN opened THEN 'empty_text_pdf' ELSE 'pdf_parse_failed' END AS error_type FROM k)
SELECT doc_id, error_type, CASE WHEN here THEN extractor END AS extractor, CASE WHEN here THEN attempts END AS attempts, CASE WHEN error_type = 'pdf_parse_failed' THEN errors END AS error FROM r""")
def extraction_outcome(spark, sf_dir):
    m = lambda c: F.max(F.col(c))
    tries = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("ord")).agg(
        (m("l_partkey") % 3 != 0).alias("opened"), (m("l_suppkey") % 5 * 8).alias("chars"), (m("l_suppkey") % 2).alias("pages_with_text"), (m("l_partkey") % 4).alias("image_pages"),
        F.when(m("l_partkey") % 6 == 0, "is encrypted").when(m("l_partkey") % 6 == 1, "EOF marker not found").alias("error"),
    ).withColumn("extractor", A.pick(["pypdf", "pymupdf", "pdfplumber"], F.col("ord") % 3))
    files = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 10 != 0).alias("exists"))
    return L.extraction_outcome(files, tries)


# registries


def _lines(spark, sf_dir, line):
    return A.table(spark, sf_dir, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("ord"), line.alias("line"))


_WHO = "'Name ' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || chr(CAST(65 + p_partkey % 7 AS INTEGER))"


def _who():
    k = F.col("p_partkey")
    return F.concat(F.lit("Name "), F.chr(65 + k % 26), F.chr(65 + k % 7))


@query(f"""WITH a AS (SELECT p_partkey AS ord, {_WHO} AS name, 1990 + p_partkey % 30 AS y FROM part WHERE p_partkey % 4 < 3)
SELECT name, 'acm_fellow' AS tag_type, 'ACM Fellow, elected ' || arg_min(y, ord) AS note, 'https://x' AS source_link FROM a GROUP BY name""")
def award_table(spark, sf_dir):
    k, year = F.col("p_partkey"), (1990 + F.col("p_partkey") % 30).cast("string")
    line = F.when(k % 4 == 0, F.concat_ws("\t", _who(), F.lit("ACM Fellows"), year, F.lit("X"))).when(k % 4 == 3, F.concat_ws("\t", _who(), F.lit("Other Award"), year)).otherwise(F.concat(_who(), F.lit(" ACM Fellows "), year, F.lit(" Europe")))
    return G.award_table(_lines(spark, sf_dir, line), link="https://x")


_WIKI = f"""WITH a AS (SELECT p_partkey AS ord, {_WHO} AS name, CAST(1990 + p_partkey % 30 AS VARCHAR) AS year, CASE WHEN p_partkey % 3 = 0 THEN 'works' ELSE 'for work ' || p_partkey % 5 END AS citation FROM part WHERE p_partkey % 5 <> 0)
SELECT name, 'ieee_fellow' AS tag_type, arg_min(year, ord) AS year, arg_min(citation, ord) AS citation, 'Computer Society' AS society FROM a GROUP BY name"""


def _wiki_cells():
    k = F.col("p_partkey")
    return [F.when(k % 5 == 0, "Year").otherwise((1990 + k % 30).cast("string")), F.concat(_who(), F.when(k % 2 == 0, "[a]").otherwise("")), F.when(k % 3 == 0, "works").otherwise(F.concat(F.lit("for work "), (k % 5).cast("string")))]


@query(_WIKI)
def wiki_rows(spark, sf_dir):
    return G.wiki_table(_lines(spark, sf_dir, F.concat_ws("\t", *_wiki_cells())))


@query(_WIKI)
def wiki_html_rows(spark, sf_dir):
    cell = lambda c: F.concat(F.lit("<td class='c'> <b>"), c, F.lit("</b>&nbsp;</td>"))
    page = F.concat(F.lit('<table class="x"><tr><td>2000</td><td>No One</td></tr></table><table class="sortable wikitable"><tr><th>Year</th></tr><tr>'), *map(cell, _wiki_cells()), F.lit("</tr></table>"))
    pages = A.table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("file"), page.alias("html"))
    return G.wiki_table(H.table_lines(pages, "file", "html"))


@query(f"""WITH a AS (SELECT p_partkey AS ord, {_WHO} AS name, 'for work ' || p_partkey % 5 AS citation FROM part WHERE p_partkey % 4 < 2)
SELECT name, 'ieee_fellow' AS tag_type, arg_min(citation, ord) AS citation FROM a GROUP BY name""")
def fellow_list(spark, sf_dir):
    k = F.col("p_partkey")
    said = F.concat(F.lit("for work "), (k % 5).cast("string"))
    line = F.when(k % 4 == 0, F.concat(F.lit("* "), _who(), F.lit(" – "), said)).when(k % 4 == 1, F.concat(_who(), F.lit(" "), said)).when(k % 4 == 2, F.concat(F.lit("Please visit "), _who(), F.lit(" for more"))).otherwise(_who())
    return G.fellow_list(_lines(spark, sf_dir, line))


@query(f"SELECT CAST(page_id AS BIGINT) AS page_id, 'Name ' || page_id AS name, CAST(1990 + page_id % 30 AS INTEGER) AS year FROM pages WHERE page_id % 3 <> 0")
def award_html(spark, sf_dir):
    d = F.col("page_id")
    row = F.concat(F.lit("<tr><td>Name "), d.cast("string"), F.lit("</td><td>ACM Fellows</td><td>"), F.when(d % 3 == 0, "unknown").otherwise((1990 + d % 30).cast("string")), F.lit("</td></tr>"))
    pages = A.table(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), row).alias("html"))
    return H.award_rows(H.text_nodes(pages, "page_id", "html"), "page_id", "ACM Fellows")


@query(f"""SELECT 'N' || p_partkey AS name, t AS tag_type, CASE WHEN p_partkey % 3 = 0 THEN 'flat' ELSE '' END AS note FROM (SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['acm_fellow'] WHEN 1 THEN ['ieee_fellow', 'acm_fellow'] ELSE ['cae_academician'] END) AS t FROM part)""")
def tag_expand(spark, sf_dir):
    k = F.col("p_partkey")
    tag = lambda t: F.struct(F.lit(t).alias("type"), F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("source_links"), F.lit("").alias("note"))
    none = F.array().cast("array<string>")
    items = A.table(spark, sf_dir, "part").select(
        F.concat(F.lit("N"), k.cast("string")).alias("name"), none.alias("aliases"), none.alias("matched_affiliations"), F.lit("acm_fellow").alias("tag_type"), none.alias("source_links"), F.lit("flat").alias("note"),
        F.when(k % 3 == 1, F.array(tag("ieee_fellow"), tag("acm_fellow"))).when(k % 3 == 2, F.array(tag(" "), tag("cae_academician"))).alias("tags"),
    )
    return G.expand_tags(items).select("name", "tag_type", "note")


@query("""WITH a AS (SELECT p_partkey, (['ACM', 'WIKI', 'LIST', 'NONE'])[CAST(p_partkey % 4 AS INTEGER) + 1] AS f FROM part)
SELECT 'award_table' AS kind, count(DISTINCT p_partkey) AS n FROM a WHERE f = 'ACM' UNION ALL SELECT 'wiki_table', count(*) FROM a WHERE f = 'WIKI' UNION ALL SELECT 'fellow_list', count(*) FROM a WHERE f = 'LIST'""")
def source_dispatch(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("Name "), k.cast("string"))
    kind = A.pick(["ACM", "WIKI", "LIST", "NONE"], k % 4)
    line = F.when(kind == "ACM", F.concat(name, F.lit("\tACM Fellows\t2001"))).when(kind == "WIKI", F.concat(F.lit("2001\t"), name, F.lit("\tfor work"))).otherwise(F.concat(name, F.lit(" – for work")))
    rows = A.table(spark, sf_dir, "part").select(kind.alias("file"), k.alias("ord"), line.alias("line"))
    heads = spark.createDataFrame([("WIKI", -1, "Year\tFellow\tCitation"), ("LIST", -1, "IEEE Computer Society Fellows")], "file string, ord long, line string")
    found = G.text_entries(rows.unionByName(heads))
    one = lambda k: found[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return one("award_table").unionByName(one("wiki_table")).unionByName(one("fellow_list"))


@query("""WITH a AS (SELECT doc_id, 'KEY' || doc_id % 7 AS key, doc_id % 5 AS how FROM documents), v AS (SELECT key, max(doc_id) AS last FROM a WHERE how < 3 GROUP BY 1)
SELECT key, 'v' || last AS value, TRUE AS flag, CAST(60 AS INTEGER) AS number FROM v UNION ALL SELECT * FROM (VALUES ('OFF', ' no ', FALSE, 60), ('LESS', '-3', TRUE, 0), ('MORE', '12', TRUE, 12))""")
def config_values(spark, sf_dir):
    d = F.col("doc_id")
    key, value = F.concat(F.lit("KEY"), (d % 7).cast("string")), F.concat(F.lit("v"), d.cast("string"))
    line = F.when(d % 5 == 0, F.concat(key, F.lit('="'), value, F.lit('"'))).when(d % 5 == 1, F.concat(F.lit(" "), key, F.lit(" = '"), value, F.lit("' "))).when(d % 5 == 2, F.concat(key, F.lit("="), value)).when(d % 5 == 3, F.concat(F.lit("# "), key, F.lit("=x"))).otherwise(key)
    lines = A.table(spark, sf_dir, "documents").select(F.lit(0).alias("file"), d.alias("ord"), line.alias("line"))
    more = spark.createDataFrame([(1, 0, 'OFF=" no "'), (1, 1, "LESS=-3"), (1, 2, "MORE=12")], "file int, ord long, line string")
    return G.env_values(lines.unionByName(more)).select("key", "value", X.env_flag(F.col("value")).alias("flag"), X.env_int(F.col("value"), 60).alias("number"))
