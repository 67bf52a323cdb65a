"""Queries over findings, statuses, views, gold cases, messages and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as X
from ..operators import findings as M
from ..operators import passages as S
from ..operators import selection as N
from ..session import checkpointed, scratch
from ..sources import html as H
from ..sources import snapshots as Z
from ..streaming import tasks as T
from ..streaming import views as U

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


NORMAL = f"""WITH {A.FINDINGS_SQL}, k AS (SELECT *, CASE WHEN lower(trim(keep_text)) IN ('true', '1', 'yes', 'y', '是') THEN TRUE ELSE FALSE END AS keep, TRY_CAST(confidence_text AS DOUBLE) AS c FROM findings),
normal0 AS (SELECT doc_id, ord, page, span_index, keep,
  CASE WHEN aspect IN ('background', 'method', 'baseline', 'comparison', 'extension', 'application', 'other') THEN aspect WHEN keep THEN 'other' ELSE 'background' END AS aspect,
  CASE WHEN stance IN ('positive', 'neutral', 'negative') THEN stance ELSE 'neutral' END AS stance,
  CASE WHEN c IS NULL THEN CASE WHEN keep THEN 0.6 ELSE 0.35 END ELSE least(1.0, greatest(0.0, c)) END AS confidence,
  CASE WHEN mention_type IN ('explicit_citation', 'grouped_literature_mention', 'weak_body_mention') THEN mention_type WHEN keep THEN 'explicit_citation' ELSE 'weak_body_mention' END AS mention_type, citation_text FROM k),
normal AS (SELECT * REPLACE (CASE WHEN NOT keep AND mention_type = 'explicit_citation' THEN CASE WHEN regexp_matches(citation_text, '\\[\\s*\\d+\\s*(?:[,，;；]\\s*\\d+\\s*)+\\]') THEN 'grouped_literature_mention' ELSE 'weak_body_mention' END ELSE mention_type END AS mention_type) FROM normal0) """


def normal(spark, sf_dir):
    return M.normalise_findings(A.findings(spark, sf_dir))


@query(NORMAL + "SELECT * FROM normal")
def finding_normalize(spark, sf_dir):
    return normal(spark, sf_dir)


_DOCS = """docs AS (SELECT l.doc_id, l.doc_id % 2 = 0 AS has_index, l.doc_id % 3 AS index_hits, l.doc_id % 6 AS top_score, (['citation_index_exact', 'context_similarity', 'keyword_fallback', 'citation_index_neighbor'])[CAST(l.doc_id % 4 AS INTEGER) + 1] AS top_kind,
  coalesce(f.n, 0) AS findings, coalesce(f.strong, 0) AS strong FROM labels l LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (mention_type = 'explicit_citation') AS strong FROM (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id) FROM normal) GROUP BY 1) f USING (doc_id)),
statuses AS (SELECT doc_id, CASE WHEN strong > 0 THEN 'fulltext_analyzed' WHEN findings > 0 THEN 'mention_only' WHEN has_index AND index_hits = 0 THEN 'reference_only' WHEN top_kind LIKE 'citation_index%' THEN 'mention_only' WHEN top_score >= 3 THEN 'mention_only' ELSE 'fulltext_no_finding' END AS status FROM docs) """


def statuses(spark, sf_dir):
    d = F.col("doc_id")
    counts = normal(spark, sf_dir).withColumn("doc_id", F.when(d % 5 == 0, -1 - d).otherwise(d)).groupBy("doc_id").agg(F.count("*").alias("findings"), F.count_if(F.col("mention_type") == "explicit_citation").alias("strong"))
    docs = A.table(spark, sf_dir, "labels").select(
        "doc_id", (d % 2 == 0).alias("has_index"), (d % 3).alias("index_hits"), (d % 6).alias("top_score"),
        F.array(A.pick(["citation_index_exact", "context_similarity", "keyword_fallback", "citation_index_neighbor"], d % 4)).alias("top_evidence"),
    ).join(counts, "doc_id", "left").fillna(0, ["findings", "strong"])
    return docs.select("doc_id", M.status_of(docs).alias("status"))


@query(NORMAL + ", " + _DOCS + "SELECT * FROM statuses")
def status_cascade(spark, sf_dir):
    return statuses(spark, sf_dir)


@query(NORMAL + ", " + _DOCS + "SELECT status, count(*) AS n FROM statuses GROUP BY status")
def status_counts(spark, sf_dir):
    return statuses(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


SUMMARY = NORMAL.replace("WITH ", f"WITH {A.SPANS_SQL}, ", 1) + ", " + _DOCS + """, top AS (SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS char_length, greatest(1, len(list_filter(regexp_split_to_array(text, '[。！？!?；;]+'), lambda p: trim(p) <> ''))) AS sentence_count FROM spans WHERE place = 1), o AS (SELECT doc_id, page, span_index, min(ord) AS ord FROM normal GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN lag(page) OVER w = page AND lag(span_index) OVER w + 1 = span_index THEN 0 ELSE 1 END AS starts FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
isl AS (SELECT doc_id, count(*) AS occurrences, CAST(sum(starts) AS BIGINT) AS islands, min(page) AS page_start, max(page) AS page_end FROM s GROUP BY doc_id),
lab AS (SELECT doc_id, list_sort(list(DISTINCT l)) AS labels FROM (SELECT doc_id, aspect AS l FROM normal UNION ALL SELECT doc_id, mention_type FROM normal WHERE mention_type <> 'explicit_citation') WHERE l <> '' GROUP BY 1),
summary AS (SELECT n.doc_id, l.labels, bool_or(regexp_matches(lower(citation_text), 'for the first time|our work is the first|we are the first|first to')) AS first_claim, max(confidence) AS confidence, any_value(char_length) AS char_length, any_value(sentence_count) AS sentence_count, any_value(occurrences) AS occurrences, any_value(islands) AS islands, any_value(page_start) AS page_start, any_value(page_end) AS page_end, any_value(status) AS status
  FROM normal n JOIN isl USING (doc_id) JOIN lab l USING (doc_id) JOIN statuses USING (doc_id) JOIN top USING (doc_id) GROUP BY 1, 2) """


def summary(spark, sf_dir):
    rows = normal(spark, sf_dir)
    top = A.spans(spark, sf_dir).where("place = 1").select("doc_id", X.visible_length("text").alias("char_length"), X.sentence_count("text").alias("sentence_count"))
    return M.method_summary(rows, S.islands(rows)).join(statuses(spark, sf_dir), "doc_id").join(top, "doc_id")


@query(SUMMARY + "SELECT doc_id, array_to_string(labels, ',') AS labels, first_claim, confidence, occurrences, islands, page_start, page_end FROM summary")
def method_summary(spark, sf_dir):
    return summary(spark, sf_dir).select("doc_id", F.array_join("labels", ",").alias("labels"), "first_claim", "confidence", "occurrences", "islands", "page_start", "page_end")


@query(SUMMARY + """, g AS (SELECT unnest(list_filter([CASE WHEN status = 'reference_only' THEN 'reference_only' END, CASE WHEN list_contains(labels, 'background') THEN 'background' END, CASE WHEN list_contains(labels, 'baseline') THEN 'baseline' END,
  CASE WHEN list_contains(labels, 'application') THEN 'application' END, CASE WHEN list_contains(labels, 'extension') THEN 'extension' END, CASE WHEN occurrences >= 2 OR islands >= 2 OR char_length >= 500 OR sentence_count >= 4 THEN 'large_scale' END, CASE WHEN first_claim THEN 'first_claim' END, CASE WHEN status = 'mention_only' THEN 'mention_only' END], lambda x: x IS NOT NULL)) AS method FROM summary),
n AS (SELECT method, count(*) AS n FROM g GROUP BY 1)
SELECT group_ord, m.method, coalesce(n, 0) AS n FROM (VALUES (0, 'reference_only'), (1, 'background'), (2, 'baseline'), (3, 'application'), (4, 'extension'), (5, 'large_scale'), (6, 'first_claim'), (7, 'mention_only')) m(group_ord, method) LEFT JOIN n USING (method)""")
def method_group_stats(spark, sf_dir):
    return M.method_statistics(summary(spark, sf_dir))


_DOWN = "(['local_available', 'auto_downloadable', 'manual_required', 'not_probed', 'probe_failed'])[CAST(doc_id % 5 AS INTEGER) + 1]"


def detail(spark, sf_dir):
    down = A.pick(["local_available", "auto_downloadable", "manual_required", "not_probed", "probe_failed"], F.col("doc_id") % 5)
    return summary(spark, sf_dir).withColumn("download_status", down).withColumn("candidate_count", F.col("doc_id") % 2)


@query(SUMMARY + f""", d AS (SELECT *, {_DOWN} AS download_status, doc_id % 2 AS candidate_count FROM summary)
SELECT 'strong' AS view, count(*) AS n, coalesce(sum(occurrences), 0)::BIGINT AS occurrences FROM d WHERE first_claim
UNION ALL SELECT 'people', count(*), coalesce(sum(occurrences), 0)::BIGINT FROM d WHERE candidate_count > 0 AND status = 'mention_only'
UNION ALL SELECT 'local', count(*), coalesce(sum(occurrences), 0)::BIGINT FROM d WHERE download_status = 'local_available'""")
def detail_filter_stats(spark, sf_dir):
    d = detail(spark, sf_dir)
    one = lambda name, df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences")).select(F.lit(name).alias("view"), "n", "occurrences")
    return one("strong", M.detail_filter(d, strong_only=True)).unionByName(one("people", M.detail_filter(d, analysis_status="mention_only", candidate_only=True))).unionByName(one("local", M.detail_filter(d, download_status="local_available")))


@query(SUMMARY + f"SELECT doc_id, download_status, download_status IN ('local_available', 'auto_downloadable') AS can_download, download_status = 'local_available' AS can_analyze FROM (SELECT doc_id, {_DOWN} AS download_status FROM summary)")
def card_state(spark, sf_dir):
    return M.cards(detail(spark, sf_dir))


@query(SUMMARY + f"SELECT count(*) FILTER (download_status = 'local_available') AS downloaded, count(*) AS analyzed, count(*) FILTER (status IN ('fulltext_analyzed', 'mention_only', 'reference_only', 'fulltext_no_finding')) AS qa_ready FROM (SELECT status, {_DOWN} AS download_status FROM summary)")
def overview_counts(spark, sf_dir):
    d = detail(spark, sf_dir)
    return d.agg(F.count_if(F.col("download_status") == "local_available").alias("downloaded"), F.count("*").alias("analyzed"), F.count_if(F.col("status").isin(M.QA_STATUSES)).alias("qa_ready"))


@query(NORMAL + ", " + _DOCS + "SELECT doc_id, status FROM statuses WHERE doc_id IN (SELECT doc_id FROM normal WHERE keep) AND doc_id IN (SELECT CASE WHEN doc_id % 3 = 0 THEN -1 - doc_id ELSE doc_id END FROM documents)")
def qa_ready_semi(spark, sf_dir):
    d = F.col("doc_id")
    spans = A.table(spark, sf_dir, "documents").select(F.when(d % 3 == 0, -1 - d).otherwise(d).alias("doc_id"))  # some spans are of unknown documents
    return M.qa_ready(statuses(spark, sf_dir), spans, normal(spark, sf_dir).where("keep"))


@query("""WITH g AS (SELECT 'Target' AS target, 'Doc  ' || doc_id AS citing, CASE quality WHEN 1 THEN 'fulltext_analyzed' ELSE 'mention_only' END AS gold_status, doc_id % 7 = 0 AS review FROM labels),
r AS (SELECT CASE WHEN doc_id % 4 = 1 THEN 'unknown ' ELSE 'doc ' END || doc_id AS citing, CASE WHEN text LIKE '%!!%' THEN 'mention_only' ELSE 'fulltext_analyzed' END AS status FROM documents),
c AS (SELECT g.gold_status, r.status FROM g LEFT JOIN r ON regexp_replace(lower(g.citing), '\\s+', ' ', 'g') = r.citing WHERE NOT review)
SELECT count(*) AS gold_count, count(status) AS matched, count(*) FILTER (status = gold_status) AS status_match, CASE WHEN count(status) > 0 THEN round(count(*) FILTER (status = gold_status) / count(status), 4) ELSE 0.0 END AS match_rate FROM c""")
def gold_match_rate(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    gold = A.table(spark, sf_dir, "labels").select(F.lit("Target").alias("target"), F.concat(F.lit("Doc  "), d).alias("citing"), F.when(F.col("quality") == 1, "fulltext_analyzed").otherwise("mention_only").alias("gold_status"), (F.col("doc_id") % 7 == 0).alias("needs_review"))
    runs = A.table(spark, sf_dir, "documents").select(F.lit("target").alias("target"), F.concat(F.when(F.col("doc_id") % 4 == 1, "unknown ").otherwise("doc "), d).alias("citing"), F.when(F.col("text").contains("!!"), "mention_only").otherwise("fulltext_analyzed").alias("status"), F.col("doc_id").alias("ord"))
    return M.gold_report(gold, runs)


@query(f"WITH {A.FINDINGS_SQL}, f AS (SELECT doc_id, ord, CASE WHEN ord % 2 = 0 THEN 'uses ' || aspect ELSE trim(stance) END AS fn FROM findings), d AS (SELECT doc_id, fn, min(ord) AS ord FROM f WHERE trim(fn) <> '' GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place FROM d) SELECT doc_id, string_agg(fn, ' | ' ORDER BY ord) AS functions FROM p WHERE place <= 3 GROUP BY doc_id")
def function_summary(spark, sf_dir):
    f = A.findings(spark, sf_dir).select("doc_id", "ord", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("uses "), "aspect")).otherwise(F.trim("stance")).alias("function"))
    return M.first_functions(f)


@query("""WITH r AS (SELECT o_orderkey AS ord, o_custkey % 50 AS session, CASE WHEN o_orderkey % 3 = 0 THEN 'context_only' WHEN o_orderkey % 7 = 0 THEN 'analysis_failed' ELSE 'fulltext_analyzed' END AS status FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN status IN ('context_only', 'fulltext_extract_failed', 'analysis_failed') THEN 1 ELSE 0 END, ord) AS place FROM r)
SELECT session, ord, status, CAST(place AS INTEGER) AS place FROM p WHERE place <= 10""")
def early_batch(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 3 == 0, "context_only").when(F.col("o_orderkey") % 7 == 0, "analysis_failed").otherwise("fulltext_analyzed")
    return M.prioritised(A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("session"), F.col("o_orderkey").alias("ord"), status.alias("status")), 10)


@query("""WITH r AS (SELECT o_custkey % 40 AS q, CASE WHEN o_orderkey % 3 = 0 THEN 'context_only' WHEN o_orderkey % 7 = 0 THEN 'analysis_failed' ELSE 'fulltext_analyzed' END AS status FROM orders)
SELECT status, count(*) AS n, count(DISTINCT q) AS queries FROM r GROUP BY status""")
def batch_status_report(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 3 == 0, "context_only").when(F.col("o_orderkey") % 7 == 0, "analysis_failed").otherwise("fulltext_analyzed")
    return A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("q"), status.alias("status")).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("q").alias("queries"))


@query("""WITH a AS (SELECT l_orderkey AS paper, l_linenumber AS ord, min(l_quantity) > 5 AS ok, max(l_partkey) % 7 = 0 AS local, max(l_suppkey) % 3 AS candidates FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN NOT ok THEN 'probe_failed' WHEN local THEN 'local_available' WHEN candidates > 0 THEN 'auto_downloadable' ELSE 'manual_required' END AS status FROM a)
SELECT paper, coalesce(arg_min(status, ord) FILTER (status IN ('local_available', 'auto_downloadable')), arg_min(status, ord) FILTER (ok), arg_max(status, ord)) AS status, count(*) AS attempts FROM s GROUP BY paper""")
def download_status(spark, sf_dir):
    attempts = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("ord")).agg((F.min("l_quantity") > 5).alias("ok"), (F.max("l_partkey") % 7 == 0).alias("local"), (F.max("l_suppkey") % 3).alias("candidates"))
    return M.probe_status(attempts)


_ERRORS = ["File has not been decrypted: password needed", "EOF marker not found", "Broken xref table", "Connection refused by host", "status code 400", "maximum context length is 8192", "HTTP 429: rate limit", "boom", "Stream has ended UNEXPECTEDLY", None]
_ERRORS_SQL = "([" + ", ".join("NULL" if e is None else f"'{e}'" for e in _ERRORS) + "])[CAST(event_id % 10 AS INTEGER) + 1]"


@query(f"""WITH e AS (SELECT doc_id, lower(left(coalesce(text, ''), 60) || ' ' || coalesce({_ERRORS_SQL.replace('event_id', 'doc_id')}, '')) AS e FROM documents)
SELECT doc_id, CASE WHEN contains(e, 'password') OR contains(e, 'encrypted') THEN 'pdf_encrypted' WHEN regexp_matches(e, 'stream has ended unexpectedly|eof marker not found|broken xref|malformed|trailer|unexpectedly') THEN 'pdf_corrupted_or_malformed' ELSE 'pdf_extract_exception' END AS extract_class,
CASE WHEN regexp_matches(e, 'available context size|maximum context length|context length exceeded') THEN 'context_length_exceeded' WHEN regexp_matches(e, 'connection refused|max retries exceeded|failed to establish a new connection|name or service not known|timed out') THEN 'service_unreachable' WHEN regexp_matches(e, '400 client error|status code 400') THEN 'bad_request' ELSE 'request_failed' END AS request_class,
contains(e, '429') OR contains(e, 'rate limit') AS rate_limited FROM e""")
def extract_failure_class(spark, sf_dir):
    """Classes of messages that begin with what texts begin with."""
    values = F.array(*(F.lit(e).cast("string") for e in _ERRORS))
    error = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 60), F.lit(" "), F.coalesce(F.element_at(values, (F.col("doc_id") % 10 + 1).cast("int")), F.lit("")))
    rows = A.table(spark, sf_dir, "documents").select("doc_id", error.alias("e"))
    return rows.select("doc_id", M.extract_failure(F.col("e")).alias("extract_class"), M.request_failure(F.col("e")).alias("request_class"), M.rate_limited(F.col("e")).alias("rate_limited"))


# pages


@query(r"""WITH p AS (SELECT page_id, coalesce(html, '') || CASE WHEN page_id % 3 = 0 THEN '<meta name="citation_pdf_url" content="https://x.org/' || page_id || '.pdf">' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN '<a href="/files/' || page_id || '.pdf?dl=1&amp;v=2">PDF</a>' ELSE '' END AS html FROM pages),
l AS (SELECT page_id, list_concat(regexp_extract_all(html, '(?i)<meta[^>]+name=["'']citation_pdf_url["''][^>]+content=["'']([^"'']+)["'']', 1), regexp_extract_all(html, '(?i)href=["'']([^"'']+\.pdf(?:\?[^"'']*)?)["'']', 1)) AS links FROM p)
SELECT page_id, array_to_string(list_transform(links, lambda x: replace(x, '&amp;', '&')), ' ') AS links, CAST(len(links) AS INTEGER) AS n FROM l WHERE len(links) > 0""")
def html_links(spark, sf_dir):
    d = F.col("page_id").cast("string")
    more = F.concat(
        F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta name="citation_pdf_url" content="https://x.org/'), d, F.lit('.pdf">'))).otherwise(""),
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<a href="/files/'), d, F.lit('.pdf?dl=1&amp;v=2">PDF</a>'))).otherwise(""),
    )
    found = A.table(spark, sf_dir, "pages").select("page_id", H.pdf_links(more).alias("links")).where(F.size("links") > 0)
    return found.select("page_id", F.array_join("links", " ").alias("links"), F.size("links").alias("n"))


@query(r"""WITH t AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM pages),
n AS (SELECT page_id, CAST(i AS INTEGER) AS seq, parts[i] AS text, CASE WHEN i > 1 THEN parts[i - 1] END AS before, parts[i + 1] AS after FROM t, unnest(generate_series(1, len(parts))) u(i))
SELECT page_id, seq, before, text, after FROM n WHERE text LIKE '&copy;%'""")
def html_neighbors(spark, sf_dir):
    nodes = H.text_nodes(A.table(spark, sf_dir, "pages"), "page_id", "html")
    return H.with_neighbours(nodes, "page_id").where(F.col("text").startswith("&copy;")).select("page_id", "seq", "before", "text", "after")


# messages


_NUM = "['一','二','三','四','五','六','七','八','九','十','十二','二十','三十五','3','12']"


@query(f"""WITH m AS (SELECT conv_id, turn, '看第' || ({_NUM})[CAST((conv_id * 3 + turn) % 15 AS INTEGER) + 1] || '篇和第 ' || ({_NUM})[CAST((conv_id + turn) % 15 AS INTEGER) + 1] || ' 篇' AS t FROM conversations WHERE role = 'user'),
v(raw, n) AS (VALUES ('一',1),('二',2),('三',3),('四',4),('五',5),('六',6),('七',7),('八',8),('九',9),('十',10),('十二',12),('二十',20),('三十五',35),('3',3),('12',12)),
x AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, '第\\s*([0-9一二两三四五六七八九十]+)\\s*篇', 1)) AS raw, generate_subscripts(regexp_extract_all(t, '第\\s*([0-9一二两三四五六七八九十]+)\\s*篇', 1), 1) AS i FROM m)
SELECT conv_id, turn, string_agg(printf('P%03d', n), ',' ORDER BY i) AS ids FROM x JOIN v USING (raw) GROUP BY 1, 2""")
def message_ids(spark, sf_dir):
    numerals = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十二", "二十", "三十五", "3", "12"]
    rows = A.table(spark, sf_dir, "conversations").where("role = 'user'")
    text = F.concat(F.lit("看第"), A.pick(numerals, (F.col("conv_id") * 3 + F.col("turn")) % 15), F.lit("篇和第 "), A.pick(numerals, (F.col("conv_id") + F.col("turn")) % 15), F.lit(" 篇"))
    return rows.select("conv_id", "turn", F.array_join(N.message_ids(text), ",").alias("ids"))


_NR = "trim(regexp_replace(lower({0}), '[^a-z0-9一-鿿]+', ' ', 'g'))"


SELECT_SQL = f"""WITH p AS (SELECT item_id AS id, text AS title FROM benchmark), m AS (SELECT conv_id * 100 + turn AS message, text, {_NR.format("coalesce(text, '')")} AS said FROM conversations WHERE role = 'user'),
a AS (SELECT id, title, {_NR.format('title')} AS n, {_NR.format("trim(list_filter(regexp_split_to_array(title, '[:：|/-]'), lambda x: trim(x) <> '')[1])")} AS h FROM p WHERE trim(title) <> ''),
k0 AS (SELECT *, list_filter(string_split(n, ' '), lambda w: (length(w) >= 3 OR regexp_full_match(w, '[0-9]+')) AND NOT list_contains({A._quoted(N.STOP)}, w)) AS ws FROM a),
k AS (SELECT id, n, h, list_slice(list_filter(ws, lambda x, i: list_position(ws, x) = i), 1, 8) AS kw FROM k0),
w AS (SELECT message, said, list_distinct(list_filter(string_split(said, ' '), lambda x: x <> '')) AS words FROM m),
f AS (SELECT *, list_filter(kw, lambda x: list_contains(words, x) OR (length(x) >= 5 AND contains(said, x))) AS found,
  greatest(CASE WHEN length(n) >= 6 AND contains(said, n) THEN 120 ELSE 0 END, CASE WHEN length(n) >= 5 AND contains(said, n) THEN 80 + least(length(n), 30) ELSE 0 END, CASE WHEN length(h) >= 5 AND contains(said, h) THEN 80 + least(length(h), 30) ELSE 0 END) AS base FROM w CROSS JOIN k),
s AS (SELECT message, id, base + CASE WHEN len(found) > 0 THEN 16 * len(found) + least(list_max(list_transform(found, lambda x: length(x))), 20) + CASE WHEN len(found) >= 2 THEN 20 ELSE 0 END ELSE 0 END AS score FROM f)"""


@query(SELECT_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY score DESC, id) AS place FROM s WHERE score >= 24),
g AS (SELECT message, count(*) AS n, max(id) FILTER (place = 1) AS best, max(score) FILTER (place = 1) AS b, max(score) FILTER (place = 2) AS s2 FROM r GROUP BY 1)
SELECT message, n, best, CAST(b AS INTEGER) AS best_score, CASE WHEN regexp_matches(m.text, '[、,/，]|以及|和|及|还有') THEN 'several' WHEN s2 >= greatest(24, b - 10) THEN 'ambiguous' ELSE 'ok' END AS state FROM g JOIN m USING (message)""")
def paper_selection(spark, sf_dir):
    papers = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))
    messages = A.table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("message"), "text")
    return N.select_papers(messages, papers)


# tasks


TASKS = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, ts, event_id, CASE (event_id * 7 + user_id) % 4 WHEN 2 THEN 'succeed' WHEN 3 THEN 'fail' ELSE 'start' END AS kind FROM events),
b AS (SELECT *, coalesce(lag(kind) OVER w = 'start', FALSE) AS busy FROM e WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)),
a AS (SELECT *, busy <> (kind = 'start') AS accepted FROM b),
st AS (SELECT session, ts, event_id, accepted, coalesce(last_value(CASE WHEN accepted THEN CASE kind WHEN 'start' THEN 'running' WHEN 'succeed' THEN 'succeeded' ELSE 'failed' END END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'idle') AS state FROM a) """


def requests(spark, sf_dir):
    kind = F.when((F.col("event_id") * 7 + F.col("user_id")) % 4 == 2, "succeed").when((F.col("event_id") * 7 + F.col("user_id")) % 4 == 3, "fail").otherwise("start")
    return A.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("ord"))


@query(TASKS + "SELECT session, event_id AS ord, state, accepted FROM st")
def task_state(spark, sf_dir):
    return T.task_states(requests(spark, sf_dir)).select("session", "ord", "state", "accepted")


@query(TASKS + "SELECT session, count(*) AS requests, count(*) FILTER (NOT accepted) AS refused, max(state) FILTER (back = 1) AS state FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS back FROM st) GROUP BY session")
def task_status(spark, sf_dir):
    return T.task_status(requests(spark, sf_dir)).select("session", "requests", "refused", "state")


@query(f"""WITH {A.MARKED_SQL}, l AS (SELECT doc_id, seq, lower(text) AS t FROM marked),
f AS (SELECT doc_id, CAST(1 AS INTEGER) AS page, seq AS span_index, contains(t, '[') AS marked, contains(t, 'improve') AS good, CASE WHEN regexp_matches(t, 'extend|build on|builds on') THEN 'extension' WHEN regexp_matches(t, 'baseline|compared|outperform') THEN 'baseline' WHEN regexp_matches(t, 'apply|applied|use of') THEN 'application'
  WHEN regexp_matches(t, 'versus|unlike|in contrast') THEN 'comparison' WHEN contains(t, 'the') THEN 'background' ELSE 'other' END AS aspect FROM l)
SELECT doc_id, page, span_index, marked AND aspect <> 'other' AS keep, aspect, CASE WHEN good THEN 'positive' ELSE 'neutral' END AS stance, CASE WHEN marked THEN 0.8 ELSE 0.35 END::DOUBLE AS confidence, CASE WHEN marked THEN 'explicit_citation' ELSE 'weak_body_mention' END AS mention_type FROM f""")
def semantic_stub(spark, sf_dir):
    from ..operators import semantics

    spans = A.marked(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.col("seq").alias("span_index"), "text")
    return semantics.cue_findings(spans).drop("error_type")


#: Answers by remainder of conv_id + turn ({t}: the turn, {x}: what was said without brackets), and the JSON that each holds.
_ANSWERS = [
    ('{"findings": [{"page": 1, "span_index": {t}}]}', '{"findings":[{"page":1,"span_index":{t}}]}'),
    ('<think>{"findings": [0]} {x}</think> Answer: ```json\n{"findings": [{t}]}\n```', '{"findings":[{t}]}'),
    ('{x} first {"a": 1} then {"findings": [{t}]} and {"b": 2}', '{"findings":[{t}]}'),
    ('```json\n{"findings": [{t}]}\n``` {x} ```\n{broken\n```', '{"findings":[{t}]}'),
    ('{x} <think> never closed {"findings": [1]}', None),
    ('{x} {"a": {"b": {t}}} end', '{"b":{t}}'),
    ('{x} list [1, {t}] and {broken', '[1,{t}]'),
    ('no {x}', None),
    (' [{t}, 2] ', '[{t},2]'),
    ('{x} {"x": "a } b", "findings": null} {"y": "q\\" {"}', '{"y":"q\\" {"}'),
]


def _answers_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''").replace("{t}", "' || turn || '") + "'"
    cases = " ".join(f"WHEN {k} THEN {'NULL' if want is None else quote(want)}" for k, (_, want) in enumerate(_ANSWERS))
    return f"SELECT conv_id, turn, CASE (conv_id + turn) % {len(_ANSWERS)} {cases} END AS json FROM conversations"


@query(_answers_sql())
def json_recover(spark, sf_dir):
    from ..operators import semantics

    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\]{}`<>]", "")
    filled = lambda form: F.replace(F.replace(F.lit(form), F.lit("{t}"), F.col("turn").cast("string")), F.lit("{x}"), said)
    kind = (F.col("conv_id") + F.col("turn")) % len(_ANSWERS)
    answer = F.coalesce(*(F.when(kind == k, filled(form)) for k, (form, _) in enumerate(_ANSWERS)))
    rows = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"))
    return semantics.recovered_json(rows, "answer").select("conv_id", "turn", "json")


@query("""WITH d AS (SELECT doc_id, doc_id % 12 AS k, doc_id % 5 = 4 AS two, doc_id % 35 = 3 AS odd, doc_id % 11 = 5 AS bare FROM documents),
r AS (SELECT doc_id, bare, CASE WHEN odd THEN 'invalid_analysis_mode' WHEN bare AND NOT two AND doc_id % 2 = 0 THEN 'fulltext_direct_empty_text' WHEN bare THEN NULL
    WHEN two THEN CASE k WHEN 2 THEN 'local_model_request_failed' WHEN 3 THEN 'deepseek_request_failed' WHEN 4 THEN 'deepseek_request_failed' WHEN 5 THEN 'blank_model_output' WHEN 6 THEN 'blank_model_output' WHEN 7 THEN 'deepseek_json_parse_failed' WHEN 8 THEN 'deepseek_json_parse_failed' WHEN 9 THEN 'deepseek_json_parse_failed' END
    ELSE CASE k WHEN 2 THEN 'single_model_request_failed' WHEN 3 THEN 'single_model_request_failed' WHEN 4 THEN 'single_model_request_failed' WHEN 5 THEN 'blank_model_output' WHEN 6 THEN 'single_model_json_parse_failed' WHEN 7 THEN 'single_model_schema_invalid' WHEN 8 THEN 'single_model_schema_invalid' WHEN 9 THEN 'single_model_schema_invalid' END END AS error_type, k FROM d)
SELECT doc_id, error_type, CASE WHEN error_type LIKE '%request_failed' THEN CASE k WHEN 2 THEN 'request_failed' WHEN 3 THEN 'service_unreachable' WHEN 4 THEN 'context_length_exceeded' END END AS error_detail,
  CASE WHEN error_type IS NULL AND NOT bare THEN (doc_id % 5 + 1) || '/' || (doc_id % 3) || '/method/' || CASE WHEN doc_id % 2 = 0 THEN 'explicit_citation' ELSE 'weak_body_mention' END || '/1.0|' || (doc_id % 5 + 1) || '/7/other/explicit_citation/0.6' ELSE '' END AS findings FROM r""")
def model_analysis(spark, sf_dir):
    from ..operators import semantics
    from . import stubs

    d = F.col("doc_id")
    mode = F.when(d % 35 == 3, "odd").when(d % 5 == 4, " Legacy_Two_Stage").otherwise(F.when(d % 2 == 0, "single_model").otherwise(""))
    scope = F.when(d % 2 == 0, "fulltext_direct").otherwise("candidate_spans")
    prompt = F.concat(F.lit("paper "), d.cast("string"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 200))
    rows = A.table(spark, sf_dir, "documents").select("doc_id", mode.alias("mode"), scope.alias("scope"), F.when(d % 11 != 5, prompt).alias("prompt"))
    found = checkpointed(semantics.by_mode(rows, stubs.answering, stubs.writing, stubs.answering))  # used twice
    said = F.concat_ws("/", F.col("page").cast("string"), F.col("span_index").cast("string"), "aspect", "mention_type", F.col("confidence").cast("string"))
    listed = semantics.typed_findings(found).select("doc_id", F.struct("ord", said.alias("s")).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    listed = listed.select("doc_id", F.array_join(F.transform("xs", lambda x: x["s"]), "|").alias("findings"))
    return found.select("doc_id", "error_type", "error_detail").join(listed, "doc_id", "left").fillna("", ["findings"])


@query(TASKS + "SELECT session, event_id AS ord, state, accepted FROM st")
def task_stream(spark, sf_dir):
    """The events in micro-batches through keyed state; the same rows as in one batch."""
    found = T.replayed(requests(spark, sf_dir), scratch(spark))
    return found.where("ord IS NOT NULL").select("session", "ord", "state", "accepted")


@query("""WITH c AS (SELECT event_id, user_id, (['discover', 'extend', 'refresh', 'download', 'analyze', 'odd'])[CAST(event_id % 6 AS INTEGER) + 1] AS command FROM events)
SELECT CAST(user_id AS VARCHAR) AS session, event_id AS ord, CASE command WHEN 'extend' THEN 'discover' ELSE command END AS task_type,
  CASE command WHEN 'discover' THEN '正在发现引用论文…' WHEN 'extend' THEN '正在继续发现引用论文到 ' || greatest(event_id % 40, event_id % 17) || ' 篇…' WHEN 'refresh' THEN '正在刷新下载探测状态…' WHEN 'download' THEN '正在下载所选论文…' ELSE '正在进行全文分析…' END AS message,
  CASE WHEN command IN ('refresh', 'download', 'analyze') THEN 'P' || event_id % 9 ELSE '' END AS ids, CASE WHEN command = 'analyze' THEN CASE WHEN event_id % 4 = 0 THEN 8 ELSE 3 END END AS top_k_spans,
  CASE WHEN command = 'analyze' AND event_id % 12 = 4 THEN 'fulltext_direct' ELSE 'candidate_spans' END AS analysis_scope
FROM c WHERE command <> 'odd'""")
def task_starts(spark, sf_dir):
    e = F.col("event_id")
    commands = A.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), A.pick(["discover", "extend", "refresh", "download", "analyze", "odd"], e % 6).alias("command"), F.col("ts").alias("at"), e.alias("ord"),
        F.array(F.concat(F.lit("P"), (e % 9).cast("string"))).alias("ids"), F.when(e % 4 != 0, 3).alias("top_k"), F.when(e % 12 == 4, " Full-Text ").otherwise("spans").alias("scope"), (e % 40).alias("wanted"), (e % 17).alias("held"),
    )
    return T.task_starts(commands).select("session", "ord", "task_type", "message", F.array_join("requested_ids", ",").alias("ids"), "top_k_spans", "analysis_scope")


@query("""WITH s AS (SELECT o_orderkey AS session_id, o_custkey, o_orderkey % 3 AS r FROM orders)
SELECT session_id, CASE r WHEN 0 THEN 'again ' || o_custkey WHEN 1 THEN 'query ' || o_custkey ELSE '' END AS query, CASE r WHEN 0 THEN 'succeeded' ELSE 'idle' END AS task_status, CASE r WHEN 0 THEN 2 WHEN 1 THEN o_custkey % 30 ELSE 0 END::BIGINT AS paper_count, 'candidate_spans' AS analysis_scope, FALSE AS task_active FROM s""")
def session_versions(spark, sf_dir):
    """Sessions of a first version, a third of them replaced by a second one with other fields."""
    orders = A.table(spark, sf_dir, "orders")
    key, who = F.col("o_orderkey").alias("session_id"), F.col("o_custkey")
    store = Z.Snapshots(spark, scratch(spark))
    store.publish(orders.select(key, F.when(F.col("o_orderkey") % 3 != 2, F.concat(F.lit("query "), who.cast("string"))).alias("query"), F.when(F.col("o_orderkey") % 3 == 1, who % 30).alias("paper_count")))
    newer = orders.where("o_orderkey % 3 = 0").select(key, F.concat(F.lit("again "), who.cast("string")).alias("query"), F.lit("succeeded").alias("task_status"), F.lit(2).cast("long").alias("paper_count"))
    store.update(lambda old: Z.replaced(old, newer, "session_id"))
    return Z.with_defaults(store.read()).select("session_id", "query", "task_status", "paper_count", "analysis_scope", "task_active")


_KEY = "coalesce(nullif(corpus_id, ''), nullif(doi, ''), nullif(arxiv_id, ''), nullif(lower(trim(title)), ''))"


@query(f"""WITH {A.PAPERS_SQL}, f AS (SELECT * FROM papers WHERE {_KEY} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY ord % 4, ord) = 1),
g AS (SELECT venue, count(*) AS n, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence IN ('high', 'medium')) AS confident, min(year) AS year_min, max(year) AS year_max FROM f GROUP BY venue)
SELECT *, CASE WHEN n >= 10 OR high >= 2 OR confident >= 4 THEN 'high' WHEN n >= 5 OR confident >= 2 THEN 'medium' ELSE 'low' END AS impact_level FROM g""")
def incremental_views(spark, sf_dir):
    """Papers that come in four batches; the views follow by deltas."""
    papers = A.papers(spark, sf_dir)
    return U.follow([papers.where(F.col("ord") % 4 == k) for k in range(4)], scratch(spark), "venue")
