"""Queries over evidence, traces, reasons, answers, prompts, selections and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as X
from ..operators import contexts as C
from ..operators import findings as M
from ..operators import papers as P
from ..operators import people as E
from ..operators import prompts as R
from ..operators import selection as N
from ..operators import views as V
from . import people_queries as PQ
from . import session_queries as SQ

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _short(c: str, n: int) -> str:
    t = f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
    return f"(CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(left({t}, {n - 3})) || '...' END)"


# spans of labelled documents, findings with what they say, fallback contexts, and which results exist
_PARTS = SQ.NORMAL.replace("WITH ", f"WITH {A.SPANS_SQL}, ", 1) + ", " + SQ._DOCS + f""", said AS (SELECT *, CASE WHEN ord % 2 = 0 THEN 'uses ' || aspect ELSE '' END AS function, CASE WHEN ord % 3 = 1 THEN 'because' ELSE '' END AS reason FROM normal),
docs2 AS (SELECT doc_id, status, doc_id % 5 <> 0 AS has_candidates, doc_id % 7 <> 0 AS has_analysis FROM statuses),
ctx AS (SELECT doc_id, ord, 'context ' || ord || ' of ' || doc_id AS text, (['high', 'low'])[CAST(ord % 2 AS INTEGER) + 1] AS confidence FROM findings WHERE ord > 0) """


def said(spark, sf_dir):
    return SQ.normal(spark, sf_dir).withColumns({"function": F.when(F.col("ord") % 2 == 0, F.concat(F.lit("uses "), "aspect")).otherwise(""), "reason": F.when(F.col("ord") % 3 == 1, "because").otherwise("")})


def documents(spark, sf_dir):
    return SQ.statuses(spark, sf_dir).withColumns({"has_candidates": F.col("doc_id") % 5 != 0, "has_analysis": F.col("doc_id") % 7 != 0})


def fallback(spark, sf_dir):
    rows = A.findings(spark, sf_dir).where("ord > 0")
    return rows.select("doc_id", "ord", F.format_string("context %s of %s", F.col("ord").cast("string"), F.col("doc_id").cast("string")).alias("text"), A.pick(["high", "low"], F.col("ord") % 2).alias("confidence"))


_INDEX = _PARTS + f""", f1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, span_index ORDER BY ord) AS at FROM said),
top AS (SELECT s.*, f.aspect, f.mention_type, f.confidence, f.function, f.reason, coalesce(nullif(s.text, ''), f.citation_text, '') AS focus FROM spans s LEFT JOIN f1 f ON f.doc_id = s.doc_id AND f.page = s.page AND f.span_index = s.span_index AND f.at = 1 WHERE s.place = 1),
idx AS (SELECT d.doc_id, d.status, has_candidates AND has_analysis AND d.status IN ('fulltext_analyzed', 'mention_only', 'reference_only', 'fulltext_no_finding') AS qa_ready,
  coalesce(sc.n, 0) AS candidate_span_count, coalesce(fc.n, 0) AS findings_count, t.page, t.span_index, CAST(length(regexp_replace(coalesce(focus, ''), '\\s+', '', 'g')) AS INTEGER) AS char_length,
  CAST(CASE WHEN trim(coalesce(focus, '')) = '' THEN 0 ELSE greatest(1, len(list_filter(regexp_split_to_array(focus, '[。！？!?；;]+'), lambda p: trim(p) <> ''))) END AS INTEGER) AS sentence_count,
  {_short('focus', 220)} AS excerpt, t.match_type, t.score, t.aspect, t.mention_type, t.confidence, t.function, t.reason, coalesce(cc.c, '') AS fallback_contexts
  FROM docs2 d LEFT JOIN top t USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY 1) sc USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM said GROUP BY 1) fc USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(text, '|' ORDER BY ord) AS c FROM ctx WHERE ord <= 2 GROUP BY 1) cc USING (doc_id)) """


def index(spark, sf_dir):
    return V.evidence_index(documents(spark, sf_dir), A.spans(spark, sf_dir), said(spark, sf_dir), fallback(spark, sf_dir))


@query(_INDEX + "SELECT doc_id, status, qa_ready, candidate_span_count, findings_count, page, span_index, char_length, sentence_count, excerpt, match_type, score, aspect, mention_type, confidence, fallback_contexts FROM idx")
def evidence_index(spark, sf_dir):
    rows = index(spark, sf_dir).drop("has_candidates", "has_analysis", "function", "reason")
    return rows.withColumn("fallback_contexts", F.coalesce(F.array_join("fallback_contexts", "|"), F.lit("")))


@query(_INDEX + "SELECT count(*) AS items, count(*) FILTER (qa_ready) AS qa_ready_count FROM idx")
def evidence_ready_count(spark, sf_dir):
    return index(spark, sf_dir).agg(F.count("*").alias("items"), F.count_if("qa_ready").alias("qa_ready_count"))


@query(_PARTS + f""", f AS (SELECT doc_id, count(*) AS n, string_agg(page || '/' || span_index || '/' || aspect || '/' || mention_type || '/' || function || '/' || reason || '/' || {_short('citation_text', 700)}, chr(10) ORDER BY ord) AS x FROM said GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n, string_agg(page || '/' || span_index || '/' || score || '/' || match_type || '/' || coalesce(citation_index, '') || '/' || array_to_string(evidence, ',') || '/' || {_short('text', 700)} || '/' || {_short('window_text', 700)}, chr(10) ORDER BY place) AS x FROM spans GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n, string_agg(text || '/' || confidence, chr(10) ORDER BY ord) AS x FROM ctx GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'fulltext_direct' WHEN d.doc_id % 4 = 1 THEN 'debugged' ELSE 'candidate_spans' END AS analysis_scope, coalesce(f.n, 0) AS finding_count, coalesce(s.n, 0) AS candidate_span_count, coalesce(c.n, 0) AS fallback_context_count,
  coalesce(f.x, '') AS findings, coalesce(s.x, '') AS candidate_spans, coalesce(c.x, '') AS fallback_contexts,
  array_to_string(list_filter(['analysis_mode=single_model', CASE WHEN d.doc_id % 4 IN (0, 1) THEN 'analysis_scope=debugged' END, CASE WHEN d.doc_id % 6 = 0 THEN 'fulltext_char_count=' || d.doc_id * 10 END, CASE WHEN d.doc_id % 2 = 0 THEN 'fulltext_page_count=9' WHEN d.doc_id % 3 = 0 THEN 'fulltext_page_count=' || d.doc_id ELSE 'fulltext_page_count=4' END], lambda x: x IS NOT NULL), ';') AS debug
FROM docs2 d LEFT JOIN f USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)""")
def citation_trace(spark, sf_dir):
    d = F.col("doc_id")
    debug = F.map_from_arrays(
        F.array(*map(F.lit, ["analysis_mode", "analysis_scope", "llm_model", "secret", "fulltext_page_count"])),
        F.array(F.lit("single_model"), F.when(d % 4 <= 1, "debugged"), F.lit(""), F.lit("hidden"), F.when(d % 2 == 0, "9").cast("string")),
    )
    docs = documents(spark, sf_dir).withColumns({
        "scope": F.when(d % 4 == 0, "fulltext_direct").otherwise(""), "payload_scope": F.lit(None).cast("string"), "debug": debug,
        "payload_pages": F.when(d % 3 == 0, d), "payload_chars": F.when(d % 6 == 0, d * 10), "fulltext_pages": F.lit(4).cast("long"),
    })
    got = V.citation_trace(docs, A.spans(spark, sf_dir), said(spark, sf_dir), fallback(spark, sf_dir))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws("/", *f(x))), "\n"), F.lit("")).alias(c)
    return got.select(
        "doc_id", "analysis_scope", "finding_count", "candidate_span_count", "fallback_context_count",
        lines("findings", lambda x: [text(x[c]) for c in ("page", "span_index", "aspect", "mention_type", "function", "reason", "citation_text")]),
        lines("candidate_spans", lambda x: [text(x["page"]), text(x["span_index"]), text(x["score"]), x["match_type"], text(x["citation_index"]), F.array_join(x["evidence"], ","), x["text"], x["window_text"]]),
        lines("fallback_contexts", lambda x: [x["text"], x["confidence"]]),
        F.array_join(F.transform(F.array_sort(F.map_entries("debug")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("debug"),
    )


_STATUS = ["context_only", "fulltext_extract_failed", "analysis_failed", "write_output_failed", "fulltext_analyzed", ""]
_ERR = ["", "HTTP 429", "boom", "Rate Limit hit"]
_TYPES = ["", "downloaded_non_pdf", "fake_pdf_html_interstitial", "odd"]
_KIND = ["pdf_parse_failed", "likely_scanned_pdf", "blank_model_output", "single_model_schema_invalid", "odd", "", "empty_text_pdf"]


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(values: dict[str, str], otherwise: str, column: str = "kind") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {otherwise} END"


_PICKED = f"""p AS (SELECT doc_id, ({A._quoted(_STATUS)})[CAST(doc_id % 6 AS INTEGER) + 1] AS status, list_distinct(list_filter([({A._quoted(_ERR)})[CAST(doc_id // 6 % 4 AS INTEGER) + 1], ({A._quoted(_ERR)})[CAST(doc_id // 24 % 4 AS INTEGER) + 1]], lambda x: x <> '')) AS unordered,
  ({A._quoted(_ERR)})[CAST(doc_id // 6 % 4 AS INTEGER) + 1] AS e1, ({A._quoted(_ERR)})[CAST(doc_id // 24 % 4 AS INTEGER) + 1] AS e2, ({A._quoted(_TYPES)})[CAST(doc_id // 6 % 4 AS INTEGER) + 1] AS t1, ({A._quoted(_TYPES)})[CAST(doc_id // 12 % 4 AS INTEGER) + 1] AS t2,
  ({A._quoted(_KIND)})[CAST(doc_id // 6 % 7 AS INTEGER) + 1] AS kind, CASE WHEN doc_id % 5 = 0 THEN 'it broke' ELSE '' END AS analysis_error, CASE WHEN doc_id % 10 = 0 THEN 'candidate_span_failed' ELSE '' END AS stage, CASE WHEN doc_id % 4 = 0 THEN 'only contexts' ELSE '' END AS fallback FROM documents)"""


@query(f"""WITH {_PICKED}, q AS (SELECT *, list_filter(CASE WHEN e1 = e2 THEN [e1] ELSE [e1, e2] END, lambda x: x <> '') AS es, list_filter(CASE WHEN t1 = t2 THEN [t1] ELSE [t1, t2] END, lambda x: x IN ('downloaded_non_pdf', 'fake_pdf_html_interstitial')) AS ts,
  contains(e1 || e2, '429') OR contains(lower(e1 || '|' || e2), 'rate limit') AS limited FROM p WHERE status <> ''),
r AS (SELECT doc_id, status, CASE status
  WHEN 'context_only' THEN list_concat(list_concat({A._quoted(V.CONTEXT_ONLY[0])}, flatten(list_transform(ts, lambda t: CASE t WHEN 'downloaded_non_pdf' THEN {A._quoted(V.DOWNLOAD_FAILURES['downloaded_non_pdf'][0])} ELSE {A._quoted(V.DOWNLOAD_FAILURES['fake_pdf_html_interstitial'][0])} END))), CASE WHEN limited THEN {A._quoted(V.RATE_LIMIT[0])} ELSE [] END)
  WHEN 'fulltext_extract_failed' THEN {_case({k: A._quoted(t) for k, (t, _) in V.EXTRACT_FAILURES.items()}, A._quoted(V.EXTRACT_OTHER[0]))}
  WHEN 'analysis_failed' THEN list_concat(['{V.ANALYSIS_TAG}'], CASE WHEN kind IN ('blank_model_output', 'single_model_schema_invalid') THEN [kind] ELSE [] END)
  WHEN 'write_output_failed' THEN {A._quoted(V.WRITE_FAILURE[0])} ELSE [] END AS tags,
  CASE status WHEN 'context_only' THEN list_concat(list_concat([{_quote(V.CONTEXT_ONLY[1])}], list_transform(ts, lambda t: CASE t WHEN 'downloaded_non_pdf' THEN {_quote(V.DOWNLOAD_FAILURES['downloaded_non_pdf'][1])} ELSE {_quote(V.DOWNLOAD_FAILURES['fake_pdf_html_interstitial'][1])} END)), list_concat(CASE WHEN limited THEN [{_quote(V.RATE_LIMIT[1])}] ELSE [] END, CASE WHEN fallback <> '' THEN [fallback] ELSE [] END))
  WHEN 'fulltext_extract_failed' THEN [{_case({k: _quote(d) for k, (_, d) in V.EXTRACT_FAILURES.items()}, _quote(V.EXTRACT_OTHER[1]))}]
  WHEN 'analysis_failed' THEN [{_case({k: _quote(d) for k, d in V.ANALYSIS_FAILURES.items()}, _quote(V.ANALYSIS_OTHER))}]
  WHEN 'write_output_failed' THEN [{_quote(V.WRITE_FAILURE[1])}] ELSE [] END AS details, stage, list_concat(es, CASE WHEN analysis_error <> '' THEN [analysis_error] ELSE [] END) AS errors FROM q),
t AS (SELECT *, CASE WHEN stage <> '' AND NOT list_contains(tags, stage) THEN list_append(tags, stage) ELSE tags END AS all_tags FROM r)
SELECT doc_id, status, array_to_string(all_tags, '|') AS tags, array_to_string(details, '；') AS message, array_to_string(errors, '|') AS errors FROM t WHERE len(all_tags) > 0 OR len(details) > 0 OR len(errors) > 0""")
def analysis_reason(spark, sf_dir):
    d = F.col("doc_id")
    step = lambda n: F.floor(d / n)
    papers = A.table(spark, sf_dir, "documents").select(
        "doc_id", A.pick(_STATUS, d % 6).alias("status"), F.array(A.pick(_ERR, step(6) % 4), A.pick(_ERR, step(24) % 4)).alias("errors"), F.array(A.pick(_TYPES, step(6) % 4), A.pick(_TYPES, step(12) % 4)).alias("error_types"),
        A.pick(_KIND, step(6) % 7).alias("analysis_error_type"), F.when(d % 5 == 0, "it broke").otherwise("").alias("analysis_error"), F.when(d % 10 == 0, "candidate_span_failed").otherwise("").alias("analysis_stage"), F.when(d % 4 == 0, "only contexts").otherwise("").alias("fallback_message"),
    )
    return V.analysis_reason(papers).select("doc_id", "status", F.array_join("tags", "|").alias("tags"), "message", F.array_join("errors", "|").alias("errors"))


@query(f"""WITH {_PICKED}, e AS (SELECT p.*, CASE WHEN doc_id % 5 < 2 THEN left(split_part(coalesce(text, ''), chr(10), 1), 80) ELSE '' END AS said FROM p JOIN documents USING (doc_id))
SELECT doc_id, {_case({k: _quote(v) for k, v in V.NOTES.items()}, _quote(V.NOTE_OTHER))} || CASE WHEN said <> '' THEN ' 详情：' || said ELSE '' END AS note FROM e""")
def failure_notes(spark, sf_dir):
    """Notes whose details are first lines of texts."""
    d = F.col("doc_id")
    line = F.substring(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1), 1, 80)
    note = V.failure_note(A.pick(_KIND, F.floor(d / 6) % 7), F.when(d % 5 < 2, line).otherwise(""))
    return A.table(spark, sf_dir, "documents").select("doc_id", note.alias("note"))


@query(_PARTS + """, bare AS (SELECT * FROM spans WHERE place = 1 AND match_type LIKE 'citation_index%' AND doc_id NOT IN (SELECT doc_id FROM normal WHERE keep))
SELECT doc_id, CAST(0 AS INTEGER) AS ord, page, span_index, FALSE AS keep, 'background' AS aspect, 'neutral' AS stance, CAST(0.35 AS DOUBLE) AS confidence, CASE WHEN match_type = 'citation_index_grouped' THEN 'grouped_literature_mention' ELSE 'weak_body_mention' END AS mention_type, left(text, 1200) AS citation_text FROM bare""")
def weak_findings(spark, sf_dir):
    return M.weak_findings(A.spans(spark, sf_dir), SQ.normal(spark, sf_dir).where("keep"))


_QUESTIONS = ["这段有多长", "给我原文", "说说看", "多少字 具体内容"]


@query(_INDEX + f""", q AS (SELECT idx.*, 'Paper ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'X' || doc_id ELSE printf('P%03d', doc_id) END AS id, ({A._quoted(_QUESTIONS)})[CAST(doc_id % 4 AS INTEGER) + 1] AS question FROM idx)
SELECT doc_id, CASE WHEN qa_ready THEN 'answered' ELSE 'needs_full_analysis' END AS answer_status, CASE WHEN qa_ready THEN
  title || ' 在当前全文分析里，最主要的引用证据位于第 ' || coalesce(nullif(page, 0)::VARCHAR, '-') || ' 页、第 ' || coalesce(nullif(span_index, 0)::VARCHAR, '-') || ' 个候选段落。' || chr(10) || '这段核心引用片段约 ' || char_length || ' 个非空白字符，约 ' || sentence_count || ' 句。' || chr(10) ||
  CASE WHEN coalesce(nullif(function, ''), nullif(reason, '')) IS NOT NULL THEN '当前判断：' || coalesce(nullif(function, ''), nullif(reason, '')) || '（置信度 ' || coalesce(confidence::VARCHAR, '-') || '）。' || chr(10) ELSE '' END ||
  CASE WHEN doc_id % 4 = 0 THEN '可复核摘录：' ELSE '证据摘录：' END || coalesce(nullif(excerpt, ''), '暂无可展示摘录。')
  ELSE title || ' 目前还没有可直接问答的全文证据。' || CASE WHEN doc_id % 3 <> 0 AND doc_id > 0 THEN '你可以先说“分析第' || doc_id || '篇”或“全面分析这篇论文的影响力”。' ELSE '你可以先说“分析这篇论文”或“全面分析这篇论文的影响力”。' END END AS answer FROM q""")
def paper_answer(spark, sf_dir):
    d = F.col("doc_id")
    asked = SQ.statuses(spark, sf_dir).select("doc_id", F.concat(F.lit("Paper "), d.cast("string")).alias("title"), F.when(d % 3 == 0, F.concat(F.lit("X"), d.cast("string"))).otherwise(F.format_string("P%03d", d)).alias("id"), A.pick(_QUESTIONS, d % 4).alias("question"))
    return V.paper_answers(asked, index(spark, sf_dir))


_LABELS = [("fulltext_analyzed", "A"), ("mention_only", "B"), ("fulltext_no_finding", "C")]


@query(SQ.NORMAL + ", " + SQ._DOCS + """, e AS (SELECT doc_id, status, CASE WHEN doc_id % 2 = 0 THEN 'note' WHEN doc_id % 3 = 0 THEN 'said' ELSE NULL END AS status_message FROM statuses)
SELECT CAST(CASE status WHEN 'fulltext_analyzed' THEN 0 WHEN 'mention_only' THEN 1 WHEN 'fulltext_no_finding' THEN 2 ELSE 3 END AS INTEGER) AS label_ord, status, CASE status WHEN 'fulltext_analyzed' THEN 'A' WHEN 'mention_only' THEN 'B' WHEN 'fulltext_no_finding' THEN 'C' ELSE status END AS status_label,
CAST(row_number() OVER (PARTITION BY status ORDER BY doc_id) AS INTEGER) AS place, doc_id, 'T' || doc_id AS title, status_message FROM e""")
def status_entries(spark, sf_dir):
    d = F.col("doc_id")
    rows = SQ.statuses(spark, sf_dir).select("doc_id", d.alias("ord"), F.concat(F.lit("T"), d.cast("string")).alias("title"), "status", F.when(d % 2 == 0, "note").otherwise("").alias("note"), F.when(d % 3 == 0, "said").alias("analysis_message"), F.lit(None).cast("string").alias("fallback_message"))
    return V.report_entries(rows, _LABELS)


@query(f"""WITH {A.PAPERS_SQL}, c AS (SELECT p.ord, p.year AS session, p.title, p.confidence, {_short("split_part(coalesce(d.text, ''), chr(10), 2)", 180)} AS excerpt FROM papers p JOIN documents d ON d.doc_id = p.ord WHERE p.year IS NOT NULL)
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY ord) AS INTEGER) AS place, ord, title, confidence, excerpt FROM c WHERE excerpt <> '' QUALIFY place <= 3""")
def context_highlights(spark, sf_dir):
    second = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.coalesce(F.try_element_at(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(2)), F.lit("")).alias("context"))
    return V.highlights(A.papers(spark, sf_dir).where("year IS NOT NULL").withColumnRenamed("year", "session").join(second, "ord"), "session")


@query(f"""WITH {A.PAPERS_SQL}, c AS (SELECT p.ord % 40 AS session, p.ord, 'P' || p.ord AS id, p.title, p.confidence, {_short("split_part(coalesce(d.text, ''), chr(10), 2)", 180)} AS excerpt FROM papers p JOIN documents d ON d.doc_id = p.ord WHERE p.ord % 40 < 35),
h AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS place FROM c WHERE excerpt <> '' QUALIFY place <= 3),
b AS (SELECT session, string_agg(excerpt, chr(10) ORDER BY place) AS highlights, string_agg(id || ' ' || title, '、' ORDER BY place) FILTER (place <= 2) AS top FROM h GROUP BY 1),
n AS (SELECT session, count(*) AS n, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence IN ('high', 'medium')) AS confident FROM c GROUP BY 1),
l AS (SELECT *, CASE WHEN n >= 10 OR high >= 2 OR confident >= 4 THEN 'high' WHEN n >= 5 OR confident >= 2 THEN 'medium' ELSE 'low' END AS impact_level FROM n),
s AS (SELECT DISTINCT doc_id % 40 AS session FROM documents)
SELECT s.session, CASE WHEN n IS NULL THEN 'empty' ELSE 'ready' END AS status, impact_level, coalesce(highlights, '') AS highlights, CASE WHEN n IS NULL THEN '当前会话中还没有发现引用论文。' ELSE
  CASE WHEN s.session % 3 <> 0 THEN 'Semantic Scholar 当前记录总引用数约 ' || s.session * 10 || ' 篇，本会话先展示其中 ' || n || ' 篇候选论文。' ELSE '当前会话先展示 ' || n || ' 篇引用论文候选。' END || ' 其中 ' || confident || ' 篇在 citation contexts 中呈现出中高置信度引用信号。' ||
  CASE WHEN top IS NOT NULL THEN ' 从现有上下文看，较值得优先关注的引用论文包括 ' || top || '。' ELSE '' END || ' 基于现有 citation contexts 的初步判断，这篇目标论文的外部影响力处于' || CASE impact_level WHEN 'high' THEN '较高' WHEN 'medium' THEN '中等' ELSE '初步' END || '水平；如果需要回答“具体怎么引用、引用了多长段落”，还需要继续做全文级全面分析。' END AS summary
FROM s LEFT JOIN l USING (session) LEFT JOIN b USING (session)""")
def quick_analysis(spark, sf_dir):
    """Sessions of forty groups of papers, five of them without any."""
    session = F.col("ord") % 40
    second = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.coalesce(F.try_element_at(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(2)), F.lit("")).alias("context"))
    papers = A.papers(spark, sf_dir).withColumn("session", session).where("session < 35").join(second, "ord").withColumn("id", F.concat(F.lit("P"), F.col("ord").cast("string")))
    sessions = second.select(session.alias("session")).distinct().withColumn("total", F.when(F.col("session") % 3 != 0, F.col("session") * 10))
    return V.quick_analysis(sessions, papers).withColumn("highlights", F.array_join("highlights", "\n"))


_PERSON = PQ.SQL["person_group_stats"]
_METHOD = SQ.SQL["method_group_stats"]


@query(f"SELECT 'person' AS section, group_ord, tag_type AS name, n FROM ({_PERSON}) UNION ALL SELECT 'citation_methods', group_ord, method, n FROM ({_METHOD})")
def impact_statistics(spark, sf_dir):
    return V.impact_statistics(PQ.QUERIES["person_group_stats"](spark, sf_dir), SQ.QUERIES["method_group_stats"](spark, sf_dir))


@query(SQ.SUMMARY + f""", d AS (SELECT doc_id, {SQ._DOWN} AS s FROM summary), few AS (SELECT doc_id FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT 'all' AS view, count(*) AS n, min(doc_id) AS first FROM d WHERE s <> 'local_available' UNION ALL SELECT 'forced', count(*), min(doc_id) FROM d
UNION ALL SELECT 'chosen', count(*), min(doc_id) FROM d WHERE s <> 'local_available' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def refresh_targets(spark, sf_dir):
    d = SQ.detail(spark, sf_dir).select("doc_id", "download_status")
    few = A.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    one = lambda name, df: df.agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).select(F.lit(name).alias("view"), "n", "first")
    return one("all", V.to_refresh(d, few.limit(0))).unionByName(one("forced", V.to_refresh(d, force=True))).unionByName(one("chosen", V.to_refresh(d, few)))


_SCOPES = ["", "Candidate", "full-text", "DIRECT ", "fulltext_direct", "spans", "odd", " fulltext"]


#: First words of texts, some with a known name of a scope or mode in front, in capitals, or behind blanks.
_FIRST_SQL = "trim(split_part(coalesce(text, ''), ' ', 1))"


def _first(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.trim(F.element_at(F.split(F.coalesce("text", F.lit("")), " "), 1)).alias("word"))


@query(f"""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 9 < 8 THEN ({A._quoted(_SCOPES)})[CAST(doc_id % 9 AS INTEGER) + 1] ELSE '' END || CASE WHEN doc_id % 4 = 3 THEN {_FIRST_SQL} ELSE '' END AS s FROM documents)
SELECT doc_id, s AS value, CASE WHEN replace(lower(trim(s)), '-', '_') IN ('fulltext', 'full_text', 'direct', 'fulltext_direct') THEN 'fulltext_direct' ELSE 'candidate_spans' END AS scope FROM v""")
def scope_alias(spark, sf_dir):
    d = F.col("doc_id")
    value = F.concat(F.when(d % 9 < 8, A.pick(_SCOPES, F.least(d % 9, F.lit(7)))).otherwise(""), F.when(d % 4 == 3, F.col("word")).otherwise(""))
    return _first(spark, sf_dir).select("doc_id", value.alias("value")).select("*", V.analysis_scope(F.col("value")).alias("scope"))


_PAGE_SQL = """pg AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS ord, (['3', 'x', NULL, ' 8 ', '2.5'])[CAST((conv_id + turn) % 5 AS INTEGER) + 1] AS page_text, CASE WHEN turn % 5 = 1 THEN '  ' ELSE text END AS text FROM conversations),
np AS (SELECT doc_id, ord, CASE (doc_id + ord - 1) % 5 WHEN 0 THEN 3 WHEN 3 THEN 8 ELSE ord END AS page, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM pg WHERE trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) <> '')"""


def _pages(spark, sf_dir):
    texts = F.array(*(F.lit(v).cast("string") for v in ("3", "x", None, " 8 ", "2.5")))
    rows = A.table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("ord"), F.element_at(texts, ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int")).alias("page_text"), F.when(F.col("turn") % 5 == 1, "  ").otherwise(F.col("text")).alias("text"))


@query(f"WITH {_PAGE_SQL} SELECT doc_id, ord, CAST(page AS INTEGER) AS page, text FROM np")
def fulltext_pages(spark, sf_dir):
    return R.numbered_pages(_pages(spark, sf_dir))


@query(f"""WITH {_PAGE_SQL}, b AS (SELECT doc_id, ord, '[Page ' || page || ']' || chr(10) || text || chr(10) AS block FROM np),
f AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT doc_id, string_agg(left(block, CAST(700 - before AS INTEGER)), chr(10) || chr(10) ORDER BY ord) AS blocks FROM f WHERE before < 700 GROUP BY doc_id""")
def fulltext_prompt(spark, sf_dir):
    return R.fulltext_blocks(_pages(spark, sf_dir), 700)


@query(f"""WITH {A.SPANS_SQL}, b AS (SELECT doc_id, place, '[Page ' || page || ' | Span ' || span_index || ' | score=' || score || ' | type=' || match_type || ' | evidence=[' || array_to_string(list_transform(evidence, lambda x: '''' || x || ''''), ', ') || '] | hits=[' || array_to_string(list_transform(keyword_hits, lambda x: '''' || x || ''''), ', ') || ']]' || chr(10)
  || CASE WHEN trim(window_text) <> '' THEN '局部上下文如下：' || chr(10) || left(trim(window_text), 1800) ELSE left(text, 1200) END AS block FROM spans WHERE place <= 4),
f AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
j AS (SELECT doc_id, string_agg(left(block, CAST(9000 - before AS INTEGER)), chr(10) || chr(10) ORDER BY place) AS blocks FROM f WHERE before < 9000 GROUP BY 1)
SELECT doc_id, '目标论文标题：Quantum Widgets' || chr(10) || '目标论文年份：2001' || chr(10) || '目标论文别名/缩写：QW, widgets' || chr(10) || '引用论文标题：Paper ' || doc_id || chr(10) || chr(10) || '下面是从引用论文全文中筛出的候选段落：' || chr(10) || blocks || chr(10) || chr(10) || '请根据这些段落判断是否真正引用了目标论文，并按指定格式输出自然语言分析。' || chr(10) AS prompt FROM j""")
def analysis_prompt(spark, sf_dir):
    papers = A.table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("title", F.concat(F.lit("Paper "), F.col("doc_id").cast("string")))
    return R.span_prompts(papers, A.spans(spark, sf_dir), "Quantum Widgets", "2001", ["QW", "widgets"])


_MODES = ["", "single_model", " Legacy_Two_Stage ", "odd"]


@query(f"""WITH v AS (SELECT doc_id, ({A._quoted(_MODES)})[CAST(doc_id % 4 AS INTEGER) + 1] || CASE WHEN doc_id % 5 = 4 THEN {_FIRST_SQL} ELSE '' END AS m FROM documents)
SELECT doc_id, m AS value, CASE lower(trim(m)) WHEN '' THEN 'single_model' WHEN 'single_model' THEN 'single_model' WHEN 'legacy_two_stage' THEN 'legacy_two_stage' END AS mode FROM v""")
def analysis_modes(spark, sf_dir):
    value = F.concat(A.pick(_MODES, F.col("doc_id") % 4), F.when(F.col("doc_id") % 5 == 4, F.col("word")).otherwise(""))
    return _first(spark, sf_dir).select("doc_id", value.alias("value")).select("*", R.mode_of(F.col("value")).alias("mode"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'answer ' || turn ELSE '' END AS content, CASE WHEN (conv_id + turn) % 2 = 0 THEN 'thought ' || conv_id ELSE '' END AS thought FROM conversations)
SELECT conv_id, turn, CASE WHEN content <> '' THEN content ELSE thought END AS analysis_text, CASE WHEN content <> '' THEN 'content' WHEN thought <> '' THEN 'reasoning_content' ELSE 'blank' END AS output_source, CASE WHEN turn % 4 = 0 THEN NULL ELSE 'stop' END AS finish_reason, CAST(length(content) AS INTEGER) AS content_len, CAST(length(thought) AS INTEGER) AS reasoning_len,
  CASE WHEN content <> '' THEN 'content' WHEN thought <> '' THEN 'reasoning_content_ignored' ELSE 'blank' END AS strict_source FROM c""")
def chat_output(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    content = F.when((c + t) % 3 == 0, F.concat(F.lit(" answer "), t.cast("string"), F.lit(" "))).otherwise("")
    thought = F.when((c + t) % 2 == 0, F.concat(F.lit("thought "), c.cast("string"))).otherwise(" ")
    message = F.struct(content.alias("content"), thought.alias("reasoning_content"))
    response = F.to_json(F.struct(F.array(F.struct(message.alias("message"), F.when(t % 4 != 0, "stop").alias("finish_reason"))).alias("choices")))
    rows = A.table(spark, sf_dir, "conversations").withColumn("response", response)
    strict = R.chat_output(F.col("response"), False)["output_source"]
    return rows.select("conv_id", "turn", *(v.alias(k) for k, v in R.chat_output(F.col("response"), True).items()), strict.alias("strict_source"))


# contexts and people


@query(f"""WITH {A.MARKED_SQL}, {PQ.SCORED_SQL}, c AS (SELECT s.doc_id, s.seq, m.text, s.score, s.doi, s.k, s.p FROM scored s JOIN marked m USING (doc_id, seq)),
b AS (SELECT *, seq = first_value(seq) OVER (PARTITION BY doc_id ORDER BY score DESC, seq) AS best FROM c),
u AS (SELECT *, {{NS}} AS wording FROM b WHERE score >= 2 OR doi OR p > 0 OR k >= 2),
o AS (SELECT doc_id, wording, min(CASE WHEN best THEN 0 ELSE seq + 1 END) AS pos, arg_min(text, CASE WHEN best THEN 0 ELSE seq + 1 END) AS text FROM u WHERE wording <> '' GROUP BY 1, 2)
SELECT doc_id AS ord, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS place, text FROM o QUALIFY place <= 20""".replace("{NS}", "replace(replace(translate(lower(replace(text, '´', '')), '‘’“”–—', '''''\"\"--'), 'ﬁ', 'fi'), 'ﬀ', 'ff')"))
def context_filter(spark, sf_dir):
    rows = PQ.scored(spark, sf_dir).withColumn("title", F.concat(F.lit("Paper "), F.col("doc_id").cast("string")))
    best = C.best_context(rows.withColumnRenamed("seq", "ord"), "doc_id").select("doc_id", F.col("ord").alias("best_seq"))
    contexts = rows.join(best, "doc_id").select("*", F.upper("title").alias("citing_title"), F.col("seq").alias("rank"), (F.col("seq") == F.col("best_seq")).alias("is_best"))
    papers = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit(" Paper "), F.col("doc_id").cast("string")).alias("title"))
    return C.filtered_contexts(papers, contexts)


@query(PQ.CTX_SQL + ", b AS (SELECT doc_id, count(*) AS context_count, arg_max(seq, score * 1000000 - seq) AS ord, max(score) AS score FROM scored GROUP BY 1) SELECT doc_id, context_count, CAST(ord AS INTEGER) AS ord, score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM b ORDER BY score DESC, doc_id LIMIT 20")
def top_citing(spark, sf_dir):
    return C.top_citing(PQ.scored(spark, sf_dir).withColumnRenamed("seq", "ord"), "doc_id")


_NOTES = ["n1", "", "n1；n2", "n2", "x"]


@query(f"""WITH {A.AUTHORS_SQL}, r AS (SELECT paper // 100 AS session, lower(author) AS candidate_id, paper * 3 + author_ord AS ord, paper, affiliation, CASE WHEN paper % 4 = 0 THEN 'https://x/' || paper % 8 ELSE '' END AS source_link, ({A._quoted(_NOTES)})[CAST(paper % 5 AS INTEGER) + 1] AS note FROM authors),
n AS (SELECT session, candidate_id, note, min(ord) AS ord FROM r WHERE note <> '' GROUP BY 1, 2, 3), m AS (SELECT session, candidate_id, list_reduce(list(note ORDER BY ord), lambda a, b: CASE WHEN contains(a, b) THEN a ELSE a || '；' || b END) AS note FROM n GROUP BY 1, 2),
a AS (SELECT session, candidate_id, string_agg(affiliation, '|' ORDER BY ord) AS affiliations FROM (SELECT session, candidate_id, affiliation, min(ord) AS ord FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
l AS (SELECT session, candidate_id, string_agg(source_link, '|' ORDER BY ord) AS links FROM (SELECT session, candidate_id, source_link, min(ord) AS ord FROM r WHERE source_link <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2),
p AS (SELECT session, candidate_id, string_agg(paper::VARCHAR, '|' ORDER BY ord) AS papers FROM (SELECT session, candidate_id, paper, min(ord) AS ord FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT g.session, g.candidate_id, g.n AS evidence_count, papers, affiliations, coalesce(links, '') AS source_links, coalesce(note, '') AS note, CASE WHEN length(g.candidate_id) % 3 = 0 THEN 'confirmed' ELSE 'pending' END AS status, CASE WHEN length(g.candidate_id) % 3 = 0 THEN 'seen' ELSE '' END AS review_note
FROM (SELECT session, candidate_id, count(*) AS n FROM r GROUP BY 1, 2) g JOIN p USING (session, candidate_id) JOIN a USING (session, candidate_id) LEFT JOIN l USING (session, candidate_id) LEFT JOIN m USING (session, candidate_id)""")
def candidate_merge(spark, sf_dir):
    p = F.col("paper")
    rows = A.authors(spark, sf_dir).select(
        F.floor(p / 100).alias("session"), F.lower("author").alias("candidate_id"), (p * 3 + F.col("author_ord")).alias("ord"), "paper", "affiliation",
        F.when(p % 4 == 0, F.concat(F.lit("https://x/"), (p % 8).cast("string"))).otherwise("").alias("source_link"), A.pick(_NOTES, p % 5).alias("note"), F.lit("").alias("status"),
    )
    prior = rows.select("session", "candidate_id").distinct().where(F.length("candidate_id") % 3 == 0).select("*", F.lit("confirmed").alias("status"), F.lit("seen").alias("review_note"))
    got = E.merge_candidates(rows, prior)
    join = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), "|"), F.lit("")).alias(c)
    return got.select("session", "candidate_id", "evidence_count", join("papers"), join("affiliations"), join("source_links"), "note", "status", "review_note")


@query(f"""WITH {A.PAPERS_SQL}, {A.AUTHORS_SQL}, f AS (SELECT ord, title, year, venue FROM papers WHERE year IS NOT NULL ORDER BY year, ord LIMIT 1)
SELECT f.*, (SELECT string_agg(author, ', ' ORDER BY author_ord) FROM authors WHERE paper = f.ord AND author_ord < 2) || ' 等' AS authors FROM f""")
def first_citing_authors(spark, sf_dir):
    return P.first_by_authors(A.papers(spark, sf_dir), A.authors(spark, sf_dir), 2)


# messages


_TOLD = "['P001', 'P999', 'P003']"


@query(SQ.SELECT_SQL + f""", m0 AS (SELECT conv_id * 100 + turn AS message, text, (conv_id + turn) % 7 AS how FROM conversations WHERE role = 'user'), papers0 AS (SELECT printf('P%03d', item_id) AS id, item_id AS ord FROM benchmark),
told AS (SELECT message, (SELECT string_agg(id, ',' ORDER BY id) FROM papers0 WHERE id IN ('P001', 'P003', 'P999')) AS ids FROM m0 WHERE how = 0), counted AS (SELECT message, (SELECT string_agg(id, ',' ORDER BY ord) FROM (SELECT * FROM papers0 ORDER BY ord LIMIT 2)) AS ids FROM m0 WHERE how = 1),
fs AS (SELECT s.message, printf('P%03d', s.id) AS id, s.score FROM s JOIN m0 USING (message) WHERE s.score >= 24 AND how > 1),
fr AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY score DESC, id) AS place FROM fs),
fj AS (SELECT message, max(id) FILTER (place = 1) AS best, max(score) FILTER (place = 1) AS b, max(score) FILTER (place = 2) AS s2, string_agg(id, ',' ORDER BY place) AS every, string_agg(id, ',' ORDER BY place) FILTER (place <= 3) AS three FROM fr GROUP BY 1),
lo0 AS (SELECT m0.message, printf('P%03d', k.id) AS id, len(list_intersect(list_filter(w.words, lambda x: length(x) >= 4), list_distinct(list_filter(string_split(k.n, ' '), lambda x: length(x) >= 4)))) AS score FROM m0 JOIN w USING (message) CROSS JOIN k WHERE how > 1 AND m0.message NOT IN (SELECT message FROM fs)),
lo AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY score DESC, id) AS place FROM lo0 WHERE score > 0), lj AS (SELECT message, string_agg(id, ',' ORDER BY place) FILTER (place <= 3) AS three, count(*) AS n FROM lo GROUP BY 1)
SELECT message, CASE WHEN ids IS NULL THEN 'no_match' ELSE 'ok' END AS status, coalesce(ids, '') AS ids, '' AS matches FROM told UNION ALL SELECT message, CASE WHEN ids IS NULL THEN 'no_match' ELSE 'ok' END, coalesce(ids, ''), '' FROM counted
UNION ALL SELECT message, CASE WHEN NOT regexp_matches(m0.text, '[、,/，]|以及|和|及|还有') AND coalesce(s2 >= greatest(24, b - 10), FALSE) THEN 'ambiguous' ELSE 'ok' END, CASE WHEN regexp_matches(m0.text, '[、,/，]|以及|和|及|还有') THEN every WHEN coalesce(s2 >= greatest(24, b - 10), FALSE) THEN '' ELSE best END,
  CASE WHEN NOT regexp_matches(m0.text, '[、,/，]|以及|和|及|还有') AND coalesce(s2 >= greatest(24, b - 10), FALSE) THEN three ELSE '' END FROM fj JOIN m0 USING (message)
UNION ALL SELECT m0.message, CASE WHEN lj.n IS NULL THEN 'no_match' WHEN lj.n = 1 THEN 'ok' ELSE 'ambiguous' END, CASE WHEN lj.n = 1 THEN three ELSE '' END, CASE WHEN lj.n > 1 THEN three ELSE '' END FROM m0 LEFT JOIN lj USING (message) WHERE how > 1 AND m0.message NOT IN (SELECT message FROM fs)""")
def selection_resolved(spark, sf_dir):
    papers = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.format_string("P%03d", "item_id").alias("id"), F.col("text").alias("title"))
    how = (F.col("conv_id") + F.col("turn")) % 7
    none = F.array().cast("array<string>")
    messages = A.table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("message"), "text", F.when(how == 0, F.array(*map(F.lit, ["P001", "P999", "P003"]))).otherwise(none).alias("ids"), F.when(how == 1, 2).otherwise(0).alias("top_n"))
    return N.resolve(messages, papers).select("message", "status", F.array_join("ids", ",").alias("ids"), F.array_join("matches", ",").alias("matches"))


# sessions

_ASKED = ["the", "Paper 17", "10.1000/4", "A5", "no such thing at all", ""]
_NR = SQ._NR


@query(f"""WITH {A.PAPERS_SQL}, s AS (SELECT 's' || printf('%09d', ord) AS name, list_filter([{_NR.format("'Paper ' || ord")}, {_NR.format('title')}, {_NR.format("coalesce(doi, '')")}, {_NR.format("coalesce(arxiv_id, '')")}], lambda x: x <> '') AS fields FROM papers),
a AS (SELECT q, {_NR.format('q')} AS n FROM (SELECT unnest({A._quoted(_ASKED)}) AS q))
SELECT q AS asked, max(name) AS name FROM a JOIN s ON n <> '' AND len(list_filter(fields, lambda f: contains(f, n) OR contains(n, f))) > 0 GROUP BY 1""")
def session_match(spark, sf_dir):
    sessions = A.papers(spark, sf_dir).select(F.concat(F.lit("s"), F.lpad(F.col("ord").cast("string"), 9, "0")).alias("name"), F.concat(F.lit("Paper "), F.col("ord").cast("string")).alias("query"), "title", "doi", "arxiv_id")
    found = [V.latest_session(sessions, q) for q in _ASKED]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows


@query("""SELECT 's' || printf('%09d', doc_id) AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'q' || doc_id END AS query, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id ELSE 'c' || doc_id END AS updated_at, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id END AS paper_count FROM documents WHERE doc_id % 7 > 1 ORDER BY doc_id DESC LIMIT 20""")
def recent_sessions(spark, sf_dir):
    d = F.col("doc_id")
    text = d.cast("string")
    session = F.to_json(F.struct(F.when(d % 3 != 0, F.concat(F.lit("q"), text)).alias("query"), F.concat(F.lit("c"), text).alias("created_at"), F.when(d % 2 == 0, F.concat(F.lit("u"), text)).alias("updated_at"), F.when(d % 5 != 0, d).alias("paper_count")))
    record = F.when(d % 7 == 0, '{"query": ').when(d % 7 == 1, "[1]").otherwise(session)
    return V.recent_sessions(A.table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.lpad(text, 9, "0")).alias("name"), record.alias("json")))
