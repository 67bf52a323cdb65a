"""Views of analysed papers: evidence, citation trace, reasons of failures, answers, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import findings as M
from . import papers as P

# What a trace shows of its debug data, and lengths of excerpts.
DEBUG_KEYS = "analysis_mode analysis_scope candidate_span_count fulltext_page_count fulltext_char_count prompt_chars llm_url llm_model output_source finish_reason content_len reasoning_len candidate_pages fulltext_pages".split()
TRACE_CHARS, EXCERPT_CHARS, HIGHLIGHT_CHARS = 700, 220, 180

# Tags and messages of failures, by status and type of error.
CONTEXT_ONLY = (["未获得 PDF", "仅 citation context", "未经全文验证"], "未获得全文 PDF，当前结果仅基于 citation contexts，未经全文验证。")
DOWNLOAD_FAILURES = {
    "fake_pdf_html_interstitial": (["fake_pdf_html_interstitial", "假 PDF / HTML 拦截页"], "这不是模型问题，而是下载到的文件实际上是 HTML/反爬页面，不是真正 PDF。"),
    "downloaded_non_pdf": (["downloaded_non_pdf", "无效 PDF / 假 PDF"], "这不是模型问题，而是下载到的文件并非真实 PDF。"),
}
RATE_LIMIT = (["外部源限流"], "下载阶段命中过外部源限流（HTTP 429）。")
EXTRACT_FAILURES = {
    "extract_text_failed": (["extract_text_failed", "全文提取失败"], "已获得 PDF，但全文提取阶段失败，无法进入候选段落定位。"),
    "pdf_parse_failed": (["pdf_parse_failed", "PDF 解析失败"], "已获得 PDF，但 pypdf、PyMuPDF、pdfplumber 均未能稳定解析文本。"),
    "empty_text_pdf": (["empty_text_pdf", "文本几乎为空"], "PDF 可以打开，但提取到的文本几乎为空，暂时无法继续全文分析。"),
    "likely_scanned_pdf": (["likely_scanned_pdf", "疑似扫描版 PDF"], "PDF 可以打开，但更像扫描版/图片版，当前无 OCR 主路径，暂时无法继续全文分析。"),
}
EXTRACT_OTHER = (["全文提取失败"], "已获得 PDF，但全文提取失败，无法继续做全文级语义分析。")
ANALYSIS_TAG, ANALYSIS_OTHER = "全文语义分析失败", "已获得候选段落，但全文语义分析阶段失败。"
ANALYSIS_FAILURES = {
    "candidate_span_failed": "候选段落定位阶段失败，未能生成可分析的正文候选。",
    "single_model_request_failed": "分析模型请求阶段失败，全文语义分析未能完成。",
    "single_model_json_parse_failed": "分析模型返回结果无法解析为 JSON，未能产出结构化分析结果。",
    "single_model_schema_invalid": "分析模型返回 JSON 结构不符合全文分析 schema，未能产出可靠结构化结果。",
    "local_model_request_failed": "本地模型请求阶段失败，全文语义分析未能完成。",
    "blank_model_output": "分析模型返回空输出，未能进入结构化结果处理阶段。",
    "deepseek_request_failed": "DeepSeek 整理阶段请求失败，未能产出结构化分析结果。",
    "deepseek_json_parse_failed": "DeepSeek 返回结果无法解析为 JSON，未能产出结构化分析结果。",
    "write_output_failed": "分析过程中的结果写出失败，请检查服务器目录权限或磁盘空间。",
}
WRITE_FAILURE = (["write_output_failed", "结果写出失败"], "分析过程中的结果写出失败，请检查目录权限、磁盘空间或文件系统状态。")
# Notes of failed stages.
NOTES = {
    "extract_text_failed": "PDF 已获得，但全文提取失败，无法进入全文分析。",
    "pdf_parse_failed": "PDF 已获得，但多个解析器都未能稳定解析文本。",
    "empty_text_pdf": "PDF 已获得，但提取到的文本几乎为空，无法进入全文分析。",
    "likely_scanned_pdf": "PDF 已获得，但更像扫描版/图片版，当前无法直接进入全文分析。",
    "candidate_span_failed": "全文已提取，但候选段落定位失败，无法进入全文分析。",
    "single_model_request_failed": "候选段落已生成，但分析模型请求失败，无法完成全文分析。",
    "single_model_json_parse_failed": "分析模型已返回结果，但 JSON 解析失败。",
    "single_model_schema_invalid": "分析模型已返回 JSON，但结构不符合全文分析 schema。",
    "local_model_request_failed": "候选段落已生成，但本地模型请求失败，无法完成全文分析。",
    "blank_model_output": "候选段落已生成，但分析模型返回空输出，无法完成全文分析。",
    "deepseek_request_failed": "本地模型已返回分析结果，但 DeepSeek 整理阶段请求失败。",
    "deepseek_json_parse_failed": "本地模型与 DeepSeek 已返回结果，但 JSON 解析失败。",
    "write_output_failed": "分析过程完成了一部分，但写出结果文件失败。",
}
NOTE_OTHER, NOTE_DETAIL = "全文分析流程失败。", " 详情："
# Words of questions, and the sentences of answers.
ASKS_LENGTH, ASKS_TEXT = "多长|多大的段落|多少字|多长的段落|长度", "原文|哪一段|具体内容|详细"
NOT_READY = "%s 目前还没有可直接问答的全文证据。"
NOT_READY_NUMBER, NOT_READY_OTHER = "你可以先说“分析第%s篇”或“全面分析这篇论文的影响力”。", "你可以先说“分析这篇论文”或“全面分析这篇论文的影响力”。"
PLACE_LINE = "%s 在当前全文分析里，最主要的引用证据位于第 %s 页、第 %s 个候选段落。"
LENGTH_LINE = "这段核心引用片段约 %s 个非空白字符，约 %s 句。"
JUDGED_LINE = "当前判断：%s（置信度 %s）。"
EXCERPT_LINE, CHECK_LINE, NO_EXCERPT = "证据摘录：%s", "可复核摘录：%s", "暂无可展示摘录。"


def primary_evidence(spans: DataFrame, findings: DataFrame) -> DataFrame:
    """The top span of each document with the first finding at its place.

    ``spans``: doc_id, place, page, span_index, match_type, score, text. ``findings``: doc_id,
    ord, page, span_index, aspect, mention_type, confidence, citation_text, function, reason.
    """
    first = findings.groupBy("doc_id", "page", "span_index").agg(F.min_by(F.struct("aspect", "mention_type", "confidence", "citation_text", "function", "reason"), "ord").alias("f"))
    top = spans.where("place = 1").join(first, ["doc_id", "page", "span_index"], "left")
    focus = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("f.citation_text"), F.lit(""))
    return top.withColumn("focus", focus).select(
        "doc_id", "page", "span_index", "match_type", "score", X.visible_length("focus").alias("char_length"), X.sentence_count("focus").alias("sentence_count"),
        X.truncated("focus", EXCERPT_CHARS).alias("excerpt"), "f.aspect", "f.mention_type", "f.confidence", "f.function", "f.reason",
    )


def evidence_index(documents: DataFrame, spans: DataFrame, findings: DataFrame, contexts: DataFrame) -> DataFrame:
    """Evidence of every analysed document.

    ``documents``: doc_id, status, has_candidates, has_analysis (whether these results exist).
    ``contexts``: doc_id, ord, text; the first two of each document are kept.
    """
    ready = F.col("has_candidates") & F.col("has_analysis") & F.coalesce(F.col("status").isin(M.QA_STATUSES), F.lit(False))
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    two = contexts.withColumn("_at", place).where("_at <= 2").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("c"))
    two = two.select("doc_id", F.transform("c", lambda x: x["text"]).alias("fallback_contexts"))
    zero = F.lit(0).cast("long")
    return (
        documents.withColumn("qa_ready", ready)
        .join(n(spans, "candidate_span_count"), "doc_id", "left").join(n(findings, "findings_count"), "doc_id", "left")
        .join(primary_evidence(spans, findings), "doc_id", "left").join(two, "doc_id", "left")
        .withColumns({"candidate_span_count": F.coalesce("candidate_span_count", zero), "findings_count": F.coalesce("findings_count", zero), "char_length": F.coalesce("char_length", F.lit(0)), "sentence_count": F.coalesce("sentence_count", F.lit(0)), "excerpt": F.coalesce("excerpt", F.lit(""))})
    )


def citation_trace(documents: DataFrame, spans: DataFrame, findings: DataFrame, contexts: DataFrame) -> DataFrame:
    """Counts, shortened findings, spans and contexts, and the debug values that may be shown.

    ``documents``: doc_id, scope, payload_scope, debug map<string,string>, payload_pages,
    payload_chars, fulltext_pages. Lists of a document are bounded by the span and finding
    limits of the analysis.
    """
    short = lambda c: X.truncated(c, TRACE_CHARS)
    listed = lambda df, name, *cols: df.select("doc_id", F.struct("ord", *cols).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias(name))
    f = listed(findings, "findings", "page", "span_index", short("citation_text").alias("citation_text"), "keep", "aspect", "stance", "function", "reason", "confidence", "mention_type")
    s = listed(spans.withColumn("ord", F.col("place")), "candidate_spans", "page", "span_index", "score", "match_type", "citation_index", "evidence", short("text").alias("text"), short("window_text").alias("window_text"))
    c = listed(contexts, "fallback_contexts", short("text").alias("text"), "confidence")
    given = F.map_filter(F.coalesce("debug", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(DEBUG_KEYS) & v.isNotNull() & (v != ""))
    extra = lambda k, v: F.when(~F.map_contains_key(given, k) & v.isNotNull(), F.create_map(F.lit(k), v.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    debug = F.map_concat(given, extra("fulltext_page_count", F.coalesce("payload_pages", "fulltext_pages")), extra("fulltext_char_count", F.col("payload_chars")))
    said = lambda x: F.nullif(x, F.lit(""))
    scope = F.coalesce(said(F.col("scope")), said(F.try_element_at("debug", F.lit("analysis_scope"))), said(F.col("payload_scope")), F.lit("candidate_spans"))
    rows = documents.select("doc_id", scope.alias("analysis_scope"), debug.alias("debug")).join(f, "doc_id", "left").join(s, "doc_id", "left").join(c, "doc_id", "left")
    count = lambda c: F.size(F.coalesce(c, F.array())).cast("long")
    return rows.withColumns({"finding_count": count("findings"), "candidate_span_count": count("candidate_spans"), "fallback_context_count": count("fallback_contexts")})


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for p in values.items() for x in p))


def _tags(names: list[str]) -> Column:
    return F.array(*map(F.lit, names))


def analysis_reason(papers: DataFrame) -> DataFrame:
    """``papers`` with tags, message and errors; papers without a status or anything to say go.

    ``papers``: doc_id, status, errors and error_types (of probe, download and attempts, in
    order), analysis_error_type, analysis_error, analysis_stage, fallback_message.
    """
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    once = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))
    errors, kinds = once(F.coalesce("errors", none)), once(F.coalesce("error_types", none))
    known = F.filter(kinds, lambda k: k.isin(list(DOWNLOAD_FAILURES)))
    limited = F.exists(errors, M.rate_limited)
    fake_tags = F.flatten(F.transform(known, lambda k: F.element_at(F.create_map(*(x for k_, (t, _) in DOWNLOAD_FAILURES.items() for x in (F.lit(k_), _tags(t)))), k)))
    fake_said = F.transform(known, lambda k: F.element_at(_map({k_: d for k_, (_, d) in DOWNLOAD_FAILURES.items()}), k))
    kind, status = text("analysis_error_type"), F.col("status")
    extract_tags, extract_said, found = _tags(EXTRACT_OTHER[0]), F.lit(EXTRACT_OTHER[1]), kind.isin(list(EXTRACT_FAILURES))
    for k, (t, d) in EXTRACT_FAILURES.items():
        extract_tags, extract_said = F.when(kind == k, _tags(t)).otherwise(extract_tags), F.when(kind == k, d).otherwise(extract_said)
    staged = kind.isin(list(ANALYSIS_FAILURES))
    tags = (
        F.when(status == "context_only", F.concat(_tags(CONTEXT_ONLY[0]), fake_tags, F.when(limited, _tags(RATE_LIMIT[0])).otherwise(none)))
        .when(status == "fulltext_extract_failed", extract_tags)
        .when(status == "analysis_failed", F.concat(_tags([ANALYSIS_TAG]), F.when(staged, F.array(kind)).otherwise(none)))
        .when(status == "write_output_failed", _tags(WRITE_FAILURE[0])).otherwise(none)
    )
    said = (
        F.when(status == "context_only", F.concat(_tags([CONTEXT_ONLY[1]]), fake_said, F.when(limited, _tags([RATE_LIMIT[1]])).otherwise(none), F.array(text("fallback_message"))))
        .when(status == "fulltext_extract_failed", F.array(extract_said))
        .when(status == "analysis_failed", F.array(F.coalesce(F.try_element_at(_map(ANALYSIS_FAILURES), kind), F.lit(ANALYSIS_OTHER))))
        .when(status == "write_output_failed", _tags([WRITE_FAILURE[1]])).otherwise(none)
    )
    all_errors = F.concat(errors, F.when(text("analysis_error") != "", F.array(text("analysis_error"))).otherwise(none))
    rows = papers.where(text("status") != "").withColumns({"tags": once(F.concat(tags, F.array(text("analysis_stage")))), "_said": once(said), "errors": all_errors})
    return rows.where("size(tags) > 0 OR size(_said) > 0 OR size(errors) > 0").withColumn("message", F.array_join("_said", "；")).drop("_said")


def failure_note(error_type: Column, error: Column) -> Column:
    """The note of a failed stage, with the error's own text."""
    detail = F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit(NOTE_DETAIL), error)).otherwise("")
    return F.concat(F.coalesce(F.try_element_at(_map(NOTES), F.coalesce(error_type, F.lit(""))), F.lit(NOTE_OTHER)), detail)


def paper_answers(papers: DataFrame, evidence: DataFrame) -> DataFrame:
    """What is answered to a question about a paper (doc_id, id, title, question).

    Papers without ready evidence are asked to be analysed first.
    """
    rows = papers.join(evidence.drop("status", "title"), "doc_id", "left")
    shown = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("0")), F.lit("-"))
    title = F.coalesce("title", "id")
    number = F.regexp_extract("id", r"(?i)^P0*([1-9][0-9]*)$", 1)
    ask = F.when(number != "", F.format_string(NOT_READY_NUMBER, number)).otherwise(NOT_READY_OTHER)
    judged = F.coalesce(F.nullif("function", F.lit("")), F.nullif("reason", F.lit("")))
    question = F.coalesce("question", F.lit(""))
    line = F.when(question.rlike(ASKS_TEXT) | ~question.rlike(ASKS_LENGTH), EXCERPT_LINE).otherwise(CHECK_LINE)
    excerpt = F.replace(line, F.lit("%s"), F.coalesce(F.nullif("excerpt", F.lit("")), F.lit(NO_EXCERPT)))
    answer = F.concat_ws(
        "\n", F.format_string(PLACE_LINE, title, shown("page"), shown("span_index")),
        F.format_string(LENGTH_LINE, F.coalesce("char_length", F.lit(0)).cast("string"), F.coalesce("sentence_count", F.lit(0)).cast("string")),
        F.when(judged.isNotNull(), F.format_string(JUDGED_LINE, judged, F.coalesce(F.col("confidence").cast("string"), F.lit("-")))), excerpt,
    )
    ready = F.coalesce("qa_ready", F.lit(False))
    return rows.select(
        "doc_id", F.when(ready, "answered").otherwise("needs_full_analysis").alias("answer_status"),
        F.when(ready, answer).otherwise(F.concat(F.format_string(NOT_READY, title), ask)).alias("answer"),
    )


def report_entries(results: DataFrame, labels: list[tuple[str, str]]) -> DataFrame:
    """Results grouped by status in the order of ``labels`` (status, label), other ones after them.

    ``results``: ord, doc_id, title, status, note, analysis_message, fallback_message.
    """
    known = F.broadcast(results.sparkSession.createDataFrame([(k, s, n) for k, (s, n) in enumerate(labels)], "label_ord int, status string, status_label string"))
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = results.withColumn("status", F.coalesce("status", F.lit("unknown"))).join(known, "status", "left")
    place = F.row_number().over(Window.partitionBy("status").orderBy("ord"))
    return rows.select(
        F.coalesce("label_ord", F.lit(len(labels))).alias("label_ord"), "status", F.coalesce("status_label", "status").alias("status_label"), place.alias("place"), "doc_id", "title",
        F.coalesce(said("note"), said("analysis_message"), said("fallback_message")).alias("status_message"),
    )


def highlights(papers: DataFrame, group: str, k: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first ``k`` papers (ord, title, confidence, context) of each group with a context to show."""
    excerpt = X.truncated("context", HIGHLIGHT_CHARS)
    rows = papers.withColumn("excerpt", excerpt).where("excerpt <> ''")
    place = F.row_number().over(Window.partitionBy(group).orderBy("ord"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select(group, "place", "ord", "title", "confidence", "excerpt", *keep)


# What a quick analysis says, and how levels are called.
LEVELS = {"high": "较高", "medium": "中等", "low": "初步"}
NO_PAPERS = "当前会话中还没有发现引用论文。"
OF_TOTAL, OF_SHOWN = "Semantic Scholar 当前记录总引用数约 %s 篇，本会话先展示其中 %s 篇候选论文。", "当前会话先展示 %s 篇引用论文候选。"
SIGNALS = "%s 其中 %s 篇在 citation contexts 中呈现出中高置信度引用信号。"
FOREMOST = "从现有上下文看，较值得优先关注的引用论文包括 %s。"
JUDGED = "基于现有 citation contexts 的初步判断，这篇目标论文的外部影响力处于%s水平；如果需要回答“具体怎么引用、引用了多长段落”，还需要继续做全文级全面分析。"


def quick_analysis(sessions: DataFrame, papers: DataFrame) -> DataFrame:
    """session, status, impact_level, summary and highlights of each session from its contexts alone.

    ``sessions``: session, total (all citations that are known of, or null). ``papers``: session,
    ord, id, title, confidence, context. A session without papers is empty and says so.
    """
    counts = P.impact_level(papers, "session")
    shown = highlights(papers.withColumn("named", F.concat_ws(" ", "id", "title")), "session", keep=("id", "named"))
    best = shown.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("place", "id", "named", "excerpt"))).alias("highlights"))  # three at most
    rows = sessions.join(counts, "session", "left").join(best, "session", "left")
    said = lambda form, *cols: F.format_string(form, *(F.col(c).cast("string") if isinstance(c, str) else c for c in cols))
    intro = F.when(F.coalesce("total", F.lit(0)) > 0, said(OF_TOTAL, "total", "n")).otherwise(said(OF_SHOWN, "n"))
    top = F.array_join(F.transform(F.slice("highlights", 1, 2), lambda h: h["named"]), "、")
    label = F.element_at(F.create_map(*(F.lit(x) for p in LEVELS.items() for x in p)), F.col("impact_level"))
    summary = F.concat_ws(" ", said(SIGNALS, intro, "confident"), F.when(F.size("highlights") > 0, said(FOREMOST, top)), said(JUDGED, label))
    empty = F.col("n").isNull()
    return rows.select("session", F.when(empty, "empty").otherwise("ready").alias("status"), "impact_level", F.when(empty, NO_PAPERS).otherwise(summary).alias("summary"), F.coalesce(F.transform("highlights", lambda h: h["excerpt"]), F.array().cast("array<string>")).alias("highlights"))


def impact_statistics(people: DataFrame, methods: DataFrame) -> DataFrame:
    """Statistics of people (group_ord, tag_type, n) and of citation methods (group_ord, method, n) in one relation."""
    a = people.select(F.lit("person").alias("section"), "group_ord", F.col("tag_type").alias("name"), "n")
    return a.unionByName(methods.select(F.lit("citation_methods").alias("section"), "group_ord", F.col("method").alias("name"), "n"))


# sessions


def matches_query(query: str) -> Column:
    """Whether a session (query, title, doi, arxiv_id) answers to ``query``: equal, inside it or around it."""
    q = X.norm_ref(F.lit(query))
    fields = F.filter(F.array(*(X.norm_ref(c) for c in ("query", "title", "doi", "arxiv_id"))), lambda c: c != "")
    return (q != "") & F.exists(fields, lambda c: c.contains(q) | q.contains(c))


def latest_session(sessions: DataFrame, query: str) -> DataFrame:
    """The newest session (by name) that answers to ``query``; no row if none does."""
    return sessions.where(matches_query(query)).groupBy().agg(F.max("name").alias("name")).where("name IS NOT NULL").select(F.lit(query).alias("asked"), "name")


_SESSION = "query string, created_at string, updated_at string, paper_count long"


def recent_sessions(records: DataFrame, limit: int = 20) -> DataFrame:
    """The newest sessions by name; records (name, json) that are no JSON objects are passed over."""
    read = records.where(F.try_parse_json("json").isNotNull() & F.ltrim("json").startswith("{")).withColumn("s", F.from_json("json", _SESSION))
    newest = read.orderBy(F.col("name").desc()).limit(limit)
    return newest.select("name", F.coalesce("s.query", F.lit("")).alias("query"), F.coalesce(F.nullif("s.updated_at", F.lit("")), "s.created_at").alias("updated_at"), F.coalesce("s.paper_count", F.lit(0).cast("long")).alias("paper_count"))


def chosen(papers: DataFrame, ids: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The papers of these ids; all without any."""
    return papers if ids is None or ids.isEmpty() else papers.join(ids.select(key).distinct(), key, "left_semi")


def to_refresh(papers: DataFrame, ids: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Papers whose download status is probed again: chosen ones that are not local yet, or all if forced."""
    rows = chosen(papers, ids)
    return rows if force else rows.where(F.coalesce(F.col("download_status") != "local_available", F.lit(True)))


def analysis_scope(value: Column) -> Column:
    """candidate_spans or fulltext_direct, from the names users give them."""
    v = F.replace(F.lower(F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit("candidate_spans")))), F.lit("-"), F.lit("_"))
    return F.when(v.isin("fulltext", "full_text", "direct", "fulltext_direct"), "fulltext_direct").otherwise("candidate_spans")
