"""Findings about citations: coercion, status, methods, evidence, views, gold comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Enumerations.
ASPECTS = "background method baseline comparison extension application other".split()
STANCES = "positive neutral negative".split()
MENTIONS = "explicit_citation grouped_literature_mention weak_body_mention".split()
METHOD_GROUPS = "reference_only background baseline application extension large_scale first_claim mention_only".split()
INDEX_KINDS = "citation_index_exact citation_index_grouped citation_index_neighbor".split()
QA_STATUSES = "fulltext_analyzed mention_only reference_only fulltext_no_finding".split()
# Phrases of error messages, by class.
LOCKED = ("password", "encrypted")
BROKEN = ("stream has ended unexpectedly", "eof marker not found", "broken xref", "malformed", "trailer", "unexpectedly")
TOO_LONG = ("exceeds the available context size", "available context size", "maximum context length", "context length exceeded")
UNREACHABLE = ("connection refused", "max retries exceeded", "failed to establish a new connection", "name or service not known", "timed out")
BAD_REQUEST = ("400 client error", "status code 400")
RATE_LIMITED = ("429", "rate limit")


def normalise_findings(raw: DataFrame) -> DataFrame:
    """Typed findings from text fields; what is missing or odd takes the default.

    ``raw``: doc_id, ord, page, span_index, keep_text, aspect, stance, confidence_text,
    mention_type, citation_text. Rows without page or span_index go.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    keep = X.as_bool(F.col("keep_text"))
    aspect = F.when(text("aspect").isin(ASPECTS), text("aspect")).when((text("aspect") == "") | ~text("aspect").isin(ASPECTS), F.when(keep, "other").otherwise("background"))
    stance = F.when(text("stance").isin(STANCES), text("stance")).otherwise("neutral")
    mention = F.when(text("mention_type").isin(MENTIONS), text("mention_type")).otherwise(F.when(keep, "explicit_citation").otherwise("weak_body_mention"))
    parsed = F.col("confidence_text").try_cast("double")
    confidence = F.when(parsed.isNull(), F.when(keep, 0.6).otherwise(0.35)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), parsed)))
    rows = raw.where("page IS NOT NULL AND span_index IS NOT NULL")
    typed = rows.select("doc_id", "ord", "page", "span_index", keep.alias("keep"), aspect.alias("aspect"), stance.alias("stance"), confidence.alias("confidence"), mention.alias("mention_type"), text("citation_text").alias("citation_text"))
    return consistent(typed)


def consistent(findings: DataFrame) -> DataFrame:
    """Findings that are not kept are no explicit citations: a group of numbers makes them grouped mentions, else they are weak."""
    grouped = F.coalesce("citation_text", F.lit("")).rlike(r"\[\s*\d+\s*(?:[,，;；]\s*\d+\s*)+\]")
    kind = F.when(~F.col("keep") & (F.col("mention_type") == "explicit_citation"), F.when(grouped, "grouped_literature_mention").otherwise("weak_body_mention")).otherwise(F.col("mention_type"))
    return findings.withColumn("mention_type", kind)


def weak_findings(spans: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings made up for documents that have none but whose top span is an index hit."""
    top = spans.where("place = 1 AND match_type IN ('citation_index_exact', 'citation_index_grouped', 'citation_index_neighbor')")
    bare = top.join(findings.select("doc_id").distinct(), "doc_id", "left_anti")
    mention = F.when(F.col("match_type") == "citation_index_grouped", "grouped_literature_mention").otherwise("weak_body_mention")
    return bare.select(
        "doc_id", F.lit(0).alias("ord"), "page", "span_index", F.lit(False).alias("keep"), F.lit("background").alias("aspect"), F.lit("neutral").alias("stance"), F.lit(0.35).alias("confidence"), mention.alias("mention_type"), F.substring("text", 1, 1200).alias("citation_text")
    )


def status_of(documents: DataFrame) -> Column:
    """The status cascade over per-document aggregates.

    Columns: findings, strong (findings of an explicit kind), has_index, index_hits,
    top_evidence (array), top_score.
    """
    weak_index = F.exists("top_evidence", lambda e: e.isin(INDEX_KINDS))
    return (
        F.when((F.col("findings") > 0) & (F.col("strong") > 0), "fulltext_analyzed")
        .when(F.col("findings") > 0, "mention_only")
        .when(F.col("has_index") & (F.col("index_hits") == 0), "reference_only")
        .when(F.coalesce(weak_index, F.lit(False)), "mention_only")
        .when(F.coalesce("top_score", F.lit(0)) >= 3, "mention_only")
        .otherwise("fulltext_no_finding")
    )


def method_summary(findings: DataFrame, islands: DataFrame) -> DataFrame:
    """Per document: labels, pages, occurrences, runs, first claims, highest confidence."""
    labels = F.array_distinct(F.flatten(F.collect_set(F.filter(F.array("aspect", F.when(F.col("mention_type") != "explicit_citation", F.col("mention_type"))), lambda x: x.isNotNull() & (x != "")))))
    summary = findings.groupBy("doc_id").agg(
        F.array_sort(labels).alias("labels"), F.bool_or(X.first_claim("citation_text")).alias("first_claim"), F.max("confidence").alias("confidence"),
        F.count("*").alias("findings"), F.count_if(F.col("mention_type") == "explicit_citation").alias("strong"),
    )
    return summary.join(islands, "doc_id", "left")


def method_groups(summary: DataFrame) -> Column:
    """The groups of a document; it may be in several. ``summary`` has a status as well."""
    has = lambda v: F.array_contains("labels", v)
    large = (F.col("occurrences") >= 2) | (F.col("islands") >= 2) | (F.coalesce("char_length", F.lit(0)) >= 500) | (F.coalesce("sentence_count", F.lit(0)) >= 4)
    tests = {
        "reference_only": (F.col("status") == "reference_only") | has("reference_only"), "background": has("background"), "baseline": has("baseline"), "application": has("application"),
        "extension": has("extension"), "large_scale": large, "first_claim": F.col("first_claim"), "mention_only": (F.col("status") == "mention_only") | has("mention_only"),
    }
    return F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(g)) for g, t in tests.items())), lambda g: g.isNotNull())


def method_statistics(summary: DataFrame) -> DataFrame:
    """Documents of each group, empty groups included."""
    groups = summary.sparkSession.createDataFrame(list(enumerate(METHOD_GROUPS)), "group_ord int, method string")
    counts = summary.select(F.explode(method_groups(summary)).alias("method")).groupBy("method").agg(F.count("*").alias("n"))
    return F.broadcast(groups).join(counts, "method", "left").select("group_ord", "method", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def qa_ready(documents: DataFrame, spans: DataFrame, findings: DataFrame) -> DataFrame:
    """Documents with spans and findings and a status that allows answers."""
    ready = documents.where(F.col("status").isin(QA_STATUSES))
    return ready.join(spans.select("doc_id"), "doc_id", "left_semi").join(findings.select("doc_id"), "doc_id", "left_semi")


def detail_filter(papers: DataFrame, download_status: str = "", analysis_status: str = "", strong_only: bool = False, candidate_only: bool = False) -> DataFrame:
    """The detail view's filters; statistics are computed on what they leave."""
    if download_status:
        papers = papers.where(F.col("download_status") == download_status)
    if analysis_status:
        papers = papers.where(F.col("status") == analysis_status)
    if strong_only:
        papers = papers.where("first_claim")
    if candidate_only:
        papers = papers.where("candidate_count > 0")
    return papers


def cards(papers: DataFrame) -> DataFrame:
    """Which actions a paper's card offers."""
    local = F.col("download_status") == "local_available"
    return papers.select("doc_id", "download_status", (local | (F.col("download_status") == "auto_downloadable")).alias("can_download"), local.alias("can_analyze"))


def gold_report(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: gold cases, matched ones, equal statuses and their share.

    ``gold``: target, citing, gold_status, needs_review. ``runs``: target, citing, status, ord
    (of runs with one key the last counts).
    """
    key = [X.gold_norm("target").alias("t"), X.gold_norm("citing").alias("c")]
    last = runs.select(*key, "status", "ord").groupBy("t", "c").agg(F.max_by("status", "ord").alias("status"))
    cases = gold.where("NOT needs_review").select(*key, "gold_status").join(last, ["t", "c"], "left")
    counts = cases.agg(F.count("*").alias("gold_count"), F.count("status").alias("matched"), F.count_if(F.col("status") == F.col("gold_status")).alias("status_match"))
    return counts.withColumn("match_rate", F.when(F.col("matched") > 0, F.round(F.col("status_match") / F.col("matched"), 4)).otherwise(F.lit(0.0)))


def first_functions(findings: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` distinct functions of each document's findings, joined."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", "function"))), lambda x: x["function"])
    return findings.where(F.trim("function") != "").groupBy("doc_id").agg(F.array_join(F.slice(F.array_distinct(items), 1, k), " | ").alias("functions"))


def prioritised(results: DataFrame, most: int) -> DataFrame:
    """The first ``most`` results worth showing, padded with deferred ones in order."""
    good = ~F.col("status").isin("context_only", "fulltext_extract_failed", "analysis_failed")
    order = Window.partitionBy("session").orderBy((~good).cast("int"), "ord")
    return results.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def probe_status(attempts: DataFrame) -> DataFrame:
    """Per paper the first good probe (local or downloadable), else the first that worked, else the last."""
    status = F.when(~F.col("ok"), "probe_failed").when(F.col("local"), "local_available").when(F.col("candidates") > 0, "auto_downloadable").otherwise("manual_required")
    s = attempts.withColumn("status", status)
    good = F.col("status").isin("local_available", "auto_downloadable")
    return s.groupBy("paper").agg(
        F.coalesce(F.min_by(F.when(good, F.col("status")), F.when(good, F.col("ord"))), F.min_by(F.when(F.col("ok"), F.col("status")), F.when(F.col("ok"), F.col("ord"))), F.max_by("status", "ord")).alias("status"), F.count("*").alias("attempts")
    )


def _says(error: Column, phrases: tuple[str, ...]) -> Column:
    e = F.lower(F.coalesce(error, F.lit("")))
    return F.greatest(F.lit(False), *(e.contains(p) for p in phrases))


def extract_failure(error: Column) -> Column:
    """Class of an extraction error by its message."""
    return F.when(_says(error, LOCKED), "pdf_encrypted").when(_says(error, BROKEN), "pdf_corrupted_or_malformed").otherwise("pdf_extract_exception")


def request_failure(error: Column) -> Column:
    """Class of a model request's error by its message."""
    return F.when(_says(error, TOO_LONG), "context_length_exceeded").when(_says(error, UNREACHABLE), "service_unreachable").when(_says(error, BAD_REQUEST), "bad_request").otherwise("request_failed")


def rate_limited(error: Column) -> Column:
    return _says(error, RATE_LIMITED)
