"""Full analysis: pages of citing papers to spans, findings and a status per paper."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import findings as M
from ..operators import passages as S
from ..operators import prompts as R
from ..operators import semantics
from ..session import checkpointed


def sections(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Body and reference paragraphs of pages (doc_id, page, text); the pages are cut once for both."""
    start = S.reference_start(pages)
    inside = F.col("reference_start").isNotNull() & (F.col("page") >= F.col("reference_start"))
    rows = checkpointed(S.split_pages(pages).join(start, "doc_id").withColumn("inside", inside).drop("reference_start"))
    return rows.where("NOT inside").drop("inside"), rows.where("inside").drop("inside")


def citation_numbers(references: DataFrame, title: str, doi: str = "") -> DataFrame:
    """doc_id and the number under which its reference list names the target."""
    return S.best_reference(references, X.signs_of(references.sparkSession, title, doi)).select("doc_id", F.col("citation_index").try_cast("int").alias("number")).where("number IS NOT NULL")


def numbered_hits(body: DataFrame, numbers: DataFrame) -> DataFrame:
    """Body paragraphs with the kind of their marker of the document's own number."""
    rows = body.join(numbers, "doc_id")
    return rows.withColumn("kind", X.citation_hit("text", F.col("number"))).withColumn("reference_like", X.is_reference_entry("text"))


def candidate_spans(pages: DataFrame, title: str, doi: str = "", contexts: DataFrame | None = None, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Ranked spans with their surroundings, and the citation numbers of the documents."""
    body, references = sections(pages)  # used by every generator
    numbers = checkpointed(citation_numbers(references, title, doi))
    place = ["doc_id", "seq", "page", "span_index"]
    none = F.lit(None).cast("double").alias("overlap")
    parts = [S.neighbour_spans(numbered_hits(body, numbers)).select(*place, "match_type", F.col("score").cast("double").alias("score"), F.lit(0).alias("ord"), none)]
    if contexts is not None:
        near = S.context_similarity(body, contexts).select("doc_id", "seq", "overlap").groupBy("doc_id", "seq").agg(F.max("overlap").alias("overlap"))
        parts.append(near.join(body.select(*place), ["doc_id", "seq"]).select(*place, F.lit("context_similarity").alias("match_type"), F.round(F.col("overlap") * 100, 2).alias("score"), F.lit(1).alias("ord"), "overlap"))
    words = S.keyword_fallback(body, X.signs_of(body.sparkSession, title, doi))
    parts.append(words.select(*place, F.lit("keyword_fallback").alias("match_type"), F.col("score").cast("double").alias("score"), F.lit(2).alias("ord"), none))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    merged = S.merge_spans(spans).join(body.select("doc_id", "page", "span_index", "seq", "text"), ["doc_id", "page", "span_index"]).where(~X.is_noisy("text"))
    windows = S.local_windows(body, merged)
    return S.final_order(windows, k), numbers


def prompted(title: str, year: str, aliases: list[str], answer: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """An analysis by prompts: ``answer`` takes payloads (doc_id, scope, prompt) and gives the results of ``semantics.single_model`` and its like."""

    def analyse(spans: DataFrame) -> DataFrame:
        papers = spans.groupBy("doc_id").agg(F.first("citing_title").alias("title"))
        shown = spans.withColumns({"evidence": F.split("evidence", ","), "keyword_hits": F.array().cast("array<string>")})
        payloads = R.span_prompts(papers, shown, title, year, aliases).select("doc_id", F.lit("candidate_spans").alias("scope"), "prompt")
        return semantics.asked_findings(answer(payloads))

    return analyse


def analyse_papers(
    pages: DataFrame, title: str, doi: str = "", contexts: DataFrame | None = None, downloads: DataFrame | None = None, extraction: DataFrame | None = None,
    analyse: Callable[[DataFrame], DataFrame] = semantics.cue_findings, top: int = 8,
) -> DataFrame:
    """doc_id, status, error_type, spans, findings and citation_index of every document.

    Each stage passes on what it could do; what it could not has a status and a type of error
    and is left alone by later stages, and no document is dropped. ``downloads``: doc_id, ok,
    error_type (without a full text, contexts are all there is). ``extraction``: doc_id,
    error_type (null where pages were read). ``analyse`` takes passages (doc_id, page, span_index,
    text and what else spans have) and gives findings, or a row with an error_type for a document
    that it failed on.
    """
    pages = pages.join(downloads.where("NOT ok").select("doc_id"), "doc_id", "left_anti") if downloads is not None else pages
    read = pages.join(extraction.where("error_type IS NOT NULL").select("doc_id"), "doc_id", "left_anti") if extraction is not None else pages
    spans, numbers = candidate_spans(read, title, doi, contexts)
    spans = checkpointed(spans)
    asked = spans.where(F.col("place") <= top).withColumn("raw_text", F.col("text")).withColumn("text", F.col("window_text")).withColumn("citing_title", F.lit(""))
    answered = checkpointed(analyse(asked))
    failed = answered.where("error_type IS NOT NULL").groupBy("doc_id").agg(F.min("error_type").alias("error_type"))
    kept = M.consistent(answered.where("error_type IS NULL AND keep").join(spans.select("doc_id", "page", "span_index", F.col("text").alias("citation_text")), ["doc_id", "page", "span_index"])).select("doc_id", "mention_type")
    kept = checkpointed(kept)
    found = kept.unionByName(M.weak_findings(spans.join(failed.select("doc_id"), "doc_id", "left_anti"), kept).select("doc_id", "mention_type"))
    counts = found.groupBy("doc_id").agg(F.count("*").alias("findings"), F.count_if(F.col("mention_type") == "explicit_citation").alias("strong"))
    first = spans.groupBy("doc_id").agg(
        F.count("*").alias("spans"), F.count_if(F.col("match_type").isin(M.INDEX_KINDS)).alias("index_hits"),
        F.min_by(F.struct(F.split("evidence", ",").alias("evidence"), "score"), "place").alias("t"),
    )
    # what each stage could not do, the first stage first
    none = F.lit(None).cast("string")
    outcomes = [pages.select("doc_id", F.lit(9).alias("stage"), none.alias("status"), none.alias("error_type")).distinct()]
    say = lambda df, stage, status, why: df.select("doc_id", F.lit(stage).alias("stage"), F.lit(status).alias("status"), why.alias("error_type"))
    if downloads is not None:
        outcomes += [say(downloads.where("NOT ok"), 0, "context_only", F.col("error_type")), say(downloads.where("ok"), 9, None, none)]
    if extraction is not None:
        late = extraction.where("error_type IS NOT NULL")
        outcomes.append(say(late, 1, "fulltext_extract_failed", F.col("error_type")))
    outcomes.append(say(failed, 2, "analysis_failed", F.col("error_type")))
    told = reduce(DataFrame.unionByName, [o.select("doc_id", "stage", F.col("status").cast("string"), F.col("error_type").cast("string")) for o in outcomes])
    ended = told.groupBy("doc_id").agg(F.min_by(F.struct("status", "error_type"), F.struct("stage", "error_type")).alias("e"))
    docs = ended.join(first, "doc_id", "left").join(counts, "doc_id", "left").join(numbers, "doc_id", "left").select(
        "doc_id", "e", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("spans", "index_hits", "findings", "strong")), F.col("number").isNotNull().alias("has_index"), F.col("t.evidence").alias("top_evidence"), F.col("t.score").alias("top_score"), "number"
    )
    status = F.coalesce("e.status", M.status_of(docs))
    return docs.select("doc_id", status.alias("status"), F.col("e.error_type").alias("error_type"), "spans", "findings", F.col("number").alias("citation_index"))
