"""Full texts: where to find them, what is fetched already, extraction with fallbacks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.findings import extract_failure
from ..session import ship

#: Sources of a full text, in the order in which they are tried.
SOURCES = "local open_access unpaywall landing_page openalex arxiv core".split()


def download_plan(candidates: DataFrame) -> DataFrame:
    """Links of each paper by source order, each once. ``candidates``: paper, source, ord, url."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    ranked = candidates.where((F.trim("url") != "") & (rank > 0)).withColumn("rank", rank)
    once = ranked.groupBy("paper", "url").agg(F.min(F.struct("rank", "ord", "source")).alias("first"))
    place = F.row_number().over(Window.partitionBy("paper").orderBy("first.rank", "first.ord", "url"))
    return once.select("paper", "url", F.col("first.source").alias("source"), place.alias("place"))


def missing_urls(wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    """URLs without a successful response in the table of fetched ones (key, status)."""
    key = F.sha1("url")
    return wanted.select("url").distinct().withColumn("key", key).join(fetched.where("status = 200").select("key"), "key", "left_anti")


def local_files(papers: DataFrame, files: DataFrame, least: float = 0.75) -> DataFrame:
    """The best local file of each paper by name.

    A name equal to the title's file name or to the preprint id scores 1, one that holds the
    DOI 0.95, any other the share of common words. Papers and files meet in equality joins: on
    names, on the DOI parts of paths, and on words, of which titles that share ``least`` of them
    have one among the first of each (in any fixed order). ``papers``: paper, title, and doi and
    arxiv_id if there are any. ``files``: path. The longest of the best paths is taken.
    """
    for c in {"doi", "arxiv_id"} - set(papers.columns):
        papers = papers.withColumn(c, F.lit(None).cast("string"))
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    f = files.withColumn("file_name", base)
    exact = papers.where(F.trim("title") != "").select("paper", F.lower(X.file_name("title")).alias("key")).join(f.select("path", F.lower("file_name").alias("key")), "key").select("paper", "path", F.lit(1.0).alias("similarity"))
    ids = papers.select("paper", X.title_key(X.arxiv_strict("arxiv_id")).alias("key")).where("key <> ''").join(f.select("path", X.title_key("file_name").alias("key")), "key").select("paper", "path", F.lit(1.0).alias("similarity"))
    # a DOI with underscores for slashes stands in a path as the beginning of a part that starts with "10."
    part = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("path"), F.lit(r"(?=(10\..*))"), F.lit(1))))
    begins = F.explode(F.transform(F.sequence(F.lit(4), F.greatest(F.length("part"), F.lit(4))), lambda n: F.substring(F.col("part"), F.lit(1), n)))
    hints = f.select("path", part.alias("part")).select("path", begins.alias("key")).distinct()
    doi = papers.select("paper", F.replace(F.lower(F.coalesce("doi", F.lit(""))), F.lit("/"), F.lit("_")).alias("key")).where("key LIKE '10.%'")
    by_doi = doi.join(hints, "key").select("paper", "path", F.lit(0.95).alias("similarity"))
    # titles of n and m words share least * greatest(n, m) of them, so one is among the first n - ceil(least * n) + 1
    words = lambda c: F.array_sort(F.array_distinct(X.tokens(X.title_key(c))))
    prefix = lambda ws: F.explode(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - F.ceil(least * F.size(ws)).cast("int") + 1, F.lit(0))))
    p_words, f_words = papers.select("paper", "title", prefix(words("title")).alias("word")), f.select("path", "file_name", prefix(words("file_name")).alias("word"))
    alike = p_words.join(f_words, "word").select("paper", "path", "title", "file_name").distinct().select("paper", "path", X.title_similarity("title", "file_name").alias("similarity"))
    scored = exact.unionByName(ids).unionByName(by_doi).unionByName(alike).where(F.col("similarity") >= least)
    return scored.groupBy("paper").agg(F.max_by(F.struct("path", "similarity"), F.struct("similarity", F.length("path"), "path")).alias("b")).select("paper", "b.path", "b.similarity")


_PAGES = "doc_id string, page int, text string, error string"


def extract_pages(files: DataFrame, extractors: list[Callable[[bytes], list[str]]], least_chars: int = 20) -> DataFrame:
    """Pages of binary files (path, content) by the first extractor that yields enough text.

    An encrypted file ends the chain. Where none succeeds there is one row with the error.
    """
    ship(files.sparkSession)

    def one(content: bytes) -> tuple[list[str], str | None]:
        error = "empty_text"
        for extract in extractors:
            try:
                pages = extract(content)
            except Exception as e:  # extractors raise anything on broken files; the row keeps the message
                error = str(e) or type(e).__name__
                if "encrypted" in error.lower() or "password" in error.lower():
                    break
                continue
            if sum(len(p.strip()) for p in pages) >= least_chars:
                return pages, None
        return [], error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                pages, error = one(content)
                rows += [(path, k + 1, t, None) for k, t in enumerate(pages)] or [(path, None, None, error)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, _PAGES)


def failures(pages: DataFrame) -> DataFrame:
    """Documents whose extraction failed, with the class of the failure."""
    e = F.col("error")
    return pages.where(e.isNotNull()).select("doc_id", F.when(e == "empty_text", "empty_text").otherwise(extract_failure(e)).alias("error_type"))


def extraction_outcome(files: DataFrame, attempts: DataFrame) -> DataFrame:
    """How the extraction of each file (doc_id, exists) ended: the extractor that succeeded, or the class of the failure.

    ``attempts``: doc_id, ord, extractor, opened, chars, pages_with_text, image_pages, error.
    They count in order up to the first success, or to an encrypted file at the first one.
    """
    good = (F.col("chars") >= 20) & (F.col("pages_with_text") > 0) & F.col("error").isNull()
    kind = extract_failure(F.col("error"))
    locked = (F.col("ord") == 0) & F.col("error").isNotNull() & (kind == "pdf_encrypted")
    ended = F.min(F.when(good | locked, F.col("ord"))).over(Window.partitionBy("doc_id"))
    tried = attempts.withColumn("last", ended).where(F.col("last").isNull() | (F.col("ord") <= F.col("last")))
    said = F.array_sort(F.collect_list(F.when(F.trim(F.coalesce("error", F.lit(""))) != "", F.struct("ord", F.concat("extractor", F.lit(": "), F.trim("error")).alias("m")))))
    ends = tried.groupBy("doc_id").agg(
        F.min_by(F.when(good, F.col("extractor")), F.when(good, F.col("ord"))).alias("extractor"), F.max(locked).alias("locked"), F.max("opened").alias("opened"),
        F.max(F.col("opened") & (F.col("image_pages") > 0)).alias("scanned"), F.count("*").alias("attempts"), F.array_join(F.transform(said, lambda x: x["m"]), "；").alias("errors"),
    )
    failure = (
        F.when(~F.col("exists"), "pdf_file_missing").when(F.col("extractor").isNotNull(), F.lit(None)).when(F.col("locked"), "pdf_encrypted")
        .when(F.col("opened") & F.col("scanned"), "likely_scanned_pdf").when(F.col("opened"), "empty_text_pdf").otherwise("pdf_parse_failed")
    )
    return files.join(ends, "doc_id", "left").select("doc_id", failure.alias("error_type"), F.when(F.col("exists"), F.col("extractor")).alias("extractor"), F.when(F.col("exists"), F.col("attempts")).alias("attempts"), F.when(failure == "pdf_parse_failed", F.col("errors")).alias("error"))


# Seconds to wait after each refusal for too many requests.
WAITS = (3, 8, 15, 30, 45)


def with_retries(fetch: Callable[[str], tuple[int, str, bytes]], waits: tuple[float, ...] = WAITS, pause: float = 3) -> Callable[[str], tuple[int, str, bytes]]:
    """``fetch`` (url to status, content type and bytes), tried once for each of ``waits``.

    Status 429 waits its turn of ``waits``, an exception waits ``pause``, any other failure is
    tried again at once; the last answer or exception stands.
    """

    def tried(url: str) -> tuple[int, str, bytes]:
        for k, wait in enumerate(waits):
            last = k == len(waits) - 1
            try:
                answer = fetch(url)
            except Exception:  # whatever a client raises
                if last:
                    raise
                time.sleep(pause)
                continue
            if answer[0] == 200 or last:
                return answer
            if answer[0] == 429:
                time.sleep(wait)
        raise ValueError("waits must not be empty")

    return tried


def download(plan: DataFrame, fetch: Callable[[str], tuple[int, str, bytes]]) -> DataFrame:
    """The first PDF of each paper of a plan (paper, url, place): paper, url, content, error.

    URLs are tried in order of ``place``. What is served as HTML, or does not begin like a PDF, is
    passed over. A paper without any success has the last error and no content. Each paper is
    one small group, so fetches run side by side and a lost task repeats its own papers only.
    """
    ship(plan.sparkSession)
    kind = plan.schema["paper"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        paper, error = rows["paper"].iloc[0], "no_url"
        for url in rows.sort_values("place")["url"]:
            try:
                status, content_type, content = fetch(url)
            except Exception as e:  # a client may raise anything; the row says so
                error = str(e) or type(e).__name__
                continue
            if status != 200:
                error = f"status {status}"
            elif "html" in (content_type or "").lower() or not content.startswith(b"%PDF"):
                error = "downloaded_non_pdf"
            else:
                return pd.DataFrame([(paper, url, content, None)], columns=["paper", "url", "content", "error"])
        return pd.DataFrame([(paper, None, None, error)], columns=["paper", "url", "content", "error"])

    return plan.select("paper", "url", "place").groupBy("paper").applyInPandas(run, f"paper {kind}, url string, content binary, error string")
