"""Citation contexts: scores, the best one of a paper, attachment to papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import once
from .ordering import with_position


def score_contexts(contexts: DataFrame, text: str, title: str, doi: str = "", year: int | None = None, venue: str = "") -> DataFrame:
    """``contexts`` with score, confidence and hit counts for the target they cite."""
    terms = X.terms_of(contexts.sparkSession, title, doi, year, venue)
    rows = once(contexts, _normal=X.norm_ctx(text)).withColumn("_terms", terms)
    found = once(rows, **X.context_parts(F.col("_normal"), F.col("_terms"))).drop("_normal", "_terms")
    return found.withColumn("score", X.context_score()).withColumn("confidence", X.confidence_of(F.col("score")))


def usable() -> Column:
    """Contexts worth keeping: a score of 2, a DOI, a phrase or two keywords."""
    return (F.col("score") >= 2) | F.col("mentions_doi") | (F.col("phrase_hits") > 0) | (F.col("keyword_hits") >= 2)


def best_context(contexts: DataFrame, paper: str) -> DataFrame:
    """The first of the highest scored contexts of each paper."""
    return contexts.groupBy(paper).agg(F.count("*").alias("context_count"), F.max_by(F.struct("ord", "score", "confidence"), F.struct("score", -F.col("ord"))).alias("best")).select(paper, "context_count", "best.*")


def attach(papers: DataFrame, contexts: DataFrame, columns: list[str]) -> DataFrame:
    """Left join on the normalised title; of contexts with one title the first counts."""
    place = F.row_number().over(Window.partitionBy("title_key").orderBy("rank"))
    first = contexts.withColumn("title_key", X.title_key("citing_title")).where("title_key <> ''").withColumn("place", place).where("place = 1").select("title_key", *columns)
    return papers.withColumn("title_key", X.title_key("title")).join(first, "title_key", "left").drop("title_key")


def reorder(papers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Positions by context signal: score, confidence, rank; then papers without contexts.

    Of contexts with one title the last counts.
    """
    last = contexts.withColumn("title_key", X.title_key("citing_title")).where("title_key <> ''").groupBy("title_key").agg(
        F.max_by(F.struct("score", "confidence", "rank"), "rank").alias("c")
    )
    trust = F.coalesce(F.element_at(F.create_map(F.lit("high"), F.lit(2), F.lit("medium"), F.lit(1), F.lit("low"), F.lit(0)), F.col("c.confidence")), F.lit(0))
    joined = papers.withColumn("title_key", X.title_key("title")).join(last, "title_key", "left")
    found = F.col("c").isNotNull()
    joined = joined.select("*", (~found).alias("_none"), F.when(found, -F.col("c.score")).otherwise(0).alias("_score"), F.when(found, -trust).otherwise(0).alias("_trust"), F.coalesce("c.rank", "ord").alias("_rank"))
    order = ["_none", "_score", "_trust", "_rank", "ord"]
    return with_position(joined, [F.col(c) for c in order]).drop("title_key", "c", *order[:-1])


def fallback_contexts(papers: DataFrame, contexts: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` distinct contexts of each paper by exact lower-case title."""
    key = lambda c: F.lower(F.trim(c))
    once = contexts.select(key(F.col("citing_title")).alias("key"), "text", "rank").groupBy("key", "text").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("rank", "text"))
    kept = once.withColumn("place", place).where(F.col("place") <= k)
    return papers.select("ord", key(F.col("title")).alias("key")).join(kept, "key").select("ord", "place", "text")


def filtered_contexts(papers: DataFrame, contexts: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` usable contexts of each paper (ord, title), the best one first, each wording once.

    ``contexts``: citing_title, rank, is_best and text with the columns of ``score_contexts``. They
    meet on the lower-case title.
    """
    key = lambda c: F.lower(F.trim(c))
    good = contexts.where(usable()).select(key(F.col("citing_title")).alias("key"), X.norm_span("text").alias("wording"), F.struct((~F.col("is_best")).alias("later"), "rank", "text").alias("x")).where("wording <> ''")
    once = good.groupBy("key", "wording").agg(F.min("x").alias("x"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("x"))
    kept = once.withColumn("place", place).where(F.col("place") <= k)
    return papers.select("ord", key(F.col("title")).alias("key")).join(kept, "key").select("ord", "place", F.col("x.text").alias("text"))


def top_citing(contexts: DataFrame, paper: str, k: int = 20) -> DataFrame:
    """The ``k`` citing papers with the highest best context, in order of score, then of appearance."""
    return best_context(contexts, paper).orderBy(F.col("score").desc(), paper).limit(k)
