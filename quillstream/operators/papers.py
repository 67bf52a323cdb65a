"""Citing papers: deduplication, order, identity, venues and their statistics.

"First" always means smallest ``ord``; it is resolved by windows or min_by, never by first().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import checkpointed
from .containment import numbered, pieces

TIERS = ["Top", "CCF-A", "CCF-B", "CCF-C", "Unmatched"]


def non_empty(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def identity_key() -> Column:
    """First non-empty of the ids and the title; keys of different kinds are not told apart."""
    return F.coalesce(non_empty("corpus_id"), non_empty("doi"), non_empty("arxiv_id"), F.nullif(F.lower(F.trim("title")), F.lit("")))


def first_per_key(papers: DataFrame, key: Column) -> DataFrame:
    """The first row of each key; rows without a key go."""
    keyed = papers.withColumn("key", key).where(F.col("key").isNotNull())
    place = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    return keyed.withColumn("place", place).where("place = 1").drop("place")


def dedupe(papers: DataFrame) -> DataFrame:
    return first_per_key(papers, identity_key())


def order_by(sort: str = "recent") -> list[Column]:
    """Sort orders; missing years come last, ties keep the incoming order."""
    if sort == "oldest":
        return [F.col("year").asc_nulls_last(), F.col("title"), F.col("ord")]
    if sort == "title":
        return [F.lower("title"), F.col("year").asc_nulls_last(), F.col("ord")]
    return [F.col("year").desc_nulls_last(), F.lower("title"), F.col("ord")]


def fetch_size(limit: int, most: int = 10_000) -> int:
    """How many rows to fetch so that ``limit`` remain after deduplication."""
    return max(limit, min(max(5 * limit, 100), most))


def top_papers(papers: DataFrame, limit: int, sort: str = "recent") -> DataFrame:
    return papers.orderBy(*order_by(sort)).limit(limit)


def with_ids(papers: DataFrame, session: str) -> DataFrame:
    """Stable ids P001, P002, ... in each session's order (column ``position``)."""
    return papers.withColumn("id", F.format_string("P%03d", F.row_number().over(Window.partitionBy(session).orderBy("position"))))


def carry_over(current: DataFrame, prior: DataFrame, state: list[str]) -> DataFrame:
    """State of the first prior paper with the same DOI (else title), by column; else as found."""
    key = F.coalesce(F.concat(F.lit("doi:"), F.nullif(F.lower(F.trim("doi")), F.lit(""))), F.concat(F.lit("title:"), F.nullif(X.norm_ref("title"), F.lit(""))))
    before = first_per_key(prior, key).select("key", *(F.col(c).alias(f"prior_{c}") for c in state))
    joined = current.withColumn("key", key).join(before, "key", "left")
    return joined.select(*(c for c in current.columns if c not in state), *(F.coalesce(f"prior_{c}", c).alias(c) for c in state))


def match_venues(papers: DataFrame, registry: DataFrame) -> DataFrame:
    """The best registry entry of each paper's venue.

    Only distinct venues meet the registry, in an equality join: names that match are equal
    without spaces or share a word.
    """
    known = registry.select("ord", "alias_ord", "name", "tier", "alias")
    venue = F.trim("venue")
    keys = lambda c: F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("="), F.replace(X.norm_venue(c), F.lit(" ")))), X.venue_words(c)))).alias("key")
    venues = papers.select(venue.alias("venue_name")).where("venue_name <> ''").distinct()
    pairs = venues.select("venue_name", keys("venue_name")).join(known.select("*", keys("alias")), "key").drop("key").distinct()
    a, v = X.norm_venue("alias"), X.norm_venue("venue_name")
    aw, vw = F.array_distinct(X.venue_words("alias")), X.venue_words("venue_name")
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    score = (
        F.when((a == "") | (v == ""), None)
        .when(a == v, 500 + F.length(a))
        .when(F.replace(a, F.lit(" ")) == F.replace(v, F.lit(" ")), 450 + F.length(a))
        .when((F.size(aw) >= 2) & inside(aw, vw), 300 + 10 * F.size(aw) + F.length(a))
        .when((F.size(vw) >= 2) & inside(vw, aw), 220 + 8 * F.size(vw) + F.length(a))
    )
    best = Window.partitionBy("venue_name").orderBy(F.col("score").desc(), "registry_ord", "alias_ord")
    found = (
        pairs.select("venue_name", F.col("ord").alias("registry_ord"), "alias_ord", "name", F.col("tier"), "alias", score.alias("score"))
        .where(F.col("score").isNotNull())
        .withColumn("place", F.row_number().over(best))
        .where("place = 1")
        .select("venue_name", F.col("name").alias("canonical"), "tier", F.col("alias").alias("matched_alias"), "score")
    )
    joined = papers.withColumn("venue_name", venue).join(found, "venue_name", "left")
    return joined.select(*papers.columns, F.coalesce("tier", F.lit("Unmatched")).alias("tier"), F.coalesce("canonical", F.lit("")).alias("canonical"), F.coalesce("matched_alias", F.lit("")).alias("matched_alias"), F.coalesce("score", F.lit(0)).alias("match_score"))


def tier_profile(matched: DataFrame) -> DataFrame:
    """Papers of every tier in display order, empty tiers included, with the range of years."""
    spark = matched.sparkSession
    tiers = spark.createDataFrame(list(enumerate(TIERS)), "tier_ord int, tier string")
    found = matched.groupBy("tier").agg(F.count("*").alias("n"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    return F.broadcast(tiers).join(found, "tier", "left").select("tier_ord", "tier", F.coalesce("n", F.lit(0).cast("long")).alias("paper_count"), "year_min", "year_max")


def venue_label() -> Column:
    return F.coalesce(F.nullif("canonical", F.lit("")), F.nullif("venue", F.lit("")), F.lit("Unknown Venue"))


def top_venues(matched: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent venues; ties go to the one that appears first."""
    groups = matched.groupBy(venue_label().alias("venue_label")).agg(F.count("*").alias("paper_count"), F.min("ord").alias("first_ord"), F.min_by("tier", "ord").alias("tier"))
    return groups.orderBy(F.col("paper_count").desc(), "first_ord").limit(k)


def publication_stats(matched: DataFrame) -> DataFrame:
    """One row: counts of matched, unmatched and top-tier papers and the range of years."""
    return matched.agg(
        F.count("*").alias("paper_count"), F.count_if(F.col("canonical") != "").alias("matched_count"), F.count_if(F.col("canonical") == "").alias("unmatched_count"),
        F.count_if(F.col("tier").isin("Top", "CCF-A")).alias("top_tier_count"), F.min("year").alias("year_min"), F.max("year").alias("year_max"),
    )


def confidence_counts(papers: DataFrame) -> DataFrame:
    c = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("unknown"))
    return papers.agg(*(F.count_if(c == k).alias(k) for k in ("high", "medium", "low", "unknown")))


def impact_level(papers: DataFrame, *group: str) -> DataFrame:
    """high, medium or low by the number of papers and of confident contexts, per group."""
    counts = papers.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence").isin("high", "medium")).alias("confident"))
    level = F.when((F.col("n") >= 10) | (F.col("high") >= 2) | (F.col("confident") >= 4), "high").when((F.col("n") >= 5) | (F.col("confident") >= 2), "medium").otherwise("low")
    return counts.withColumn("impact_level", level)


def first_citing(papers: DataFrame) -> DataFrame:
    """The earliest paper that has a year."""
    row = F.min(F.struct("year", "ord", "title", "venue")).alias("r")
    return papers.where(F.col("year").isNotNull()).agg(row).select("r.*")


def download_queries() -> Column:
    """Distinct identifiers by which a paper may be found: DOI, preprint id, title; never empty."""
    raw = F.filter(F.array(*(F.trim(F.coalesce(c, F.lit(""))) for c in ("doi", "arxiv_id", "title"))), lambda x: x != "")
    once = F.filter(raw, lambda x, i: ~F.exists(F.slice(raw, 1, i), lambda y: F.lower(y) == F.lower(x)))
    return F.when(F.size(once) > 0, once).otherwise(F.array(F.lit("unknown")))


#: Least length of a compact title that is looked for inside another.
CONTAINED = 24


def same_work(papers: DataFrame, works: DataFrame) -> DataFrame:
    """Foreign works of papers: by DOI, else by equal title, else by a long title that contains it.

    Of the works with one DOI or title the first is taken, so papers never meet all of them. Only
    titles without an equal one are looked for inside others, each once, by ``containment``.
    ``works``: work, doi, title. Returns ord, work, how.
    """
    p = papers.select("ord", X.norm_doi("doi").alias("d"), X.title_match("title").alias("t"))
    w = works.select("work", X.norm_doi("doi").alias("wd"), X.title_match("title").alias("wt"))
    least = lambda c: w.where(F.col(c) != "").groupBy(c).agg(F.min("work").alias("work"))
    foreign = numbered(least("wt").withColumnRenamed("wt", "text"))
    by_doi = least("wd").select(F.col("wd").alias("d"), F.struct(F.lit(1).alias("how"), "work").alias("same_doi"))
    by_title = foreign.select(F.col("text").alias("t"), F.struct(F.lit(2).alias("how"), "work").alias("same_title"))
    met = p.join(by_doi, "d", "left").join(by_title, "t", "left").select("ord", "t", F.coalesce("same_doi", "same_title").alias("met"))
    met = checkpointed(met.where(F.col("met").isNotNull() | (F.length("t") >= CONTAINED)))
    rest = met.where(F.col("met").isNull()).select("ord", F.col("t").alias("text"))
    own, long = numbered(rest.select("text").distinct()), foreign.where(F.length("text") >= CONTAINED)
    around = pieces(own, long, CONTAINED, "id").join(long.select("digest", "work"), "digest").groupBy("id").agg(F.min("work").alias("work")).join(own, "id")
    within = pieces(long, own, CONTAINED, "work").groupBy("digest").agg(F.min("work").alias("work")).join(own, "digest")
    # of the works that hold a title or lie in it the first is enough
    first = around.select("text", "work").unionByName(within.select("text", "work")).groupBy("text").agg(F.min("work").alias("work"))
    inside = rest.join(first, "text").select("ord", F.lit(3).alias("how"), "work")
    found = met.where(F.col("met").isNotNull()).select("ord", "met.how", "met.work").unionByName(inside)
    return found.groupBy("ord").agg(F.min(F.struct("how", F.col("work").isNull().alias("none"), "work")).alias("best")).select("ord", "best.work", "best.how")


def first_by_authors(papers: DataFrame, authors: DataFrame, k: int = 3) -> DataFrame:
    """The earliest paper that has a year, with its first ``k`` authors (paper, author_ord, author) and a sign of more."""
    first = first_citing(papers)
    named = authors.join(F.broadcast(first.select(F.col("ord").alias("paper"))), "paper").groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("author_ord", "author"))).alias("a"))
    names = F.transform("a", lambda x: x["author"])
    shown = F.concat(F.array_join(F.slice(names, 1, k), ", "), F.when(F.size(names) > k, " 等").otherwise(""))
    return first.join(named.select(F.col("paper").alias("ord"), shown.alias("authors")), "ord", "left").withColumn("authors", F.coalesce("authors", F.lit("")))
