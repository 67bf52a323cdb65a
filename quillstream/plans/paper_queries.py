"""Queries over citing papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as X
from ..operators import papers as P
from ..operators import similarity as J

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


KEY_SQL = "coalesce(nullif(corpus_id, ''), nullif(doi, ''), nullif(arxiv_id, ''), nullif(lower(trim(title)), ''))"
DEDUPED_SQL = f"""deduped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY ord) AS place FROM papers WHERE {KEY_SQL} IS NOT NULL) WHERE place = 1)"""
_NV = "trim(regexp_replace(lower(replace({0}, '&', ' and ')), '[^a-z0-9一-鿿]+', ' ', 'g'))"
_NOISE = "['proceedings', 'proc', 'the', 'of', 'and', 'for', 'in', 'on', 'at', 'from', 'with', 'to', 'a', 'an', 'annual']"
MATCHED_SQL = f"""pairs AS (
  SELECT v.venue_name, r.*, {_NV.format('r.alias')} AS an, {_NV.format('v.venue_name')} AS vn
  FROM (SELECT DISTINCT trim(venue) AS venue_name FROM deduped WHERE trim(venue) <> '') v CROSS JOIN registry r
), worded AS (
  SELECT *, list_filter(string_split(an, ' '), lambda w: w <> '') AS aall, list_filter(string_split(vn, ' '), lambda w: w <> '') AS vall FROM pairs
), distilled AS (
  SELECT *, list_filter(aall, lambda w: NOT list_contains({_NOISE}, w) AND NOT regexp_full_match(w, '[0-9]+(st|nd|rd|th)?')) AS a0,
            list_filter(vall, lambda w: NOT list_contains({_NOISE}, w) AND NOT regexp_full_match(w, '[0-9]+(st|nd|rd|th)?')) AS v0 FROM worded
), lists AS (
  SELECT *, list_distinct(CASE WHEN len(a0) > 0 THEN a0 ELSE aall END) AS aw, CASE WHEN len(v0) > 0 THEN v0 ELSE vall END AS vw FROM distilled
), scored AS (
  SELECT *, CASE WHEN an = '' OR vn = '' THEN NULL WHEN an = vn THEN 500 + length(an)
    WHEN replace(an, ' ', '') = replace(vn, ' ', '') THEN 450 + length(an)
    WHEN len(aw) >= 2 AND list_has_all(vw, aw) THEN 300 + 10 * len(aw) + length(an)
    WHEN len(vw) >= 2 AND list_has_all(aw, vw) THEN 220 + 8 * len(vw) + length(an) END AS score FROM lists
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue_name ORDER BY score DESC, ord, alias_ord) AS place FROM scored WHERE score IS NOT NULL) WHERE place = 1
), matched AS (
  SELECT d.ord, d.title, d.year, d.venue, d.confidence, coalesce(b.tier, 'Unmatched') AS tier, coalesce(b.name, '') AS canonical, coalesce(b.alias, '') AS matched_alias, CAST(coalesce(b.score, 0) AS INTEGER) AS match_score
  FROM deduped d LEFT JOIN best b ON trim(d.venue) = b.venue_name)"""
BASE_SQL = f"WITH {A.PAPERS_SQL}, {DEDUPED_SQL}, {A.VENUE_REGISTRY_SQL}, {MATCHED_SQL} "


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.match_venues(P.dedupe(A.papers(spark, sf_dir)), A.venue_registry(spark))


@query(BASE_SQL + """SELECT t.tier_ord, t.tier, coalesce(n, 0) AS paper_count, year_min, year_max
FROM (VALUES (0, 'Top'), (1, 'CCF-A'), (2, 'CCF-B'), (3, 'CCF-C'), (4, 'Unmatched')) t(tier_ord, tier)
LEFT JOIN (SELECT tier, count(*) AS n, min(year) AS year_min, max(year) AS year_max FROM matched GROUP BY tier) m USING (tier)""")
def venue_tier_profile(spark, sf_dir):
    return P.tier_profile(matched(spark, sf_dir))


@query(BASE_SQL + "SELECT ord, venue, tier, canonical, matched_alias, match_score FROM matched")
def venue_match(spark, sf_dir):
    return matched(spark, sf_dir).select("ord", "venue", "tier", "canonical", "matched_alias", "match_score")


@query(BASE_SQL + """SELECT coalesce(nullif(canonical, ''), nullif(venue, ''), 'Unknown Venue') AS venue_label, count(*) AS paper_count, min(ord) AS first_ord, arg_min(tier, ord) AS tier
FROM matched GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 5""")
def top_venues(spark, sf_dir):
    return P.top_venues(matched(spark, sf_dir))


@query(BASE_SQL + """SELECT count(*) AS paper_count, count(*) FILTER (canonical <> '') AS matched_count, count(*) FILTER (canonical = '') AS unmatched_count,
count(*) FILTER (tier IN ('Top', 'CCF-A')) AS top_tier_count, min(year) AS year_min, max(year) AS year_max FROM matched""")
def publication_stats(spark, sf_dir):
    return P.publication_stats(matched(spark, sf_dir))


@query(f"WITH {A.PAPERS_SQL}, {DEDUPED_SQL} SELECT {KEY_SQL} AS key, ord, title, year FROM deduped")
def dedupe_first_key(spark, sf_dir):
    return P.dedupe(A.papers(spark, sf_dir)).select("key", "ord", "title", "year")


@query(f"WITH {A.PAPERS_SQL}, {DEDUPED_SQL} SELECT ord, title, year FROM deduped ORDER BY year DESC NULLS LAST, lower(title), ord LIMIT 100")
def sort_recent_topk(spark, sf_dir):
    return P.top_papers(P.dedupe(A.papers(spark, sf_dir)), 100).select("ord", "title", "year")


@query(f"""WITH {A.PAPERS_SQL}, {DEDUPED_SQL}
SELECT 'oldest' AS sort, ord, title, year FROM (SELECT * FROM deduped ORDER BY year ASC NULLS LAST, title, ord LIMIT 50)
UNION ALL SELECT 'title', ord, title, year FROM (SELECT * FROM deduped ORDER BY lower(title), year ASC NULLS LAST, ord LIMIT 50)""")
def sort_other_topk(spark, sf_dir):
    papers = P.dedupe(A.papers(spark, sf_dir))
    one = lambda s: P.top_papers(papers, 50, s).select(F.lit(s).alias("sort"), "ord", "title", "year")
    return one("oldest").unionByName(one("title"))


@query(f"WITH {A.PAPERS_SQL} SELECT year, ord, title, venue FROM papers WHERE year IS NOT NULL ORDER BY year, ord LIMIT 1")
def first_citing(spark, sf_dir):
    return P.first_citing(A.papers(spark, sf_dir))


@query(f"WITH {A.PAPERS_SQL} SELECT year, count(*) AS n, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence IN ('high', 'medium')) AS confident, CASE WHEN count(*) >= 10 OR count(*) FILTER (confidence = 'high') >= 2 OR count(*) FILTER (confidence IN ('high', 'medium')) >= 4 THEN 'high' WHEN count(*) >= 5 OR count(*) FILTER (confidence IN ('high', 'medium')) >= 2 THEN 'medium' ELSE 'low' END AS impact_level FROM papers GROUP BY year")
def impact_level(spark, sf_dir):
    return P.impact_level(A.papers(spark, sf_dir), "year")


@query(f"WITH {A.PAPERS_SQL} SELECT count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (confidence IS NULL) AS unknown FROM papers")
def context_confidence_counts(spark, sf_dir):
    return P.confidence_counts(A.papers(spark, sf_dir))


@query(f"WITH {A.PAPERS_SQL} SELECT ord, CAST(2000 + ord % 25 AS INTEGER) AS session, printf('P%03d', row_number() OVER (PARTITION BY 2000 + ord % 25 ORDER BY ord)) AS id FROM papers")
def session_ids(spark, sf_dir):
    papers = A.papers(spark, sf_dir).withColumn("session", (2000 + F.col("ord") % 25).cast("int")).withColumn("position", F.col("ord"))
    return P.with_ids(papers, "session").select("ord", "session", "id")


_STATE_KEY = "coalesce('doi:' || nullif(lower(trim(doi)), ''), 'title:' || nullif(trim(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', ' ', 'g')), ''))"


@query(f"""WITH {A.PAPERS_SQL}, prior AS (SELECT {_STATE_KEY} AS key, arg_min(status, ord) AS status FROM (SELECT *, CASE ord % 3 WHEN 0 THEN 'local_available' WHEN 1 THEN 'manual_required' ELSE 'auto_downloadable' END AS status FROM (SELECT * REPLACE (CASE WHEN ord % 2 = 0 THEN doi ELSE '10.9/' || ord END AS doi) FROM papers)) WHERE {_STATE_KEY} IS NOT NULL GROUP BY 1)
SELECT p.ord, coalesce(prior.status, 'not_probed') AS status FROM (SELECT *, {_STATE_KEY} AS key FROM papers) p LEFT JOIN prior USING (key)""")
def state_carry_over(spark, sf_dir):
    papers = A.papers(spark, sf_dir)
    doi = F.when(F.col("ord") % 2 == 0, F.col("doi")).otherwise(F.concat(F.lit("10.9/"), F.col("ord").cast("string")))  # some are not known any more
    old = papers.withColumn("doi", doi).withColumn("status", A.pick(["local_available", "manual_required", "auto_downloadable"], F.col("ord") % 3))
    new = papers.withColumn("status", F.lit("not_probed"))
    return P.carry_over(new, old, ["status"]).select("ord", "status")


@query(f"""WITH {A.PAPERS_SQL}, q AS (SELECT ord, list_filter([trim(coalesce(doi, '')), trim(coalesce(arxiv_id, '')), trim(coalesce(title, ''))], lambda x: x <> '') AS raw FROM papers)
SELECT ord, CASE WHEN len(raw) = 0 THEN 'unknown' ELSE array_to_string(raw, '|') END AS download_query FROM q""")
def download_query_list(spark, sf_dir):
    return A.papers(spark, sf_dir).select("ord", F.array_join(P.download_queries(), "|").alias("download_query"))


_TM = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH {A.PAPERS_SQL}, p AS (SELECT ord, lower(trim(coalesce(doi, ''))) AS d, {_TM.format('title')} AS t FROM papers),
w AS (SELECT ord AS work, CASE WHEN ord % 6 = 1 THEN regexp_replace(lower('https://doi.org/' || coalesce(doi, '')), '^https://doi.org/', '') ELSE '' END AS wd, {_TM.format("CASE WHEN ord % 2 = 0 THEN 'On ' || ord || ' ' ELSE '' END || title || CASE WHEN ord % 5 = 0 THEN ' extended' ELSE '' END")} AS wt FROM papers),
u AS (SELECT ord, work, 1 AS how FROM p JOIN w ON d = wd AND d <> '' UNION ALL SELECT ord, work, 2 FROM p JOIN w ON t = wt AND t <> ''
  UNION ALL SELECT ord, work, 3 FROM p JOIN w ON length(t) >= 24 AND length(wt) >= 24 AND (contains(t, wt) OR contains(wt, t)))
SELECT ord, work, how FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY how, work) AS place FROM u) WHERE place = 1""")
def enrichment_match(spark, sf_dir):
    papers = A.papers(spark, sf_dir)
    works = papers.select(
        F.col("ord").alias("work"), F.when(F.col("ord") % 6 == 1, F.concat(F.lit("https://doi.org/"), F.coalesce("doi", F.lit("")))).otherwise("").alias("doi"),
        F.concat(F.when(F.col("ord") % 2 == 0, F.format_string("On %s ", F.col("ord").cast("string"))).otherwise(""), "title", F.when(F.col("ord") % 5 == 0, " extended").otherwise("")).alias("title"),
    )
    return P.same_work(papers, works)


_TK = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH b AS (SELECT item_id, {_TK.format("text")} AS k, list_distinct(list_filter(string_split({_TK.format("text")}, ' '), lambda w: w <> '')) AS words FROM benchmark),
x AS (SELECT item_id, k, words, unnest(words) AS word FROM b), s AS (SELECT a.item_id, c.item_id AS other, count(*) AS shared, any_value(len(a.words)) AS la, any_value(len(c.words)) AS lb, any_value(a.k = c.k) AS same FROM x a JOIN x c ON a.word = c.word AND a.item_id <> c.item_id GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN same THEN 1.0 ELSE CAST(shared AS DOUBLE) / greatest(la, lb) END AS similarity FROM s)
SELECT item_id, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, other) AS place FROM r) WHERE place = 1""")
def title_similarity_best(spark, sf_dir):
    items = A.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("title"))
    sets = items.select(F.col("item_id").alias("id"), F.array_distinct(X.tokens(X.title_key("title"))).alias("words"))
    return J.best_partner(sets).withColumnRenamed("id", "item_id")
