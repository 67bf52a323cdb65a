"""Relations that the citation-impact operators work on, derived from the driver tables.

None of the tables is bibliographic; these derivations are deterministic and have the same
definition in DuckDB SQL (``*_SQL``), so every query can be compared on whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import once, spread

VENUES = [
    "ICML",
    "IEEE International Conference on Software Maintenance and Evolution",
    "ICWE",
    "NeurIPS",
    "Workshop on Tiny Datasets",
    "Proceedings of the 31st ACM SIGSOFT International Symposium on Software Testing and Analysis",
    "Advances in Neural Information Processing Systems",
    "",
    "software testing & analysis",
]

#: ord, name, tier, aliases
VENUE_REGISTRY = [
    (1, "International Conference on Machine Learning", "Top", ["International Conference on Machine Learning", "ICML"]),
    (2, "Neural Information Processing Systems", "Top", ["Neural Information Processing Systems", "NeurIPS", "NIPS", "Advances in Neural Information Processing Systems"]),
    (3, "Software Maintenance and Evolution", "CCF-B", ["Software Maintenance and Evolution", "ICSME", "International Conference on Software Maintenance and Evolution"]),
    (4, "Web Engineering", "CCF-C", ["Web Engineering", "ICWE"]),
    (5, "Software Testing and Analysis", "CCF-A", ["Software Testing and Analysis", "ISSTA", "International Symposium on Software Testing and Analysis"]),
]

AUTHORS = ["Grace Hopper", "Alan Turing", "Andrew Chi-Chih Yao", "John Smith", "Katz, Randy H.", "Dean, Jeffrey A", "姚期智", "Randy Howard Katz", "Jeffrey Dean", "Barbara J. Liskov", "Liskov, Barbara", "Jane Doe"]

#: name, aliases, affiliation tokens, tag_type, source_link, note
PERSON_REGISTRY = [
    ("Grace Hopper", [], [], "ieee_fellow", "https://example.org/a", "n1"),
    ("Yao, Andrew Chi-Chih", ["Andrew Chi-Chih Yao", "姚期智"], ["tsinghua"], "acm_fellow", "https://example.org/b", ""),
    ("Randy H. Katz", [], ["berkeley"], "acm_fellow", "", ""),
    ("Jeffrey Dean", [], [], "acm_fellow", "https://example.org/d", "n4"),
    ("Barbara Liskov", ["Barbara J. Liskov"], ["mit"], "ieee_fellow", "https://example.org/e", ""),
    ("John Smith", [], [], "cas_academician", "", ""),
]

#: raw affiliations and the registry (ord, name, aliases), first match wins
AFFILIATIONS = ["MIT Computer Science and Artificial Intelligence Laboratory", "Smith College", "Tsinghua University, Beijing", "University of California, Berkeley", "Carnegie Mellon University (CMU)", "ETH Zürich", "Summit Institute", "Dept. of EECS, M.I.T."]
INSTITUTIONS = [
    (1, "Massachusetts Institute of Technology", ["MIT"]),
    (2, "Carnegie Mellon University", ["CMU"]),
    (3, "University of California, Berkeley", ["UC Berkeley", "Berkeley"]),
    (4, "Tsinghua University", []),
    (5, "ETH Zurich", ["ETH"]),
]


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], number: Column) -> Column:
    """The value whose position (from 0) is ``number``."""
    return F.element_at(F.array(*map(F.lit, values)), (number + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citing papers: one row per document."""
    d = F.col("doc_id")
    digits = lambda x: x.cast("string")
    return table(spark, sf_dir, "documents").select(
        d.alias("ord"),
        F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1).alias("title"),
        F.when(d % 17 != 0, 2000 + d % 25).cast("int").alias("year"),
        pick(VENUES, d % 9).alias("venue"),
        F.when(d % 4 == 0, F.concat(F.lit("C"), digits(d % 300))).alias("corpus_id"),
        F.when(d % 3 != 0, F.concat(F.lit("10.1000/"), digits(d % 400))).alias("doi"),
        F.when(d % 5 == 0, F.concat(F.lit("A"), digits(d % 250))).alias("arxiv_id"),
        F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit(None).cast("string")), (d % 4 + 1).cast("int")).alias("confidence"),
    )


PAPERS_SQL = f"""papers AS (
  SELECT doc_id AS ord, split_part(coalesce(text, ''), chr(10), 1) AS title,
         CAST(CASE WHEN doc_id % 17 <> 0 THEN 2000 + doc_id % 25 END AS INTEGER) AS year,
         ({_quoted(VENUES)})[CAST(doc_id % 9 AS INTEGER) + 1] AS venue,
         CASE WHEN doc_id % 4 = 0 THEN 'C' || (doc_id % 300) END AS corpus_id,
         CASE WHEN doc_id % 3 <> 0 THEN '10.1000/' || (doc_id % 400) END AS doi,
         CASE WHEN doc_id % 5 = 0 THEN 'A' || (doc_id % 250) END AS arxiv_id,
         (['high', 'medium', 'low', NULL])[CAST(doc_id % 4 AS INTEGER) + 1] AS confidence
  FROM documents)"""


def venue_registry(spark: SparkSession) -> DataFrame:
    """One row per alias, in registry order."""
    rows = [(k, a, name, tier, alias) for k, name, tier, aliases in VENUE_REGISTRY for a, alias in enumerate(aliases)]
    return spark.createDataFrame(rows, "ord int, alias_ord int, name string, tier string, alias string")


VENUE_REGISTRY_SQL = (
    "registry(ord, alias_ord, name, tier, alias) AS (VALUES "
    + ", ".join(f"({k}, {a}, '{name}', '{tier}', '{alias}')" for k, name, tier, aliases in VENUE_REGISTRY for a, alias in enumerate(aliases))
    + ")"
)


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as paragraphs: doc_id, seq (from 1), text."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    texts = F.transform(lines, lambda line: F.trim(F.regexp_replace(line, "[ \t]+", " ")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(texts).alias("pos", "text"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("seq"), "text").where("text <> ''")


PARAGRAPHS_SQL = r"""paragraphs AS (
  SELECT doc_id, seq, text FROM (
    SELECT doc_id, CAST(generate_subscripts(lines, 1) AS INTEGER) AS seq, trim(regexp_replace(unnest(lines), '[ \t]+', ' ', 'g'), ' ') AS text
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
  WHERE text <> '')"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with citation markers appended by position."""
    k = F.col("doc_id") * 7 + F.col("seq")
    number = lambda m, plus=1: (k % m + plus).cast("string")
    mark = (
        F.when(k % 5 == 0, F.concat(F.lit(" ["), number(23), F.lit("]")))
        .when(k % 5 == 1, F.concat(F.lit(" ["), number(11), F.lit(", "), number(23), F.lit("]")))
        .when(k % 5 == 2, F.concat(F.lit(" ("), number(13), F.lit("-"), number(13, 6), F.lit(")")))
        .when(k % 5 == 3, F.concat(F.lit(" doi: 10.1000/x"), number(23), F.lit(" vol. 3 2001 2002 ["), number(9), F.lit("]")))
        .otherwise("")
    )
    lead = F.when(k % 7 == 0, F.concat(F.lit("["), number(23), F.lit("] "))).when(k % 7 == 1, F.concat(number(23), F.lit(". "))).otherwise("")
    return once(paragraphs(spark, sf_dir), text=F.concat(lead, "text", mark))


MARKED_SQL = PARAGRAPHS_SQL + r""", marked AS (
  SELECT doc_id, seq,
    CASE WHEN k % 7 = 0 THEN '[' || (k % 23 + 1) || '] ' WHEN k % 7 = 1 THEN (k % 23 + 1) || '. ' ELSE '' END || text ||
    CASE k % 5 WHEN 0 THEN ' [' || (k % 23 + 1) || ']' WHEN 1 THEN ' [' || (k % 11 + 1) || ', ' || (k % 23 + 1) || ']'
      WHEN 2 THEN ' (' || (k % 13 + 1) || '-' || (k % 13 + 6) || ')'
      WHEN 3 THEN ' doi: 10.1000/x' || (k % 23 + 1) || ' vol. 3 2001 2002 [' || (k % 9 + 1) || ']' ELSE '' END AS text
  FROM (SELECT *, doc_id * 7 + seq AS k FROM paragraphs))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents: order, seq, whether it is a hit, of which kind, score."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq")).agg(
        (F.max("l_returnflag") == "R").alias("hit"), (F.max("l_linestatus") == "O").alias("exact"), F.max(F.col("l_quantity").cast("int")).alias("score"), F.count("*").cast("int").alias("copies")
    )


LINES_SQL = """lines AS (
  SELECT l_orderkey AS doc, l_linenumber AS seq, max(l_returnflag) = 'R' AS hit, max(l_linestatus) = 'O' AS exact,
         max(CAST(trunc(l_quantity) AS INTEGER)) AS score, CAST(count(*) AS INTEGER) AS copies
  FROM lineitem GROUP BY 1, 2)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about papers: several rows per labelled document."""
    n = F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))).alias("ord")
    k = F.col("doc_id") + 3 * F.col("ord")
    return table(spark, sf_dir, "labels").select("doc_id", "quality", n).select(
        "doc_id", "ord", (k % 5 + 1).cast("int").alias("page"), (k % 3 + F.col("ord")).cast("int").alias("span_index"),
        pick(["background", "baseline", "application", "extension", "comparison", "", "other"], k % 7).alias("aspect"),
        pick(["explicit_citation", "grouped_literature_mention", "weak_body_mention", "", "explicit_citation"], k % 5).alias("mention_type"),
        pick(["positive", "neutral", "negative", "odd"], k % 4).alias("stance"),
        pick(["true", "false", "yes", "否", "maybe"], k % 5).alias("keep_text"),
        pick(["0.9", "1.7", "-3", "x", "0.25"], k % 5).alias("confidence_text"),
        pick(["as shown in [3, 4]", "for the first time here", "plain words", "see [7]"], k % 4).alias("citation_text"),
    )


FINDINGS_SQL = f"""findings AS (
  SELECT doc_id, ord, CAST(k % 5 + 1 AS INTEGER) AS page, CAST(k % 3 + ord AS INTEGER) AS span_index,
    ({_quoted(["background", "baseline", "application", "extension", "comparison", "", "other"])})[CAST(k % 7 AS INTEGER) + 1] AS aspect,
    ({_quoted(["explicit_citation", "grouped_literature_mention", "weak_body_mention", "", "explicit_citation"])})[CAST(k % 5 AS INTEGER) + 1] AS mention_type,
    ({_quoted(["positive", "neutral", "negative", "odd"])})[CAST(k % 4 AS INTEGER) + 1] AS stance,
    ({_quoted(["true", "false", "yes", "否", "maybe"])})[CAST(k % 5 AS INTEGER) + 1] AS keep_text,
    ({_quoted(["0.9", "1.7", "-3", "x", "0.25"])})[CAST(k % 5 AS INTEGER) + 1] AS confidence_text,
    ({_quoted(["as shown in [3, 4]", "for the first time here", "plain words", "see [7]"])})[CAST(k % 4 AS INTEGER) + 1] AS citation_text
  FROM (SELECT doc_id, quality, ord, doc_id + 3 * ord AS k FROM (SELECT doc_id, quality, CAST(unnest(generate_series(0, doc_id % 4)) AS INTEGER) AS ord FROM labels)))"""


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of papers with one affiliation each: three rows per document."""
    k = F.col("doc_id") * 5 + F.col("author_ord") * 7
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("author_ord")).select(
        F.col("doc_id").alias("paper"), "author_ord", pick(AUTHORS, k % len(AUTHORS)).alias("author"), pick(AFFILIATIONS, (k + F.col("doc_id")) % len(AFFILIATIONS)).alias("affiliation")
    )


AUTHORS_SQL = f"""authors AS (
  SELECT doc_id AS paper, author_ord, ({_quoted(AUTHORS)})[CAST(k % {len(AUTHORS)} AS INTEGER) + 1] AS author,
         ({_quoted(AFFILIATIONS)})[CAST((k + doc_id) % {len(AFFILIATIONS)} AS INTEGER) + 1] AS affiliation
  FROM (SELECT doc_id, author_ord, doc_id * 5 + author_ord * 7 AS k FROM (SELECT doc_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS author_ord FROM documents)))"""


_KINDS = ["citation_index_exact", "context_similarity", "citation_index_grouped", "keyword_fallback", "citation_index_neighbor"]


def spans(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The ``k`` top spans of each labelled document, made of its paragraphs."""
    n = F.col("doc_id") * 7 + F.col("seq")
    rows = paragraphs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", (F.floor((F.col("seq") - 1) / 6) + 1).cast("int").alias("page"), ((F.col("seq") - 1) % 6).cast("int").alias("span_index"), pick(_KINDS, n % 5).alias("match_type"),
        (n % 37).cast("int").alias("score"), F.when(n % 4 == 0, (n % 23 + 1).cast("string")).alias("citation_index"), F.when(n % 2 == 0, F.array(pick(_KINDS, n % 5), F.lit("context_similarity"))).otherwise(F.array(pick(_KINDS, n % 5))).alias("evidence"),
        F.when(n % 3 == 0, F.array(F.lit("widget"))).otherwise(F.array().cast("array<string>")).alias("keyword_hits"), "text", F.when(n % 2 == 0, F.concat("text", F.lit(" | "), "text")).otherwise("").alias("window_text"),
    )
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "page", "span_index"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


SPANS_SQL = PARAGRAPHS_SQL + f""", spans0 AS (SELECT doc_id, CAST((seq - 1) // 6 + 1 AS INTEGER) AS page, CAST((seq - 1) % 6 AS INTEGER) AS span_index, ({_quoted(_KINDS)})[CAST(n % 5 AS INTEGER) + 1] AS match_type,
    CAST(n % 37 AS INTEGER) AS score, CASE WHEN n % 4 = 0 THEN CAST(n % 23 + 1 AS VARCHAR) END AS citation_index,
    CASE WHEN n % 2 = 0 THEN [({_quoted(_KINDS)})[CAST(n % 5 AS INTEGER) + 1], 'context_similarity'] ELSE [({_quoted(_KINDS)})[CAST(n % 5 AS INTEGER) + 1]] END AS evidence,
    CASE WHEN n % 3 = 0 THEN ['widget'] ELSE CAST([] AS VARCHAR[]) END AS keyword_hits, text, CASE WHEN n % 2 = 0 THEN text || ' | ' || text ELSE '' END AS window_text
  FROM (SELECT *, doc_id * 7 + seq AS n FROM paragraphs WHERE doc_id IN (SELECT doc_id FROM labels))),
spans AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page, span_index) AS place FROM spans0 QUALIFY place <= 20)"""
