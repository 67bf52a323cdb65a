"""Queries over contexts, people and institutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as X
from ..operators import contexts as C
from ..operators import people as E

QUERIES, SQL = {}, {}
TITLE = "Learning the thention of onthen: A tishe, onble and erthly design study"
VENUE, YEAR, DOI = "International Journal of onthe thblest thereation", 2001, "10.1000/x1"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_CTX = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s\-]', ' ', 'g'), '\s+', ' ', 'g'))"
_KW = X.CONTEXT_KEYWORD_STOP
_quoted = A._quoted
_GRAM = "list_transform(CASE WHEN len(w) >= {n} THEN generate_series(1, len(w) - {m}) ELSE [] END, lambda i: array_to_string(list_slice(w, i, i + {m}), ' '))"
SCORED_SQL = f"""target AS (SELECT {_CTX.format("'" + TITLE + "'")} AS t, {_CTX.format("'" + VENUE + "'")} AS v, {_CTX.format("'" + DOI + "'")} AS d),
lists AS (
  SELECT list_filter(string_split(t, ' '), lambda w: length(w) >= 4 AND NOT list_contains({_quoted(_KW)}, w)) AS kw0,
         list_filter(string_split(t, ' '), lambda w: length(w) >= 3 AND NOT list_contains({_quoted(X.CONTEXT_PHRASE_STOP)}, w)) AS w,
         list_slice(list_filter(string_split(v, ' '), lambda w: length(w) >= 5 AND NOT list_contains({_quoted(X.CONTEXT_VENUE_STOP)}, w)), 1, 3) AS vt, d FROM target),
ordered AS (
  SELECT list_slice(list_filter(kw0, lambda x, i: list_position(kw0, x) = i), 1, 10) AS kw, vt, d,
         list_filter(list_concat({_GRAM.format(n=2, m=1)}, list_concat({_GRAM.format(n=3, m=2)}, {_GRAM.format(n=4, m=3)})), lambda p: length(p) >= 8) AS g FROM lists),
wanted AS (SELECT kw, vt, d, list_slice(list_filter(g, lambda x, i: list_position(g, x) = i), 1, 12) AS ph FROM ordered),
ctx AS (SELECT doc_id, seq, {_CTX.format('text')} AS c FROM marked),
hit AS (SELECT doc_id, seq, len(list_filter(kw, lambda x: contains(c, x))) AS k, len(list_filter(ph, lambda x: contains(c, x))) AS p, contains(c, d) AS doi, contains(c, '{YEAR}') AS yr,
  len(list_filter(vt, lambda x: contains(c, x))) > 0 AS vn FROM ctx, wanted),
scored AS (SELECT *, CAST(least(k, 5) + least(2 * p, 6) + CASE WHEN doi THEN 6 ELSE 0 END + CASE WHEN yr THEN 1 ELSE 0 END + CASE WHEN vn THEN 1 ELSE 0 END AS INTEGER) AS score FROM hit)"""
CTX_SQL = f"WITH {A.MARKED_SQL}, {SCORED_SQL} "


def scored(spark, sf_dir):
    return C.score_contexts(A.marked(spark, sf_dir), "text", TITLE, DOI, YEAR, VENUE)


@query(CTX_SQL + "SELECT doc_id, seq, CAST(k AS INTEGER) AS keyword_hits, CAST(p AS INTEGER) AS phrase_hits, doi AS mentions_doi, yr AS mentions_year, vn AS mentions_venue, score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM scored")
def context_score(spark, sf_dir):
    return scored(spark, sf_dir).drop("text")


@query(CTX_SQL + "SELECT doc_id, count(*) AS context_count, CAST(arg_max(seq, score * 1000000 - seq) AS INTEGER) AS ord, max(score) AS score, CASE WHEN max(score) >= 4 THEN 'high' WHEN max(score) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM scored GROUP BY doc_id")
def best_context(spark, sf_dir):
    return C.best_context(scored(spark, sf_dir).withColumnRenamed("seq", "ord"), "doc_id")


@query(CTX_SQL + "SELECT doc_id, count(*) AS n FROM scored WHERE score >= 2 OR doi OR p > 0 OR k >= 2 GROUP BY doc_id")
def usable_contexts(spark, sf_dir):
    return scored(spark, sf_dir).where(C.usable()).groupBy("doc_id").agg(F.count("*").alias("n"))


_KEY = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"
_RANKED = f"""ctx AS (SELECT rank, {_KEY} AS k, score, confidence FROM (SELECT ord AS rank, CASE WHEN ord % 3 = 0 THEN title ELSE 'Unseen ' || ord END AS title, CAST((ord * 7) % 13 AS INTEGER) AS score, coalesce(confidence, '') AS confidence FROM papers))"""


def ranked(spark, sf_dir):
    title = F.when(F.col("ord") % 3 == 0, F.col("title")).otherwise(F.concat(F.lit("Unseen "), F.col("ord").cast("string")))
    return A.papers(spark, sf_dir).select(F.col("ord").alias("rank"), title.alias("citing_title"), ((F.col("ord") * 7) % 13).cast("int").alias("score"), F.coalesce("confidence", F.lit("")).alias("confidence"))


@query(f"""WITH {A.PAPERS_SQL}, {_RANKED}, last AS (SELECT k, arg_max(score, rank) AS score, arg_max(CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END, rank) AS trust, max(rank) AS rank FROM ctx WHERE k <> '' GROUP BY k)
SELECT ord, CAST(row_number() OVER (ORDER BY last.k IS NULL, coalesce(-last.score, 0), coalesce(-trust, 0), coalesce(last.rank, ord), ord) AS INTEGER) AS position FROM (SELECT ord, {_KEY} AS k FROM papers) p LEFT JOIN last USING (k)""")
def reorder_by_context(spark, sf_dir):
    return C.reorder(A.papers(spark, sf_dir), ranked(spark, sf_dir)).select("ord", "position")


@query(f"""WITH {A.PAPERS_SQL}, {_RANKED}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank) AS place FROM ctx WHERE k <> '') WHERE place = 1)
SELECT ord, first.score AS score FROM (SELECT ord, {_KEY} AS k FROM papers) p LEFT JOIN first USING (k)""")
def context_attach(spark, sf_dir):
    return C.attach(A.papers(spark, sf_dir), ranked(spark, sf_dir), ["score"]).select("ord", "score")


@query(f"""WITH {A.PAPERS_SQL}, ctx AS (SELECT lower(trim(title)) AS k, 'c' || (ord % 11) AS text, min(ord) AS rank FROM papers GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY rank, text) AS INTEGER) AS place FROM ctx)
SELECT ord, place, text FROM (SELECT ord, lower(trim(title)) AS k FROM papers) JOIN r USING (k) WHERE place <= 5""")
def fallback_contexts(spark, sf_dir):
    papers = A.papers(spark, sf_dir)
    return C.fallback_contexts(papers, papers.select(F.col("title").alias("citing_title"), F.concat(F.lit("c"), (F.col("ord") % 11).cast("string")).alias("text"), F.col("ord").alias("rank")))


# people

_NAMES = f"known(author) AS (SELECT unnest({_quoted(sorted(set(A.AUTHORS)))}))"
_NN = "regexp_replace(lower({0}), '[^a-z0-9一-鿿]+', '', 'g')"
_PARTS = "regexp_extract_all({0}, '[A-Za-z0-9]+')"


def _variants(source: str, name: str) -> str:
    """CTE body: (name, variant) rows for a relation with a column n."""
    return f"""{name} AS (
  SELECT n, {_NN.format('n')} AS variant FROM {source}
  UNION SELECT n, lower(array_to_string(list_concat(g, f), '')) FROM ({{split}}) WHERE len(g) > 0 AND len(f) > 0
  UNION SELECT n, lower(array_to_string(list_concat(list_filter(g, lambda w: length(w) > 1), f), '')) FROM ({{split}}) WHERE len(list_filter(g, lambda w: length(w) > 1)) > 0 AND len(f) > 0
  UNION SELECT n, lower(g[1] || array_to_string(f, '')) FROM ({{split}}) WHERE len(g) > 0 AND len(f) > 0
  UNION SELECT n, lower(w[1] || w[-1]) FROM (SELECT n, {_PARTS.format('n')} AS w FROM {source} WHERE NOT regexp_matches(n, '[一-鿿]') AND NOT contains(n, ',')) WHERE len(w) >= 3
)""".replace("{split}", f"SELECT n, {_PARTS.format('split_part(n, {q},{q}, 1)')} AS f, {_PARTS.format('substring(n, strpos(n, {q},{q}) + 1)')} AS g FROM {source} WHERE contains(n, {{q}},{{q}}) AND NOT regexp_matches(n, '[一-鿿]')".replace("{q}", "'"))


_REG = "reg(name, aliases, affs, tag_type, source_link, note) AS (VALUES " + ", ".join(f"('{n}', CAST({_quoted(a)} AS VARCHAR[]), CAST({_quoted(f)} AS VARCHAR[]), '{t}', '{s}', '{note}')" for n, a, f, t, s, note in A.PERSON_REGISTRY) + ")"
MATCH_SQL = f"""WITH {A.AUTHORS_SQL}, names AS (SELECT DISTINCT author AS n FROM authors), {_variants('names', 'nv')}, {_REG},
rn AS (SELECT name, tag_type, unnest(list_concat([name], aliases)) AS n FROM reg), {_variants('rn', 'rv')},
meets AS (SELECT nv.n AS author, rn.name, rn.tag_type, min(nv.variant) AS variant FROM nv JOIN rv ON nv.variant = rv.variant AND nv.variant <> '' JOIN rn ON rn.n = rv.n GROUP BY 1, 2, 3),
matches AS (SELECT a.paper, a.author, m.name, m.tag_type, m.variant,
  CASE WHEN {_NN.format('a.author')} = {_NN.format('m.name')} THEN 'exact_name' WHEN list_contains(list_transform(r.aliases, lambda x: {_NN.format('x')}), {_NN.format('a.author')}) THEN 'alias' ELSE 'name_variant' END AS match_type,
  len(list_filter(r.affs, lambda t: contains(trim(regexp_replace(lower(a.affiliation), '[^a-z0-9一-鿿]+', ' ', 'g')), t))) > 0 AS affiliation_match
  FROM authors a JOIN meets m USING (author) JOIN reg r USING (name)) """


def registry(spark):
    return spark.createDataFrame(A.PERSON_REGISTRY, "name string, aliases array<string>, affiliations array<string>, tag_type string, source_link string, note string")


def matches(spark, sf_dir):
    return E.match_people(A.authors(spark, sf_dir), registry(spark))


@query(MATCH_SQL + "SELECT paper, author, name, tag_type, variant, match_type, affiliation_match FROM matches")
def person_match(spark, sf_dir):
    return matches(spark, sf_dir)


_SLUG = "tag_type || '::' || trim(regexp_replace(lower(trim(name)), '[^a-z0-9一-鿿]+', '-', 'g'), '-')"


@query(MATCH_SQL + f"SELECT {_SLUG} AS candidate_id, name, tag_type, count(DISTINCT paper) AS paper_count, min(paper) AS first_paper, bool_or(NOT affiliation_match) AS homonym_risk, array_to_string(list_sort(list(DISTINCT match_type)), ',') AS match_types FROM matches GROUP BY 1, 2, 3")
def person_candidates(spark, sf_dir):
    return E.candidates(matches(spark, sf_dir))


@query(MATCH_SQL + """, people AS (SELECT name, tag_type, CASE length(name) % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS status, source_link FROM reg),
active AS (SELECT * FROM people WHERE status <> 'rejected' AND name IN (SELECT name FROM matches)),
c AS (SELECT tag_type, count(*) AS n, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (source_link <> '') AS source_ready FROM active GROUP BY 1),
p AS (SELECT a.tag_type, count(DISTINCT m.paper) AS papers FROM active a JOIN matches m USING (name) GROUP BY 1)
SELECT group_ord, g.tag_type, coalesce(n, 0) AS n, coalesce(confirmed, 0) AS confirmed, coalesce(pending, 0) AS pending, coalesce(source_ready, 0) AS source_ready, coalesce(papers, 0) AS papers
FROM (VALUES (0, 'acm_fellow'), (1, 'ieee_fellow'), (2, 'cas_academician'), (3, 'cae_academician'), (4, 'top_school')) g(group_ord, tag_type) LEFT JOIN c USING (tag_type) LEFT JOIN p USING (tag_type)""")
def person_group_stats(spark, sf_dir):
    found = matches(spark, sf_dir)
    status = A.pick(["pending", "confirmed", "rejected"], F.length("name") % 3)
    people = registry(spark).join(found.select("name").distinct(), "name").select(F.col("name").alias("candidate_id"), "tag_type", status.alias("status"), "source_link")
    return E.person_statistics(people, found.select(F.col("name").alias("candidate_id"), "paper"))


@query(MATCH_SQL + f", hits AS (SELECT DISTINCT paper, {_SLUG} AS candidate_id FROM matches) SELECT paper, array_to_string(list_sort(list(candidate_id)), ',') AS candidate_hits, count(*) AS n FROM hits GROUP BY paper")
def candidate_paper_hits(spark, sf_dir):
    key = F.concat("tag_type", F.lit("::"), X.slug("name"))
    return matches(spark, sf_dir).select("paper", key.alias("candidate_id")).groupBy("paper").agg(F.array_join(F.array_sort(F.collect_set("candidate_id")), ",").alias("candidate_hits"), F.countDistinct("candidate_id").alias("n"))


_INST = "inst(ord, name, aliases) AS (VALUES " + ", ".join(f"({k}, '{n}', CAST({_quoted(a)} AS VARCHAR[]))" for k, n, a in A.INSTITUTIONS) + ")"


@query(f"""WITH {A.AUTHORS_SQL}, {_INST}, names AS (SELECT ord, name, unnest(list_concat([name], aliases)) AS known, generate_subscripts(list_concat([name], aliases), 1) AS name_ord FROM inst),
found AS (SELECT a.raw, n.*, row_number() OVER (PARTITION BY a.raw ORDER BY n.ord, n.name_ord) AS place FROM (SELECT DISTINCT affiliation AS raw FROM authors) a CROSS JOIN names n
  WHERE CASE WHEN length({_NN.format('known')}) <= 4 THEN regexp_matches(lower(raw), '(^|[^a-z0-9])' || lower(known) || '($|[^a-z0-9])') ELSE contains({_NN.format('raw')}, {_NN.format('known')}) END)
SELECT paper, author_ord, affiliation, f.name AS institution, f.known AS matched_name FROM authors LEFT JOIN (SELECT * FROM found WHERE place = 1) f ON raw = affiliation""")
def institution_first_match(spark, sf_dir):
    known = spark.createDataFrame(A.INSTITUTIONS, "ord int, name string, aliases array<string>")
    return E.match_institutions(A.authors(spark, sf_dir), known).select("paper", "author_ord", "affiliation", "institution", "matched_name")


@query(f"""WITH {A.AUTHORS_SQL}, rows AS (SELECT paper, lower(trim(author)) AS k, author, affiliation AS i, author_ord AS ord, 0 AS side FROM authors
UNION ALL SELECT paper, lower(trim(upper(author || CASE WHEN author_ord = 0 THEN ' jr' ELSE '' END))), upper(author || CASE WHEN author_ord = 0 THEN ' jr' ELSE '' END), CASE WHEN paper % 2 = 0 THEN upper(affiliation) ELSE affiliation || ' X' END, author_ord, 1 FROM authors),
names AS (SELECT paper, k, arg_min(author, side * 10 + ord) AS author, min(side * 10 + ord) AS o FROM rows GROUP BY 1, 2),
items AS (SELECT paper, k, lower(trim(i)) AS low, arg_min(i, side * 10 + ord) AS i, min(side * 10 + ord) AS o FROM rows GROUP BY 1, 2, 3),
lists AS (SELECT paper, k, string_agg(i, '|' ORDER BY o, i) AS institutions FROM items GROUP BY 1, 2)
SELECT paper, CAST(row_number() OVER (PARTITION BY paper ORDER BY o) AS INTEGER) AS place, author, institutions FROM names JOIN lists USING (paper, k)""")
def author_merge(spark, sf_dir):
    rows = A.authors(spark, sf_dir)
    foreign = F.upper(F.concat("author", F.when(F.col("author_ord") == 0, " jr").otherwise("")))
    own = rows.select("paper", "author", F.col("affiliation").alias("institution"), F.col("author_ord").alias("ord"))
    other = rows.select("paper", foreign.alias("author"), F.when(F.col("paper") % 2 == 0, F.upper("affiliation")).otherwise(F.concat("affiliation", F.lit(" X"))).alias("institution"), F.col("author_ord").alias("ord"))
    return E.merge_authors(own, other)


@query("""WITH a AS (SELECT p_brand AS tag_type, 'Name ' || (p_partkey % 40) AS name, p_type AS alias, CASE WHEN p_size % 3 = 0 THEN 'note' || p_size ELSE '' END AS note, p_partkey FROM part),
x AS (SELECT tag_type, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k, arg_min(name, p_partkey) AS name, arg_min(alias, p_partkey) AS alias, arg_min(note, p_partkey) AS note FROM a GROUP BY 1, 2),
y AS (SELECT tag_type, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k, arg_max(name, p_partkey) AS name, arg_max(alias, p_partkey) AS alias, arg_max(note, p_partkey) AS note FROM (SELECT * REPLACE ('Name ' || (p_partkey % 50 + 10) AS name) FROM a) GROUP BY 1, 2)
SELECT tag_type, coalesce(x.name, y.name) AS name, CASE WHEN x.name IS NULL THEN y.alias WHEN y.name IS NULL OR x.alias = y.alias THEN x.alias ELSE x.alias || '|' || y.alias END AS aliases,
CASE WHEN coalesce(y.note, '') = '' THEN coalesce(x.note, '') WHEN coalesce(x.note, '') = '' THEN y.note WHEN contains(x.note, y.note) THEN x.note ELSE x.note || '；' || y.note END AS note,
CASE WHEN x.name IS NULL THEN 'added' WHEN y.name IS NULL THEN 'kept' ELSE 'updated' END AS change FROM x FULL JOIN y USING (tag_type, k)""")
def registry_merge_upsert(spark, sf_dir):
    part = A.table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag_type"), F.concat(F.lit("Name "), (F.col("p_partkey") % 40).cast("string")).alias("name"), F.col("p_type").alias("alias"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("note"), F.col("p_size").cast("string"))).otherwise("").alias("note"), "p_partkey")

    def side(part, best):
        first = lambda c: best(c, "p_partkey").alias(c)
        rows = part.groupBy("tag_type", X.norm_name("name").alias("k")).agg(first("name"), first("alias"), first("note"))
        return rows.select("tag_type", "name", F.array("alias").alias("aliases"), "note")

    later = part.withColumn("name", F.concat(F.lit("Name "), (F.col("p_partkey") % 50 + 10).cast("string")))
    return E.merge_registry(side(part, F.min_by), side(later, F.max_by)).withColumn("aliases", F.array_join("aliases", "|"))
