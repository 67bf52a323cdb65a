"""Queries over passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as X
from ..operators import passages as S

QUERIES, SQL = {}, {}
TITLE = "Thention-based onthen: the erthly Design of tishe for onble"
INDEX = 7


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_N = "replace(replace(replace(translate(lower({0}), '’‘“”–—', '''''\"\"--'), '´', ''), 'ﬁ', 'fi'), 'ﬀ', 'ff')"
# RE2 has word boundaries of ASCII letters only
_ASCII = "regexp_replace({0}, '[À-ɏ]', 'z', 'g')"
_CNT = "len(regexp_extract_all({0}, '{1}'))"
_LEAD = r"regexp_matches(text, '^\s*\[\s*\d+\s*\]')"
REF_SCORE = (
    rf"(4 * CAST({_LEAD} AS INTEGER) + 4 * CAST(regexp_matches(text, '^\s*\d+[.)]\s+') AS INTEGER) + 3 * "
    + _CNT.format("text", r"10\.\d{4,9}/\S+") + " + 2 * " + _CNT.format(_ASCII.format(_N.format("text")), r"\b(?:vol\.?|no\.?|pp\.?|proc\.?|proceedings|doi:)\b")
    + " + " + _CNT.format(_ASCII.format("text"), r"\b[A-Z]\.\s*[A-Z][a-z]+") + " + 2 * CAST(" + _CNT.format("text", r"\b(?:19|20)\d{2}\b") + " >= 2 AS INTEGER) + 2 * CAST(length(text) < 500 AND ("
    + _LEAD + " OR contains(" + _N.format("text") + ", 'doi:')) AS INTEGER))"
)
MARKED = f"WITH {A.MARKED_SQL} "


# Texts in which every third line end is a blank line. A page of one paragraph falls into packed sentences.
_SPLIT_SQL = r"""t AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13), chr(10)), chr(10), CASE WHEN doc_id % 3 = 0 THEN chr(10) || '  ' || chr(10) ELSE chr(10) END) AS text FROM documents),
p0 AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(12) || chr(13))), lambda x: x <> '') AS ps FROM t),
s0 AS (SELECT doc_id, ps, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(12) || chr(13))), lambda x: x <> '') AS ss, len(ps) <= 1 AND length(text) > 300 AS rough FROM p0),
r AS (SELECT doc_id, ps, ss, rough, 1 AS i, CAST([] AS VARCHAR[]) AS done, '' AS held, 0 AS size FROM s0)"""


@query(f"""WITH RECURSIVE {_SPLIT_SQL}, g AS (SELECT * FROM r UNION ALL SELECT doc_id, ps, ss, rough, i + 1,
  CASE WHEN size + length(ss[i]) >= 350 THEN list_append(done, CASE WHEN held = '' THEN ss[i] ELSE held || ' ' || ss[i] END) ELSE done END, CASE WHEN size + length(ss[i]) >= 350 THEN '' WHEN held = '' THEN ss[i] ELSE held || ' ' || ss[i] END, CASE WHEN size + length(ss[i]) >= 350 THEN 0 ELSE size + length(ss[i]) END FROM g WHERE rough AND i <= len(ss)),
f AS (SELECT doc_id, CASE WHEN rough AND len(ss) > 0 THEN CASE WHEN held = '' THEN done ELSE list_append(done, held) END ELSE ps END AS parts FROM g WHERE NOT rough OR i = len(ss) + 1),
u AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS k FROM f)
SELECT doc_id, CAST(k AS INTEGER) AS span_index, CAST(length(text) AS INTEGER) AS chars, md5(text) AS text_md5 FROM u""")
def paragraph_split(spark, sf_dir):
    joint = F.when(F.col("doc_id") % 3 == 0, "\n  \n").otherwise("\n")
    pages = A.table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("\n")), F.lit("\n"), joint).alias("text"))
    return S.split_pages(pages).select("doc_id", "span_index", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query(f"""WITH {A.PARAGRAPHS_SQL}, x AS (SELECT CASE WHEN seq % 3 = 0 THEN 'citation_index_exact' WHEN seq % 3 = 1 THEN 'context_similarity' ELSE 'keyword_fallback' END AS match_type,
  CASE WHEN (doc_id + seq) % 9 = 0 THEN text || ' /uni0041ab /uni00cdef1 /UNI123456' WHEN (doc_id + seq) % 9 = 1 THEN repeat('#%', 201) || left(text, 40) ELSE text END AS text FROM paragraphs),
y AS (SELECT match_type, lower(text) AS low, regexp_replace(text, '[\\s\\x85\\xa0\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g') AS v FROM x),
z AS (SELECT match_type, len(regexp_extract_all(low, '/uni[0-9a-f]{{6,}}')) >= 3 OR length(v) = 0 OR (length(v) >= 400 AND length(regexp_replace(v, '[^\\p{{L}}\\p{{N}}]', '', 'g')) * 100 < length(v) * 45) AS noisy FROM y)
SELECT match_type, count(*) AS n, count(*) FILTER (noisy) AS dropped FROM z GROUP BY match_type""")
def noise_filter(spark, sf_dir):
    k = (F.col("doc_id") + F.col("seq")) % 9
    text = F.when(k == 0, F.concat("text", F.lit(" /uni0041ab /uni00cdef1 /UNI123456"))).when(k == 1, F.concat(F.repeat(F.lit("#%"), F.lit(201)), F.substring("text", 1, 40))).otherwise(F.col("text"))
    kind = A.pick(["citation_index_exact", "context_similarity", "keyword_fallback"], F.col("seq") % 3)
    rows = A.paragraphs(spark, sf_dir).select(kind.alias("match_type"), X.is_noisy(text).alias("noisy"))
    return rows.groupBy("match_type").agg(F.count("*").alias("n"), F.count_if("noisy").alias("dropped"))


@query(MARKED + f"SELECT doc_id, seq, CAST({REF_SCORE} AS INTEGER) AS reference_score FROM marked")
def reference_entry_score(spark, sf_dir):
    return A.marked(spark, sf_dir).select("doc_id", "seq", X.reference_entry_score("text").alias("reference_score"))


_PAGES = r"""paged AS (SELECT doc_id, seq AS page, CASE WHEN (doc_id + seq) % 11 = 0 THEN 'x' || chr(10) || ' IV. References ' || chr(10) || text
  WHEN (doc_id + seq) % 7 = 0 THEN repeat(chr(10) || '[3] A. Bcd 2001 doi: 10.1000/a vol. 1 ', 21) ELSE text END AS text FROM paragraphs)"""


@query(f"""WITH {A.PARAGRAPHS_SQL}, {_PAGES}, f AS (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS total, regexp_matches(text, '(?mi)^\\s*(references|bibliography)\\s*$') OR regexp_matches(text, '(?mi)^\\s*[ivxlcdm.\\s]*(references|bibliography)\\s*$') AS heading,
  {_CNT.format('text', chr(92) + '[' + chr(92) + 's*' + chr(92) + 'd+' + chr(92) + 's*' + chr(92) + ']')} AS b, {_CNT.format('text', '(?i)10' + chr(92) + '.' + chr(92) + 'd{4,9}/' + chr(92) + 'S+')} AS d, {_CNT.format('text', chr(92) + 'b(?:19|20)' + chr(92) + 'd{2}' + chr(92) + 'b')} AS y FROM paged)
SELECT doc_id, coalesce(min(CASE WHEN heading AND page >= greatest(2, CAST(floor(total * 0.45) AS INTEGER)) THEN page END), min(CASE WHEN ((b >= 20 AND y >= 15) OR (d >= 2 AND y >= 10)) AND page >= greatest(2, CAST(floor(total * 0.6) AS INTEGER)) THEN page END)) AS reference_start FROM f GROUP BY doc_id""")
def reference_start(spark, sf_dir):
    k = F.col("doc_id") + F.col("seq")
    text = F.when(k % 11 == 0, F.concat(F.lit("x\n IV. References \n"), "text")).when(k % 7 == 0, F.repeat(F.lit("\n[3] A. Bcd 2001 doi: 10.1000/a vol. 1 "), F.lit(21))).otherwise(F.col("text"))
    return S.reference_start(A.paragraphs(spark, sf_dir).select("doc_id", F.col("seq").alias("page"), text.alias("text")))


HITS = MARKED + rf""", groups AS (SELECT doc_id, seq, text, list_concat(regexp_extract_all(text, '\[([^\[\]]+)\]', 1), regexp_extract_all(text, '\(([^()]+)\)', 1)) AS gs FROM marked),
hits AS (SELECT doc_id, seq, text, CASE WHEN regexp_matches(text, '\[\s*{INDEX}\s*\]') OR regexp_matches(text, '\(\s*{INDEX}\s*\)') THEN 'citation_index_exact'
  WHEN len(list_filter(gs, lambda g: (list_contains(list_transform(regexp_extract_all(g, '\d+'), lambda x: TRY_CAST(x AS BIGINT)), {INDEX}) AND len(list_distinct(list_transform(regexp_extract_all(g, '\d+'), lambda x: TRY_CAST(x AS BIGINT)))) > 1)
    OR len(list_filter(regexp_extract_all(g, '\d+\s*[-–—]\s*\d+'), lambda s: {INDEX} BETWEEN least(TRY_CAST(regexp_extract(s, '^(\d+)', 1) AS BIGINT), TRY_CAST(regexp_extract(s, '(\d+)$', 1) AS BIGINT)) AND greatest(TRY_CAST(regexp_extract(s, '^(\d+)', 1) AS BIGINT), TRY_CAST(regexp_extract(s, '(\d+)$', 1) AS BIGINT)))) > 0)) > 0 THEN 'citation_index_grouped' END AS kind FROM groups) """


@query(HITS + "SELECT doc_id, seq, kind FROM hits WHERE kind IS NOT NULL")
def citation_marker_hits(spark, sf_dir):
    return S.citation_hits(A.marked(spark, sf_dir), INDEX).select("doc_id", "seq", "kind").where("kind IS NOT NULL")


NEIGHBOURS = HITS + f""", n AS (SELECT *, lag(kind) OVER w AS b, lead(kind) OVER w AS a FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
spans AS (SELECT doc_id, seq, text, CASE WHEN b IS NOT NULL THEN 'citation_index_neighbor' WHEN kind IS NOT NULL THEN kind WHEN a IS NOT NULL THEN 'citation_index_neighbor' END AS match_type FROM n),
neighbours AS (SELECT doc_id, seq, match_type, CASE match_type WHEN 'citation_index_exact' THEN 100 WHEN 'citation_index_grouped' THEN 85 ELSE 60 END - CASE WHEN {REF_SCORE} >= 6 THEN 50 ELSE 0 END AS score FROM spans WHERE match_type IS NOT NULL) """


def neighbours(spark, sf_dir):
    rows = S.citation_hits(A.marked(spark, sf_dir), INDEX).withColumn("reference_like", X.is_reference_entry("text"))
    return S.neighbour_spans(rows).select("doc_id", "seq", "match_type", "score")


@query(NEIGHBOURS + "SELECT * FROM neighbours")
def neighbor_expand(spark, sf_dir):
    return neighbours(spark, sf_dir)


@query(NEIGHBOURS + """, p AS (SELECT doc_id, seq, text, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r FROM marked),
j AS (SELECT s.doc_id, s.seq, s.match_type, q.r, o.text, o.r AS o FROM neighbours s JOIN p q USING (doc_id, seq) JOIN p o ON o.doc_id = s.doc_id AND abs(o.r - q.r) <= CASE WHEN s.match_type IN ('citation_index_exact', 'citation_index_grouped') THEN 2 ELSE 1 END)
SELECT doc_id, seq, match_type, CAST(count(*) AS INTEGER) AS window_size, md5(string_agg(text, chr(10) || chr(10) ORDER BY o)) AS window_md5 FROM j GROUP BY 1, 2, 3""")
def context_window(spark, sf_dir):
    found = S.local_windows(A.marked(spark, sf_dir), neighbours(spark, sf_dir))
    return found.select("doc_id", "seq", "match_type", "window_size", F.md5("window_text").alias("window_md5"))


_TOK = f"list_distinct(list_filter(regexp_extract_all({_N.format('text')}, '[a-z0-9\\-]+'), lambda w: length(w) >= 3 AND NOT list_contains({A._quoted(X.OVERLAP_STOP)}, w)))"


@query(MARKED + f""", p AS (SELECT doc_id, seq, {_TOK} AS words FROM marked WHERE {REF_SCORE} < 6), c AS (SELECT item_id AS context_id, {_TOK} AS words FROM benchmark),
pw AS (SELECT doc_id, seq, len(words) AS n, unnest(words) AS word FROM p), cw AS (SELECT context_id, len(words) AS m, unnest(words) AS word FROM c),
s AS (SELECT doc_id, seq, context_id, count(*) AS shared, min(least(n, m)) AS smaller FROM pw JOIN cw USING (word) GROUP BY 1, 2, 3)
SELECT doc_id, seq, context_id, shared, CAST(smaller AS INTEGER) AS smaller, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(shared AS DOUBLE) / smaller DESC, seq, context_id) AS place FROM s WHERE shared * 100 >= smaller * 18) WHERE place <= 30""")
def context_similarity_topk(spark, sf_dir):
    contexts = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("context_id"), "text")
    return S.context_similarity(A.marked(spark, sf_dir), contexts).select("doc_id", "seq", "context_id", "shared", "smaller", "place")


_HIT = lambda a: f"(regexp_matches({_N.format('text')}, '(^|[^a-z0-9]){a}($|[^a-z0-9])')" + (f" OR contains(regexp_replace({_N.format('text')}, '[^a-z0-9]+', '', 'g'), '{a.replace('-', '').replace(' ', '')}')" if "-" in a or " " in a else "") + ")"


#: What the title gives, worked out by hand.
WORDS, NAMES = ["onthen", "erthly", "design", "tishe", "onble"], ["thention-based onthen", "tboedto", "tb-oedto"]
_CONTAINS = lambda w: f"contains({_N.format('text')}, '{w}')"
# the third name is the second one in compact form, and counts once
_SIGNS = " + ".join([f"2 * CAST({_CONTAINS(w)} AS INTEGER)" for w in WORDS] + [f"3 * CAST({_HIT(a)} AS INTEGER)" for a in NAMES[:2]])


@query(MARKED + rf""", s AS (SELECT doc_id, seq, CAST({_SIGNS} + CAST(regexp_matches(text, '\[\d+\]') AS INTEGER) + CAST(length(text) > 120 AS INTEGER) AS INTEGER) AS score FROM marked WHERE {REF_SCORE} < 6)
SELECT doc_id, seq, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seq) AS place FROM s WHERE score > 0) WHERE place <= 20""")
def keyword_fallback(spark, sf_dir):
    return S.keyword_fallback(A.marked(spark, sf_dir), X.signs_of(spark, TITLE)).select("doc_id", "seq", "score", "place")


_GEN = f"""gen AS (SELECT doc, seq, score, CASE WHEN hit AND exact THEN 'citation_index_exact' WHEN hit THEN 'citation_index_grouped' ELSE 'citation_index_neighbor' END AS match_type, 0 AS ord, CAST(NULL AS DOUBLE) AS overlap FROM lines WHERE seq <= 4
UNION ALL SELECT doc, seq, score, 'context_similarity', 1, score / 100.0 FROM lines WHERE score % 2 = 0 UNION ALL SELECT doc, seq, score % 7, 'keyword_fallback', 2, NULL FROM lines)"""
_RANK = "CASE match_type WHEN 'citation_index_exact' THEN 0 WHEN 'citation_index_grouped' THEN 1 WHEN 'context_similarity' THEN 2 WHEN 'citation_index_neighbor' THEN 3 WHEN 'keyword_fallback' THEN 4 ELSE 99 END"
MERGED = f"""WITH {A.LINES_SQL}, {_GEN}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, seq ORDER BY {_RANK}, score DESC, ord) AS place FROM gen) WHERE place = 1),
merged AS (SELECT b.doc AS doc_id, CAST(b.seq % 3 AS INTEGER) AS page, b.seq AS span_index, b.match_type, b.score, g.evidence, g.overlap FROM best b JOIN (SELECT doc, seq, array_to_string(list_sort(list(DISTINCT match_type)), ',') AS evidence, max(overlap) AS overlap FROM gen GROUP BY 1, 2) g USING (doc, seq)) """


def merged(spark, sf_dir):
    rows = A.lines(spark, sf_dir)
    base = rows.select(F.col("doc").alias("doc_id"), (F.col("seq") % 3).cast("int").alias("page"), F.col("seq").alias("span_index"), "hit", "exact", "score")
    kind = F.when(F.col("hit") & F.col("exact"), "citation_index_exact").when(F.col("hit"), "citation_index_grouped").otherwise("citation_index_neighbor")
    none = F.lit(None).cast("double")
    one = lambda df, k, s, o, v: df.select("doc_id", "page", "span_index", k.alias("match_type"), s.alias("score"), F.lit(o).alias("ord"), v.alias("overlap"))
    parts = [one(base.where("span_index <= 4"), kind, F.col("score"), 0, none), one(base.where("score % 2 = 0"), F.lit("context_similarity"), F.col("score"), 1, F.col("score") / 100.0), one(base, F.lit("keyword_fallback"), F.col("score") % 7, 2, none)]
    return S.merge_spans(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(MERGED + "SELECT * FROM merged")
def span_merge(spark, sf_dir):
    return merged(spark, sf_dir)


@query(MERGED + f"SELECT doc_id, span_index, match_type, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK}, score DESC, page, span_index) AS place FROM merged) WHERE place <= 3")
def span_final_order(spark, sf_dir):
    return S.final_order(merged(spark, sf_dir), 3).select("doc_id", "span_index", "match_type", "place")


@query(f"""WITH {A.FINDINGS_SQL}, o AS (SELECT doc_id, page, span_index, min(ord) AS ord FROM findings GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN lag(page) OVER w = page AND lag(span_index) OVER w + 1 = span_index THEN 0 ELSE 1 END AS starts FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, count(*) AS occurrences, CAST(sum(starts) AS BIGINT) AS islands, min(page) AS page_start, max(page) AS page_end FROM s GROUP BY doc_id""")
def mention_islands(spark, sf_dir):
    return S.islands(A.findings(spark, sf_dir))


@query(f"""WITH {A.PARAGRAPHS_SQL}, c AS (SELECT * FROM (SELECT doc_id, seq, left(text, 1800) AS block, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS place FROM paragraphs) WHERE place <= 4),
u AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
SELECT doc_id, seq, CAST(used AS BIGINT) AS used, CAST(least(length(block), 9000 - used) AS INTEGER) AS chars, md5(left(block, CAST(9000 - used AS BIGINT))) AS block_md5 FROM u WHERE used < 9000""")
def char_budget(spark, sf_dir):
    rows = S.within_budget(A.paragraphs(spark, sf_dir), 9000, 4, 1800)
    return rows.select("doc_id", "seq", F.col("used").cast("long").alias("used"), F.length("block").alias("chars"), F.md5("block").alias("block_md5"))


@query(r"""WITH RECURSIVE s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+([A-Z0-9\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(12) || chr(13))), lambda x: x <> '') AS ss FROM documents),
g AS (SELECT doc_id, ss, 1 AS i, CAST([] AS VARCHAR[]) AS done, '' AS held, 0 AS size FROM s0 UNION ALL SELECT doc_id, ss, i + 1, CASE WHEN size + length(ss[i]) >= 350 THEN list_append(done, CASE WHEN held = '' THEN ss[i] ELSE held || ' ' || ss[i] END) ELSE done END,
  CASE WHEN size + length(ss[i]) >= 350 THEN '' WHEN held = '' THEN ss[i] ELSE held || ' ' || ss[i] END, CASE WHEN size + length(ss[i]) >= 350 THEN 0 ELSE size + length(ss[i]) END FROM g WHERE i <= len(ss)),
f AS (SELECT doc_id, CASE WHEN held = '' THEN done ELSE list_append(done, held) END AS parts FROM g WHERE i = len(ss) + 1), u AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS k FROM f)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS at, CAST(length(text) AS INTEGER) AS chars FROM u""")
def sentence_pack(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.packed_sentences(F.coalesce("text", F.lit("")))).alias("at", "text"))
    return rows.select("doc_id", "at", F.length("text").alias("chars"))


DOI = "10.1000/x7"
_PLACES = "list_transform(range(1, len(string_split(n, '{0}'))), lambda i: CAST(list_sum(list_transform(string_split(n, '{0}')[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length('{0}'))"
_BOUNDED = "list_filter({1}, lambda p: NOT regexp_matches(substr(n, CAST(p AS BIGINT), 1), '[a-z0-9]') AND NOT regexp_matches(substr(n, CAST(p + length('{0}') + 1 AS BIGINT), 1), '[a-z0-9]'))"
_MARKS = "SELECT doc_id, seq, score, n, '{1}' AS style, unnest(regexp_extract_all(text, '{0}', 1)) AS number, unnest(regexp_extract_all(text, '{0}')) AS found, generate_subscripts(regexp_extract_all(text, '{0}'), 1) AS i, regexp_split_to_array(text, '{0}') AS parts, regexp_extract_all(text, '{0}') AS matched FROM scored"
#: The number of the best reference entry of each document: {rows} gives doc_id, seq and text.
PICK_SQL = f"""scored AS (SELECT * FROM (SELECT doc_id, seq, text, {_N.format('text')} AS n, CAST({_SIGNS} + 15 * CAST({_CONTAINS(DOI)} AS INTEGER) + 2 * CAST({REF_SCORE} >= 6 AS INTEGER) AS INTEGER) AS score FROM {{rows}}) WHERE score > 0),
found AS ({_MARKS.format(r'\[\s*(\d+)\s*\]', 'bracket')} UNION ALL {_MARKS.format(r'(?m)^\s*(\d+)[.)]\s+', 'leading_number')}),
marks AS (SELECT doc_id, seq, score, style, number, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(matched[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM found),
signs AS (SELECT DISTINCT doc_id, seq, unnest(list_concat({', '.join([_PLACES.format(w) for w in [*WORDS, DOI]])}, {', '.join(_BOUNDED.format(a, _PLACES.format(a)) for a in NAMES)})) AS sign FROM scored),
pairs AS (SELECT m.*, s.sign, abs(m.pos - s.sign) AS d FROM marks m LEFT JOIN signs s USING (doc_id, seq)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY d NULLS FIRST, pos, number, style, sign) AS place FROM pairs) WHERE place = 1),
picked AS (SELECT doc_id, seq, score, style, coalesce(pos - sign BETWEEN 5 AND 260 AND TRY_CAST(number AS HUGEINT) > 1, FALSE) AS inferred, number FROM near),
ranked AS (SELECT s.doc_id, s.seq, p.style, p.inferred, s.score, CASE WHEN p.inferred THEN CAST(TRY_CAST(number AS HUGEINT) - 1 AS VARCHAR) ELSE number END AS citation_index, s.score + CASE WHEN number IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN p.inferred THEN 5 ELSE 0 END AS rank_score FROM scored s LEFT JOIN picked p USING (doc_id, seq)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank_score DESC, seq) AS place FROM ranked) WHERE place = 1 AND citation_index IS NOT NULL)"""


@query(MARKED + ", " + PICK_SQL.replace("{rows}", "marked") + " SELECT doc_id, CAST(1 AS INTEGER) AS page, CAST(seq AS INTEGER) AS span_index, citation_index, style, inferred, score, rank_score FROM best")
def citation_index_pick(spark, sf_dir):
    rows = A.marked(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.col("seq").alias("span_index"), "text")
    return S.best_reference(rows, X.signs_of(spark, TITLE, DOI))


def _full_analysis_sql() -> str:
    """The whole analysis, stage by stage, with the fragments above."""
    noisy = r"""(len(regexp_extract_all(lower(text), '/uni[0-9a-f]{6,}')) >= 3 OR length({v}) = 0 OR (length({v}) >= 400 AND length(regexp_replace({v}, '[^\p{L}\p{N}]', '', 'g')) * 100 < length({v}) * 45))"""
    noisy = noisy.replace("{v}", r"regexp_replace(text, '[\s\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')")
    cnt = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))"
    kind = r"""CASE WHEN regexp_matches(text, '\[\s*' || number || '\s*\]') OR regexp_matches(text, '\(\s*' || number || '\s*\)') THEN 'citation_index_exact'
  WHEN len(list_filter(gs, lambda g: (list_contains(list_transform(regexp_extract_all(g, '\d+'), lambda x: TRY_CAST(x AS BIGINT)), number) AND len(list_distinct(list_transform(regexp_extract_all(g, '\d+'), lambda x: TRY_CAST(x AS BIGINT)))) > 1)
    OR len(list_filter(regexp_extract_all(g, '\d+\s*[-–—]\s*\d+'), lambda s: number BETWEEN least(TRY_CAST(regexp_extract(s, '^(\d+)', 1) AS BIGINT), TRY_CAST(regexp_extract(s, '(\d+)$', 1) AS BIGINT)) AND greatest(TRY_CAST(regexp_extract(s, '^(\d+)', 1) AS BIGINT), TRY_CAST(regexp_extract(s, '(\d+)$', 1) AS BIGINT)))) > 0)) > 0 THEN 'citation_index_grouped' END"""
    cue = lambda words: "regexp_matches(low, '" + "|".join(words) + "')"
    rank = _RANK
    return rf"""WITH RECURSIVE {A.MARKED_SQL},
paged AS (SELECT doc_id, seq AS page, CASE WHEN (doc_id + seq) % 11 = 0 THEN 'References' || chr(10) || chr(10) || text ELSE text END AS text FROM marked WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0),
ref0 AS (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS total, regexp_matches(text, '(?mi)^\s*(references|bibliography)\s*$') AS heading, {cnt(r'\[\s*\d+\s*\]')} AS b, {cnt(r'(?m)^\s*\[?\d+\]?[.)]\s+[A-Z]')} AS m, {cnt(r'(?i)10\.\d{4,9}/\S+')} AS d, {cnt(r'\b(?:19|20)\d{2}\b')} AS y FROM paged),
ref AS (SELECT doc_id, coalesce(min(CASE WHEN heading AND page >= greatest(2, CAST(floor(total * 0.45) AS INTEGER)) THEN page END), min(CASE WHEN ((b >= 20 AND y >= 15) OR (m >= 20 AND y >= 15) OR (d >= 2 AND y >= 10)) AND page >= greatest(2, CAST(floor(total * 0.6) AS INTEGER)) THEN page END)) AS start FROM ref0 GROUP BY doc_id),
p0 AS (SELECT doc_id, page, text, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(12) || chr(13))), lambda x: x <> '') AS ps FROM paged),
s0 AS (SELECT doc_id, page, ps, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(12) || chr(13))), lambda x: x <> '') AS ss, len(ps) <= 1 AND length(text) > 300 AS rough FROM p0),
g AS (SELECT doc_id, page, ps, ss, rough, 1 AS i, CAST([] AS VARCHAR[]) AS done, '' AS held, 0 AS size FROM s0 UNION ALL SELECT doc_id, page, ps, ss, rough, i + 1, CASE WHEN size + length(ss[i]) >= 350 THEN list_append(done, CASE WHEN held = '' THEN ss[i] ELSE held || ' ' || ss[i] END) ELSE done END,
  CASE WHEN size + length(ss[i]) >= 350 THEN '' WHEN held = '' THEN ss[i] ELSE held || ' ' || ss[i] END, CASE WHEN size + length(ss[i]) >= 350 THEN 0 ELSE size + length(ss[i]) END FROM g WHERE rough AND i <= len(ss)),
f AS (SELECT doc_id, page, CASE WHEN rough AND len(ss) > 0 THEN CASE WHEN held = '' THEN done ELSE list_append(done, held) END ELSE ps END AS parts FROM g WHERE NOT rough OR i = len(ss) + 1),
u AS (SELECT doc_id, page, unnest(parts) AS text, CAST(generate_subscripts(parts, 1) AS INTEGER) AS span_index FROM f),
paras AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, span_index) AS seq FROM u),
body AS (SELECT p.* FROM paras p JOIN ref USING (doc_id) WHERE start IS NULL OR page < start), refs AS (SELECT p.* FROM paras p JOIN ref USING (doc_id) WHERE page >= start),
{PICK_SQL.replace("{rows}", "refs")},
numbers AS (SELECT doc_id, TRY_CAST(citation_index AS INTEGER) AS number FROM best WHERE TRY_CAST(citation_index AS INTEGER) IS NOT NULL),
groups AS (SELECT b.*, number, list_concat(regexp_extract_all(text, '\[([^\[\]]+)\]', 1), regexp_extract_all(text, '\(([^()]+)\)', 1)) AS gs FROM body b JOIN numbers USING (doc_id)),
hits AS (SELECT *, {kind} AS kind FROM groups),
beside AS (SELECT *, lag(kind) OVER w AS b, lead(kind) OVER w AS a FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
g1 AS (SELECT doc_id, page, span_index, CASE WHEN b IS NOT NULL THEN 'citation_index_neighbor' WHEN kind IS NOT NULL THEN kind WHEN a IS NOT NULL THEN 'citation_index_neighbor' END AS match_type, {REF_SCORE} >= 6 AS listed FROM beside),
gen1 AS (SELECT doc_id, page, span_index, match_type, CAST(CASE match_type WHEN 'citation_index_exact' THEN 100 WHEN 'citation_index_grouped' THEN 85 ELSE 60 END - CASE WHEN listed THEN 50 ELSE 0 END AS DOUBLE) AS score, 0 AS ord, CAST(NULL AS DOUBLE) AS overlap FROM g1 WHERE match_type IS NOT NULL),
pw AS (SELECT doc_id, seq, len(words) AS n, unnest(words) AS word FROM (SELECT doc_id, seq, {_TOK} AS words FROM body WHERE {REF_SCORE} < 6)), cw AS (SELECT context_id, len(words) AS m, unnest(words) AS word FROM (SELECT item_id AS context_id, {_TOK} AS words FROM benchmark)),
sh AS (SELECT doc_id, seq, context_id, count(*) AS shared, min(least(n, m)) AS smaller FROM pw JOIN cw USING (word) GROUP BY 1, 2, 3),
top30 AS (SELECT *, CAST(shared AS DOUBLE) / smaller AS overlap FROM sh WHERE shared * 100 >= smaller * 18 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(shared AS DOUBLE) / smaller DESC, seq, context_id) <= 30),
gen2 AS (SELECT doc_id, page, span_index, 'context_similarity' AS match_type, round(overlap * 100, 2) AS score, 1 AS ord, overlap FROM (SELECT doc_id, seq, max(overlap) AS overlap FROM top30 GROUP BY 1, 2) JOIN body USING (doc_id, seq)),
kw AS (SELECT doc_id, seq, page, span_index, {_SIGNS} + 8 * CAST({_CONTAINS(DOI)} AS INTEGER) + CAST(regexp_matches(text, '\[\d+\]') AS INTEGER) + CAST(length(text) > 120 AS INTEGER) AS score FROM body WHERE {REF_SCORE} < 6),
gen3 AS (SELECT doc_id, page, span_index, 'keyword_fallback' AS match_type, CAST(score AS DOUBLE) AS score, 2 AS ord, CAST(NULL AS DOUBLE) AS overlap FROM kw WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seq) <= 20),
gen AS (SELECT * FROM gen1 UNION ALL SELECT * FROM gen2 UNION ALL SELECT * FROM gen3),
one AS (SELECT doc_id, page, span_index, match_type, score FROM gen QUALIFY row_number() OVER (PARTITION BY doc_id, page, span_index ORDER BY {rank}, score DESC, ord) = 1),
ev AS (SELECT doc_id, page, span_index, list_sort(list(DISTINCT match_type)) AS evidence FROM gen GROUP BY 1, 2, 3),
spans AS (SELECT o.*, evidence, seq, text FROM one o JOIN ev USING (doc_id, page, span_index) JOIN body USING (doc_id, page, span_index) WHERE NOT {noisy}),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {rank}, score DESC, page, span_index) AS place FROM spans QUALIFY place <= 20),
around AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r, {noisy} AS noisy FROM body),
windows AS (SELECT p.doc_id, p.page, p.span_index, any_value(p.text) AS text, any_value(p.match_type) AS match_type, any_value(p.place) AS place, string_agg(o.text, chr(10) || chr(10) ORDER BY o.r) AS window_text FROM placed p JOIN around q ON q.doc_id = p.doc_id AND q.seq = p.seq
  JOIN around o ON o.doc_id = p.doc_id AND abs(o.r - q.r) <= CASE WHEN p.match_type IN ('citation_index_exact', 'citation_index_grouped') THEN 2 ELSE 1 END AND (NOT o.noisy OR o.seq = p.seq) WHERE p.place <= 8 GROUP BY 1, 2, 3),
said AS (SELECT doc_id, contains(low, '[') AS marked, {cue(['extend', 'build on', 'builds on'])} OR {cue(['baseline', 'compared', 'outperform'])} OR {cue(['apply', 'applied', 'use of'])} OR {cue(['versus', 'unlike', 'in contrast'])} OR contains(low, 'the') AS cued FROM (SELECT doc_id, lower(window_text) AS low FROM windows)),
failed AS (SELECT DISTINCT doc_id FROM windows WHERE doc_id % 19 = 0),
kept AS (SELECT doc_id, 'explicit_citation' AS mention_type FROM said WHERE marked AND cued AND doc_id NOT IN (SELECT doc_id FROM failed)),
outcome AS (SELECT * FROM kept UNION ALL SELECT doc_id, 'weak' FROM placed WHERE place = 1 AND match_type LIKE 'citation_index%' AND doc_id NOT IN (SELECT doc_id FROM kept) AND doc_id NOT IN (SELECT doc_id FROM failed)),
counts AS (SELECT doc_id, count(*) AS findings, count(*) FILTER (mention_type = 'explicit_citation') AS strong FROM outcome GROUP BY 1),
heads AS (SELECT doc_id, count(*) AS spans, count(*) FILTER (match_type LIKE 'citation_index%') AS index_hits, arg_min(evidence, place) AS evidence, arg_min(score, place) AS score FROM placed GROUP BY 1),
docs AS (SELECT DISTINCT doc_id FROM documents),
j AS (SELECT d.doc_id, number, coalesce(spans, 0) AS spans, coalesce(index_hits, 0) AS index_hits, coalesce(findings, 0) AS findings, coalesce(strong, 0) AS strong, evidence, score, d.doc_id IN (SELECT doc_id FROM failed) AS failed
  FROM docs d LEFT JOIN heads USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN numbers USING (doc_id))
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'context_only' WHEN doc_id % 17 = 0 THEN 'fulltext_extract_failed' WHEN failed THEN 'analysis_failed' WHEN findings > 0 AND strong > 0 THEN 'fulltext_analyzed' WHEN findings > 0 THEN 'mention_only' WHEN number IS NOT NULL AND index_hits = 0 THEN 'reference_only'
    WHEN len(list_filter(coalesce(evidence, []), lambda e: e LIKE 'citation_index%')) > 0 THEN 'mention_only' WHEN coalesce(score, 0) >= 3 THEN 'mention_only' ELSE 'fulltext_no_finding' END AS status,
  CASE WHEN doc_id % 13 = 0 THEN 'download_failed' WHEN doc_id % 17 = 0 THEN 'empty_text_pdf' WHEN failed THEN 'single_model_request_failed' END AS error_type, spans, findings, number AS citation_index FROM j"""


@query(_full_analysis_sql())
def full_analysis(spark, sf_dir):
    from ..operators import semantics
    from . import analysis

    d = F.col("doc_id")
    docs = A.table(spark, sf_dir, "documents")
    downloads = docs.select("doc_id", (d % 13 != 0).alias("ok"), F.when(d % 13 == 0, "download_failed").alias("error_type"))
    extraction = docs.where("doc_id % 13 <> 0").select("doc_id", F.when(d % 17 == 0, "empty_text_pdf").alias("error_type"))
    k = F.col("doc_id") + F.col("seq")
    text = F.when(k % 11 == 0, F.concat(F.lit("References\n\n"), "text")).otherwise(F.col("text"))
    pages = A.marked(spark, sf_dir).select("doc_id", F.col("seq").alias("page"), text.alias("text"))
    contexts = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("context_id"), "text")

    def analyse(spans):  # a model that fails on some papers
        lost = spans.where("doc_id % 19 = 0").select("doc_id", F.lit("single_model_request_failed").alias("error_type")).distinct()
        return semantics.cue_findings(spans.where("doc_id % 19 <> 0")).unionByName(lost, allowMissingColumns=True)

    return analysis.analyse_papers(pages, TITLE, DOI, contexts, downloads, extraction, analyse)
