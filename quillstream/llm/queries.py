"""The queries of the thirteen operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, html_extract, langid, mixing, near_dedup, packing, pieces, quality, resampling, sharding, suffix_dedup, topk

#: Vocabulary files of public tokenizers; a parameter of the operators.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = quality.remainder(4) == 2
    learned = langid.learn(docs.select("doc_id", "text", "lang").where(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), learned)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(quality.training_rows(docs), quality.training_rows(labels))
    return quality.score_quality(docs, model).select(
        "doc_id", (quality.remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_documents(spark, sf_dir).select("doc_id", "text"), PIECE_MODEL, added=pieces.DIGESTS, form=pieces.Encoded.digests)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), 3, 85, 100)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words
), items AS (SELECT doc_id, unnest(s) AS item FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b USING (item) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""


def packed(docs: DataFrame) -> DataFrame:
    """One row per piece, with the digest of its ids instead of the ids."""
    found = packing.window_pieces(docs, WORD_MODEL)
    digests = found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests, *packing.extent(docs))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def packing_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of op7_packing, as one row: documents, and how often it does not."""
    found = op7_packing(spark, sf_dir)
    docs = found.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.max(F.col("start") + F.col("length")).alias("end"), F.min("start").alias("begin"), F.countDistinct("start").alias("starts"), F.count("*").alias("pieces"))
    chained = (F.col("n") == F.col("all")) & (F.col("end") == F.col("all")) & (F.col("begin") == 0) & (F.col("starts") == F.col("pieces"))
    windows = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("offsets"), F.count("*").alias("pieces"))
    filled = (F.col("n") == F.col("end")) & (F.col("end") <= packing.WINDOW) & (F.col("offsets") == F.col("pieces"))
    of_docs = docs.agg(F.count("*").alias("documents"), F.count_if(~chained).alias("broken_documents"))
    of_windows = windows.agg(F.count_if(~filled).alias("broken_sequences"), (F.sum("n") / (packing.WINDOW * F.count("*")) < 0.95).alias("wasteful"))
    both = of_docs.unionByName(of_windows, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


PACKING_INVARIANTS_SQL = "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS broken_documents, 0::BIGINT AS broken_sequences, FALSE AS wasteful FROM documents"


def sharding_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of op8_sharding, as one row: documents and bytes, and how often it does not."""
    found = op8_sharding(spark, sf_dir)
    shards = found.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.max("size").alias("largest"), F.count_if(F.col("law") != "bytes").alias("odd"))
    mean = F.sum("bytes") / 24
    apart = F.greatest(F.max("bytes") - mean, mean - F.min("bytes"))
    return shards.agg(
        F.sum("n").alias("documents"), F.sum("bytes").alias("bytes"), F.count_if((F.col("slots") != F.col("n")) | (F.col("last") != F.col("n") - 1) | ~F.col("shard").between(0, 23) | (F.col("odd") > 0)).alias("broken_shards"),
        (apart > F.greatest(0.01 * mean, F.max("largest"))).alias("uneven"),
    )


SHARDING_INVARIANTS_SQL = "SELECT count(*) AS documents, CAST(sum(octet_length(encode(coalesce(text, ''))) + 8) AS BIGINT) AS bytes, 0::BIGINT AS broken_shards, FALSE AS uneven FROM documents"


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_documents(spark, sf_dir), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_documents(spark, sf_dir))


# a mix of whole targets takes a first part of each source's shuffled line, whatever the order of its blocks
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1, 2][((number - 1) % 3 + 1)::BIGINT] AS weight, 2 * source_size AS cap FROM s
), r AS (
  SELECT *, cap / weight AS ratio, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS goal FROM w
), l AS (
  SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), t AS (
  SELECT source, source_size, CASE WHEN ratio > level THEN weight * max(CASE WHEN ratio > level THEN level END) OVER () ELSE cap::DOUBLE END AS target FROM l
), e AS (
  SELECT d.*, epoch, coalesce(sum(size) OVER (PARTITION BY source, epoch ORDER BY md5('11:' || epoch || ':' || doc_id || ':' || digest || ':0') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d, (VALUES (0), (1)) x(epoch)
)
SELECT doc_id, e.size::BIGINT AS size, source_size, target,
       sum(greatest(0, least(epoch * source_size + before + e.size, floor(target)::BIGINT) - epoch * source_size - before))::BIGINT AS taken
FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source
GROUP BY ALL
"""


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS crc
  FROM range(256) r(i)
), f AS (
  SELECT doc_id, text IS NULL AS missing, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)
), i AS (SELECT doc_id, unnest(w) AS word FROM f
), h AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT)),
                   lambda a, b: xor(crc[xor(a, b) % 256 + 1], a // 256)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM i), crc
), c AS (
  SELECT bucket, count(*) FILTER (doc_id >= 0) AS s, count(*) FILTER (doc_id < 0) AS t FROM i JOIN h USING (word) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000))))::BIGINT AS gain FROM c
), d AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM i JOIN h USING (word) JOIN g USING (bucket) WHERE doc_id >= 0 GROUP BY doc_id
), z AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN d USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS all_of_them FROM z WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, rank
FROM z LEFT JOIN (SELECT doc_id, rank FROM r WHERE rank <= 10 * all_of_them // 100) USING (doc_id)
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), f AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
         map {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
              'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': doc_id > min(doc_id) OVER (PARTITION BY text)} AS fails
  FROM d LEFT JOIN labels USING (doc_id)
), m AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, s::INTEGER AS step, filter_order[s] AS letter, list_transform(range(1, s), lambda k: filter_order[k]) AS before,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: x <> filter_order[s]) AS others
  FROM orders, range(1, 6) r(s)
), p AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails[letter] AS failing,
         len(list_filter(before, lambda x: fails[x])) > 0 AS gone, len(list_filter(others, lambda x: fails[x])) > 0 AS other
  FROM m, steps
), q AS (
  SELECT part, filter_order, step, letter,
         sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (NOT gone AND failing) AS removed, sum(n) FILTER (gone AND failing) AS redundant,
         sum(n) FILTER (failing AND NOT other) AS unique_fails, sum(n) FILTER (NOT gone AND failing AND good) AS good_lost, sum(n) FILTER (NOT gone AND failing AND toxic) AS toxic_lost
  FROM p GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM q
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_langid": op2_langid,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_quality": op4_quality,
        "op5_pieces": op5_pieces,
        "op6_near_dedup": op6_near_dedup,
        "op7_packing": op7_packing,
        "op8_sharding": op8_sharding,
        "op9_html_extract": op9_html_extract,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_mixing": op11_mixing,
        "op12_resampling": op12_resampling,
        "op13_filter_audit": op13_filter_audit,
        "packing_invariants": packing_invariants,
        "sharding_invariants": sharding_invariants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": OP1_SQL,
        "op3_exact_dedup": OP3_SQL,
        "op6_near_dedup": OP6_SQL,
        "op11_mixing": OP11_SQL,
        "op12_resampling": OP12_SQL,
        "op13_filter_audit": OP13_SQL,
        "packing_invariants": PACKING_INVARIANTS_SQL,
        "sharding_invariants": SHARDING_INVARIANTS_SQL,
    }
