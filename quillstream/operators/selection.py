"""Choosing papers from what a user writes: ordinals, titles, keywords."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import checkpointed, ship

#: Chinese numerals and words that join several references.
NUMERALS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
MULTI_CUE = "[、,/，]|以及|和|及|还有"
STOP = "the and for with from into using based paper model models method methods study analysis".split()
LEAST, CLOSE = 24, 10


def ordinal(raw: Column) -> Column:
    """1 to 99 in Arabic or Chinese numerals; null if it is none."""
    digit = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for p in NUMERALS.items() for x in p]), F.substring(raw, k, 1))
    n = F.length(raw)
    return (
        F.when(raw.rlike(r"^\d+$"), raw.try_cast("int"))
        .when((n == 1) & (raw == "十"), 10)
        .when(n == 1, digit(1))
        .when((n == 2) & (F.substring(raw, 1, 1) == "十"), 10 + digit(2))
        .when((n == 2) & (F.substring(raw, 2, 1) == "十"), 10 * digit(1))
        .when((n == 3) & (F.substring(raw, 2, 1) == "十"), 10 * digit(1) + digit(3))
    )


def message_ids(text: Column | str) -> Column:
    """Paper ids that a message names by ordinal."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"第\s*([0-9一二两三四五六七八九十]+)\s*篇"), F.lit(1))
    return F.transform(F.filter(F.transform(raw, ordinal), lambda n: n.isNotNull()), lambda n: F.format_string("P%03d", n))


def paper_aliases(papers: DataFrame) -> DataFrame:
    """id, normalised title, aliases and at most eight keywords of each paper."""
    head = F.trim(F.get(F.filter(F.split("title", r"[:：\-|/]"), lambda p: F.trim(p) != ""), F.lit(0)))
    words = F.filter(X.tokens(X.norm_ref("title")), lambda w: ((F.length(w) >= 3) | w.rlike(r"^\d+$")) & ~w.isin(STOP))
    n = X.norm_ref("title")
    rows = papers.where(F.trim("title") != "")
    return rows.select("id", "title", n.alias("normal"), F.array_distinct(F.array(n, X.norm_ref(head))).alias("aliases"), F.slice(F.array_distinct(words), 1, 8).alias("keywords"))


#: Patterns of this length and more count wherever they stand in a message, shorter ones as whole words.
LONG = 5
#: Patterns up to this many are searched by one automaton, which every task holds; beyond it messages and patterns meet by grams.
AUTOMATON_PATTERNS = 200_000


def _patterns(aliases: DataFrame) -> DataFrame:
    """id, kind (title, alias or keyword), at (its order) and pattern: all that a message may name a paper by."""
    each = lambda kind, values: aliases.select("id", F.lit(kind).alias("kind"), F.posexplode(values).alias("at", "pattern"))
    titles = each("title", F.filter(F.array("normal"), lambda x: F.length(x) >= 6))
    names = each("alias", F.filter("aliases", lambda x: F.length(x) >= LONG))
    return titles.unionByName(names).unionByName(each("keyword", F.col("keywords")))


def _by_automaton(said: DataFrame, wanted: list[str]) -> DataFrame:
    """Pairs (key, pattern): which of the long patterns stand in which message, in one pass over each message."""
    spark = ship(said.sparkSession)
    shared = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, pattern in enumerate(shared.value):
            machine.add_word(pattern, k)
        if shared.value:
            machine.make_automaton()
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("said").to_pylist(), strict=True):
                hits = {k for _, k in machine.iter(text)} if shared.value else set()
                keys += [key] * len(hits)
                found += [shared.value[k] for k in sorted(hits)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "pattern"])

    return said.select("key", "said").mapInArrow(run, "key binary, pattern string")


def _by_grams(said: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for any number of patterns: a pattern in a message shows its first ``LONG`` characters there.

    What moves are hashes of grams with the message's key; texts meet patterns once a message.
    """
    starts = wanted.select("pattern", F.xxhash64(F.substring("pattern", 1, LONG)).alias("gram"))
    run = F.transform(F.sequence(F.lit(1), F.length("said") - (LONG - 1)), lambda i: F.xxhash64(F.substring("said", i, F.lit(LONG))))
    grams = said.where(F.length("said") >= LONG).select("key", F.explode(F.array_distinct(run)).alias("gram"))
    maybe = grams.join(starts, "gram").groupBy("key").agg(F.collect_set("pattern").alias("patterns"))  # at most what the message's own grams begin
    held = said.join(maybe, "key").select("key", F.explode(F.filter("patterns", lambda x: F.col("said").contains(x))).alias("pattern"))
    return held


def named_in(said: DataFrame, patterns: DataFrame, automaton_patterns: int = AUTOMATON_PATTERNS) -> DataFrame:
    """Pairs (key, pattern) of the messages (key, said) and the patterns (pattern) that stand in them."""
    distinct = checkpointed(patterns.select("pattern").distinct())
    long = distinct.where(F.length("pattern") >= LONG)
    if long.count() <= automaton_patterns:
        inside = _by_automaton(said, [r[0] for r in long.collect()])
    else:
        inside = _by_grams(said, long)
    words = said.select("key", F.explode(F.array_distinct(X.tokens(F.col("said")))).alias("pattern"))
    return inside.unionByName(words.join(distinct.where(F.length("pattern") < LONG), "pattern").select("key", "pattern"))


def score_messages(messages: DataFrame, papers: DataFrame, automaton_patterns: int = AUTOMATON_PATTERNS) -> DataFrame:
    """Scores of papers that messages seem to name (message, text; id, title), with the keywords found.

    Equal messages are scored once. Messages meet the distinct names and keywords, and only what
    stands in them goes on to the papers.
    """
    patterns = _patterns(paper_aliases(papers))
    m = messages.select("message", X.norm_ref("text").alias("said")).withColumn("key", F.unhex(F.md5("said")))
    said = m.groupBy("key").agg(F.first("said").alias("said"))
    hits = named_in(said, patterns, automaton_patterns).join(patterns, "pattern")
    size = lambda kind: F.max(F.when(F.col("kind") == kind, F.length("pattern")))
    rows = hits.groupBy("key", "id").agg(
        size("title").alias("title"), size("alias").alias("alias"), size("keyword").alias("longest"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "keyword", F.struct("at", "pattern")))).alias("found"),
    )
    by_name = F.greatest(F.when(F.col("title").isNotNull(), 120).otherwise(0), F.when(F.col("alias").isNotNull(), 80 + F.least("alias", F.lit(30))).otherwise(0))
    n = F.size("found")
    by_words = F.when(n > 0, 16 * n + F.least("longest", F.lit(20)) + F.when(n >= 2, 20).otherwise(0)).otherwise(0)
    scored = rows.withColumn("score", by_name + by_words).where(F.col("score") >= LEAST).withColumn("found", F.transform("found", lambda x: x["pattern"]))
    return m.join(scored.select("key", "id", "score", "found"), "key").select("message", "id", "score", "found")


def relaxed_matches(messages: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers that share words of four and more characters with messages; the score is their number."""
    words = lambda c: F.explode(F.array_distinct(F.filter(X.tokens(X.norm_ref(c)), lambda w: F.length(w) >= 4))).alias("word")
    pairs = messages.select("message", words("text")).join(papers.select("id", words("title")), "word")
    return pairs.groupBy("message", "id").agg(F.count("*").cast("int").alias("score"))


def _ids(rows: DataFrame, name: str, order: list, k: int | None = None) -> DataFrame:
    """The ids of each message in order, the first ``k`` of them."""
    if k:
        rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("message").orderBy(*order, "id"))).where(F.col("_at") <= k)
    listed = F.array_sort(F.collect_list(F.struct(*order, "id")))
    return rows.groupBy("message").agg(F.transform(listed, lambda x: x["id"]).alias(name))


def resolve(messages: DataFrame, papers: DataFrame) -> DataFrame:
    """What each message selects: message, status (ok, ambiguous or no_match), ids, and up to three matches.

    ``messages``: message, text, ids array (explicit ids come first), top_n (then the first
    papers). ``papers``: ord, id, title. Otherwise scores decide, and where nothing scores
    enough, single shared words. Lists of a message hold what it names, in order.
    """
    told = messages.where(F.size(F.coalesce("ids", F.array().cast("array<string>"))) > 0)
    counted = messages.join(told.select("message"), "message", "left_anti").where(F.coalesce("top_n", F.lit(0)) > 0)
    free = messages.join(told.select("message"), "message", "left_anti").where(F.coalesce("top_n", F.lit(0)) <= 0)
    named = told.select("message", F.posexplode("ids").alias("at", "id")).join(papers.select("id"), "id")
    by_id = told.select("message").join(_ids(named, "ids", ["at"]), "message", "left")
    # papers have places up to the largest number asked for; each message meets as many as it asks for
    most = counted.agg(F.max("top_n")).first()[0] or 0
    first = papers.orderBy("ord").limit(most).select("id", F.row_number().over(Window.orderBy("ord")).alias("at"))
    wanted = counted.select("message", F.explode(F.sequence(F.lit(1), F.least("top_n", F.lit(most)))).alias("at"))
    by_count = counted.select("message").join(_ids(wanted.join(first, "at"), "ids", ["at"]), "message", "left")
    plain = by_id.unionByName(by_count).select("message", F.when(F.size(F.coalesce("ids", F.array().cast("array<string>"))) > 0, "ok").otherwise("no_match").alias("status"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.array().cast("array<string>").alias("matches"))

    scored = score_messages(free, papers).withColumn("down", -F.col("score"))
    top = scored.withColumn("place", F.row_number().over(Window.partitionBy("message").orderBy("down", "id")))
    two = top.where("place <= 2").groupBy("message").agg(F.max(F.when(F.col("place") == 1, F.struct("score", "id"))).alias("best"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    said = free.select("message", F.coalesce("text", F.lit("")).rlike(MULTI_CUE).alias("many"))
    kind = F.when(F.col("many"), "many").when(F.coalesce(F.col("second") >= F.greatest(F.lit(LEAST), F.col("best.score") - CLOSE), F.lit(False)), "ambiguous").otherwise("one")
    judged = two.join(said, "message").select("message", kind.alias("kind"), F.col("best.id").alias("best_id"))
    every = _ids(scored.join(judged.where("kind = 'many'").select("message"), "message", "left_semi"), "every", ["down"])
    three = _ids(scored.join(judged.where("kind = 'ambiguous'").select("message"), "message", "left_semi"), "three", ["down"], 3)
    none = F.array().cast("array<string>")
    by_score = judged.join(every, "message", "left").join(three, "message", "left").select(
        "message", F.when(F.col("kind") == "ambiguous", "ambiguous").otherwise("ok").alias("status"),
        F.when(F.col("kind") == "many", F.col("every")).when(F.col("kind") == "one", F.array("best_id")).otherwise(none).alias("ids"), F.coalesce("three", none).alias("matches"),
    )

    rest = free.join(judged.select("message"), "message", "left_anti")
    loose = relaxed_matches(rest, papers).withColumn("down", -F.col("score"))
    few = _ids(loose, "three", ["down"], 3)
    by_word = rest.select("message").join(few, "message", "left").select(
        "message", F.when(F.col("three").isNull(), "no_match").when(F.size("three") == 1, "ok").otherwise("ambiguous").alias("status"),
        F.when(F.size("three") == 1, F.col("three")).otherwise(none).alias("ids"), F.when(F.size("three") > 1, F.col("three")).otherwise(none).alias("matches"),
    )
    return plain.unionByName(by_score).unionByName(by_word)


def select_papers(messages: DataFrame, papers: DataFrame) -> DataFrame:
    """One row per message with matches: how sure the choice is, how many, which first."""
    scored = score_messages(messages, papers)
    place = F.row_number().over(Window.partitionBy("message").orderBy(F.col("score").desc(), "id"))
    ranked = scored.withColumn("place", place).groupBy("message").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("place") == 1, F.col("id"))).alias("best"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("best_score"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second_score")
    )
    cue = messages.select("message", F.coalesce("text", F.lit("")).rlike(MULTI_CUE).alias("many"))
    state = F.when(F.col("many"), "several").when(F.col("second_score") >= F.greatest(F.lit(LEAST), F.col("best_score") - CLOSE), "ambiguous").otherwise("ok")
    return ranked.join(cue, "message").select("message", "n", "best", "best_score", state.alias("state"))
