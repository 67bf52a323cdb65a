"""Passages: reference lists, citation markers, neighbours, similarity, merging, budgets.

Paragraphs are rows (doc_id, page, seq, text) with ``seq`` the order within the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import once
from . import similarity as J

#: Patterns of indices, of headings and of the marks that make a page a reference list.
BRACKET_INDEX, LEADING_INDEX = r"\[\s*(\d+)\s*\]", r"(?dm)^\s*(\d+)[.)]\s+"
HEADINGS = (r"(?mi)^\s*(references|bibliography)\s*$", r"(?mi)^\s*[ivxlcdm.\s]*(references|bibliography)\s*$")
LIST_MARKS = {
    "bracket": r"\[\s*\d+\s*\]", "numbered": r"(?m)^\s*\[?\d+\]?[.)]\s+[A-Z]", "doi": r"(?i)10\.\d{4,9}/\S+", "years": r"\b(?:19|20)\d{2}\b",
    "proc": r"\b(?:proc\.?|proceedings|vol\.?|no\.?|pp\.?|doi:)\b",
}
#: Kinds of spans, best first.
PRIORITY = ["citation_index_exact", "citation_index_grouped", "context_similarity", "citation_index_neighbor", "keyword_fallback"]


def priority(match_type: Column | str) -> Column:
    c = F.col(match_type) if isinstance(match_type, str) else match_type
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), c), F.lit(0)) - 1, F.lit(99)).cast("int")


#: Characters from which a page without blank lines is cut into packed sentences.
ROUGH_CHARS = 300


def split_pages(pages: DataFrame) -> DataFrame:
    """Paragraphs of pages (doc_id, page, text): blank lines part them, blanks are squeezed.

    A page of one paragraph and more than ``ROUGH_CHARS`` characters falls into packed sentences.
    """
    whole = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    squeezed = F.transform(F.split("_text", r"\n\s*\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"(?U)^\s+|\s+$", ""))
    rows = once(once(pages, _text=whole), _parts=F.filter(squeezed, lambda x: x != ""))
    rough = F.when((F.size("_parts") <= 1) & (F.length("_text") > ROUGH_CHARS), packed_sentences(F.col("_text")))
    rows = once(rows, _rough=rough)
    parts = F.when(F.size(F.coalesce("_rough", F.array().cast("array<string>"))) > 0, F.col("_rough")).otherwise(F.col("_parts"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "at"))
    return rows.select("doc_id", "page", F.posexplode(parts).alias("at", "text")).select("doc_id", "page", (F.col("at") + 1).alias("span_index"), order.alias("seq"), "text")


def packed_sentences(text: Column, least: int = 350) -> Column:
    """Sentences packed into paragraphs of ``least`` characters or more (the last may be shorter)."""
    # Spark's split has no look-behind trouble: Java supports it
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9\[])"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("size"))

    def step(acc: Column, s: Column) -> Column:
        held = F.when(acc["held"] == "", s).otherwise(F.concat(acc["held"], F.lit(" "), s))
        size = acc["size"] + F.length(s)
        full = size >= least
        return F.struct(
            F.when(full, F.array_append(acc["done"], held)).otherwise(acc["done"]).alias("done"),
            F.when(full, F.lit("")).otherwise(held).alias("held"),
            F.when(full, F.lit(0)).otherwise(size).alias("size"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["held"])))


def reference_start(pages: DataFrame) -> DataFrame:
    """First page of the reference list of each document: by heading, else by density."""
    t, n = F.coalesce(F.col("text"), F.lit("")), X.norm_span("text")
    total = F.max("page").over(Window.partitionBy("doc_id"))
    heading = t.rlike(HEADINGS[0]) | t.rlike(HEADINGS[1])
    counts = [X.count_of(n if name == "proc" else t, pattern).alias(name) for name, pattern in LIST_MARKS.items()]
    f = pages.select("doc_id", "page", total.alias("total"), heading.alias("heading"), *counts)
    dense = ((F.col("bracket") >= 20) & (F.col("years") >= 15)) | ((F.col("numbered") >= 20) & (F.col("years") >= 15)) | ((F.col("doi") >= 2) & (F.col("years") >= 10)) | ((F.col("bracket") + F.col("numbered") >= 30) & (F.col("proc") >= 20))
    after = lambda percent: F.col("page") >= F.greatest(F.lit(2), F.floor(F.col("total") * percent / 100))
    return f.groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(F.col("heading") & after(45), F.col("page"))), F.min(F.when(dense & after(60), F.col("page")))).alias("reference_start")
    )


def citation_hits(paragraphs: DataFrame, index: int) -> DataFrame:
    """Paragraphs with the kind of their citation marker of ``index`` (null: none)."""
    return paragraphs.withColumn("kind", X.citation_hit("text", index))


def neighbour_spans(hits: DataFrame) -> DataFrame:
    """Hits and their neighbours, each paragraph once.

    Hits are visited in order and each takes its neighbourhood, so a paragraph after a hit is
    a neighbour even if it is a hit itself.
    ``hits``: doc_id, seq, kind (null: no hit), reference_like.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    before, after = F.lag("kind").over(order), F.lead("kind").over(order)
    kind = F.when(before.isNotNull(), "citation_index_neighbor").when(F.col("kind").isNotNull(), F.col("kind")).when(after.isNotNull(), "citation_index_neighbor")
    base = F.when(F.col("match_type") == "citation_index_exact", 100).when(F.col("match_type") == "citation_index_grouped", 85).otherwise(60)
    spans = hits.withColumn("match_type", kind).where(F.col("match_type").isNotNull())
    return spans.withColumn("score", base - 50 * F.col("reference_like").cast("int"))


def local_windows(paragraphs: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with the texts around them: two on each side of marked hits, one of others.

    Noisy neighbours are left out, the span itself never is.
    """
    around = Window.partitionBy("doc_id").orderBy("seq")
    item = F.struct("seq", "text", X.is_noisy("text").alias("noisy"))
    rows = paragraphs.withColumn("item", item)
    rows = rows.withColumn("wide", F.collect_list("item").over(around.rowsBetween(-2, 2))).withColumn("near", F.collect_list("item").over(around.rowsBetween(-1, 1)))
    joined = spans.join(rows.select("doc_id", "seq", "wide", "near"), ["doc_id", "seq"], "left")
    chosen = F.when(F.col("match_type").isin("citation_index_exact", "citation_index_grouped"), F.col("wide")).otherwise(F.col("near"))
    shown = F.filter(chosen, lambda x: ~x["noisy"] | (x["seq"] == F.col("seq")))
    return joined.withColumn("window_text", F.array_join(F.transform(shown, lambda x: x["text"]), "\n\n")).withColumn("window_size", F.size(shown)).drop("wide", "near")


def context_similarity(paragraphs: DataFrame, contexts: DataFrame, least_percent: int = 18, k: int = 30) -> DataFrame:
    """Paragraphs that share enough words with a context, the ``k`` best of each document.

    The overlap is that of ``similarity.overlaps``: few contexts are an index in every task, with
    many only words that contexts hold move. Contexts: context_id, text.
    """
    rows = once(paragraphs.select("doc_id", "seq", "text"), plain=X.norm_span("text"))
    p = rows.where(~X.is_reference_entry("text", "plain")).select("doc_id", "seq", F.col("plain").alias("text"), X.plain_tokens("plain").alias("words"))
    c = contexts.select("context_id", X.overlap_tokens("text").alias("words"))
    good = J.overlaps(p, ["doc_id", "seq"], c, "context_id", least_percent, words=X.plain_words).withColumn("overlap", F.col("shared") / F.col("smaller"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("overlap").desc(), "seq", "context_id"))
    return good.withColumn("place", place).where(F.col("place") <= k)


def keyword_fallback(paragraphs: DataFrame, signs: Column, k: int = 20) -> DataFrame:
    """Paragraphs scored by words, names and DOI of the target (``signs``); the ``k`` best of each document."""
    rows = paragraphs.withColumn("_signs", signs)
    score = X.sign_score("text", F.col("_signs"), 8) + F.col("text").rlike(r"\[\d+\]").cast("int") + (F.length("text") > 120).cast("int")
    rows = once(rows, score=score).where((F.col("score") > 0) & ~X.is_reference_entry("text")).drop("_signs")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "seq"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def merge_spans(spans: DataFrame) -> DataFrame:
    """One span per place: best kind and score, all evidence, the greatest overlap.

    ``spans``: doc_id, page, span_index, match_type, score, ord (order of generation),
    overlap (null where it does not apply).
    """
    best = F.min_by(F.struct("match_type", "score"), F.struct(priority("match_type"), (-F.col("score")).alias("s"), "ord")).alias("b")
    return spans.groupBy("doc_id", "page", "span_index").agg(
        best, F.array_join(F.array_sort(F.collect_set("match_type")), ",").alias("evidence"), F.max("overlap").alias("overlap")
    ).select("doc_id", "page", "span_index", "b.match_type", "b.score", "evidence", "overlap")


def final_order(spans: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` first spans of each document in reading priority."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(priority("match_type"), F.col("score").desc(), "page", "span_index"))
    return spans.withColumn("place", place).where(F.col("place") <= k)


def islands(rows: DataFrame) -> DataFrame:
    """Runs of consecutive spans on a page, in the order of the findings (doc_id, ord, page, span_index)."""
    once = rows.groupBy("doc_id", "page", "span_index").agg(F.min("ord").alias("ord"))
    order = Window.partitionBy("doc_id").orderBy("ord")
    same = (F.lag("page").over(order) == F.col("page")) & (F.lag("span_index").over(order) + 1 == F.col("span_index"))
    return once.withColumn("starts", (~F.coalesce(same, F.lit(False))).cast("int")).groupBy("doc_id").agg(
        F.count("*").alias("occurrences"), F.sum("starts").alias("islands"), F.min("page").alias("page_start"), F.max("page").alias("page_end")
    )


def within_budget(rows: DataFrame, budget: int, k: int, each: int) -> DataFrame:
    """The first ``k`` texts of each document, cut to ``each`` characters and to the budget together."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    cut = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).withColumn("block", F.substring("text", 1, each))
    used = F.coalesce(F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("used", used).where(F.col("used") < budget).withColumn("block", F.expr(f"substring(block, 1, cast({budget} - used as int))"))


#: How far before an index (in characters) a sign of the target belongs to the entry before; weights of the rank.
BEFORE, PICKED, INFERRED = (5, 260), 8, 5


def picked_index(text: Column, signs: Column) -> Column:
    """The number of a reference entry, as a struct: picked, style, distance, inferred.

    It is the index nearest to a sign of the target; of equally near ones the first. If the
    nearest sign stands within ``BEFORE`` characters before the index, the entry's own number
    came before the sign and is one less. Without signs the first index counts.
    """
    none = F.lit(None)
    marks = F.array_sort(F.concat(X.marks_of(text, BRACKET_INDEX, "bracket"), X.marks_of(text, LEADING_INDEX, "leading_number")))

    def places(plain: Column) -> Column:
        words = F.transform(F.filter(F.array_append(signs["keywords"], signs["doi"]), lambda w: w != ""), lambda w: X.places_of(plain, w))
        names = F.transform(signs["all_names"], lambda a: X.places_of(plain, a["plain"], bounded=True))
        return F.flatten(F.concat(words, names))

    def near(found: Column) -> Column:
        marks, at = found["marks"], found["at"]
        nearest = F.array_min(F.transform(marks, lambda m: F.struct(F.array_min(F.transform(at, lambda s: F.abs(m["pos"] - s))).alias("d"), m["pos"].alias("pos"), m["number"].alias("number"), m["style"].alias("style"))))

        def tell(best: Column, sign: Column) -> Column:
            number = best["number"].try_cast("decimal(38,0)")
            before = (best["pos"] - sign).between(*BEFORE) & F.coalesce(number > 1, F.lit(False))
            return F.struct(F.when(before, (number - 1).cast("string")).otherwise(best["number"]).alias("picked"), best["style"].alias("style"), F.abs(best["pos"] - sign).alias("distance"), before.alias("inferred"))

        closest = lambda best: F.array_min(F.transform(at, lambda s: F.struct(F.abs(best["pos"] - s).alias("d"), s.alias("at"))))["at"]
        told = X.let(nearest, lambda best: X.let(closest(best), lambda sign: tell(best, sign)))
        first = F.get(marks, F.lit(0))
        untold = F.struct(first["number"].alias("picked"), first["style"].alias("style"), none.cast("int").alias("distance"), F.lit(False).alias("inferred"))
        return F.when((F.size(marks) > 0) & (F.size(at) > 0), told).otherwise(untold)

    return X.let(F.struct(marks.alias("marks"), X.let(X.norm_span(text), places).alias("at")), near)


def best_reference(rows: DataFrame, signs: Column) -> DataFrame:
    """The reference entry of the target (``signs``) in each document and its number.

    ``rows``: doc_id, page, span_index, text of the reference section.
    """
    rows = rows.withColumn("_signs", signs)
    score = X.sign_score("text", F.col("_signs"), 15) + 2 * X.is_reference_entry("text").cast("int")
    scored = once(once(rows, score=score).where("score > 0"), p=picked_index(F.coalesce("text", F.lit("")), F.col("_signs"))).select("*", "p.*")
    rank = F.col("score") + F.when(F.col("picked").isNotNull(), PICKED).otherwise(0) + F.when(F.col("inferred"), INFERRED).otherwise(0)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("rank_score").desc(), "page", "span_index"))
    best = scored.withColumn("rank_score", rank).withColumn("place", place).where("place = 1 AND picked IS NOT NULL")
    return best.select("doc_id", "page", "span_index", F.col("picked").alias("citation_index"), "style", "inferred", "score", "rank_score")
