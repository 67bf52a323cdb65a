"""People and institutions: registry joins, candidate merging and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Groups of the person statistics, in display order.
PERSON_GROUPS = [("acm_fellow", "ACM Fellow"), ("ieee_fellow", "IEEE Fellow"), ("cas_academician", "中国科学院院士"), ("cae_academician", "中国工程院院士"), ("top_school", "国外牛校作者")]


def match_people(authors: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered people among the authors of papers, by shared name variants.

    ``authors``: paper, author, affiliation. ``registry``: name, aliases, affiliations, tag_type.
    Variants of distinct author names meet the registry's; one row for each
    paper, author and entry, with how the name matched and whether an affiliation confirms it.
    """
    known = registry.select("*", F.array_distinct(F.flatten(F.transform(F.concat(F.array("name"), "aliases"), X.name_variants))).alias("variants"))
    names = authors.select("author").distinct().select("author", F.explode(X.name_variants("author")).alias("variant"))
    entries = known.select("name", "aliases", "affiliations", "tag_type", F.explode("variants").alias("variant"))
    meets = names.join(entries, "variant").groupBy("author", "name", "aliases", "affiliations", "tag_type").agg(F.min("variant").alias("variant"))
    how = (
        F.when(X.norm_name("author") == X.norm_name("name"), "exact_name")
        .when(F.exists("aliases", lambda a: X.norm_name(a) == X.norm_name("author")), "alias")
        .otherwise("name_variant")
    )
    confirmed = F.exists("affiliations", lambda t: X.norm_ref("affiliation").contains(t))
    return authors.join(meets, "author").select(
        "paper", "author", "name", "tag_type", "variant", how.alias("match_type"), F.coalesce(confirmed, F.lit(False)).alias("affiliation_match")
    )


def candidates(matches: DataFrame) -> DataFrame:
    """One candidate per person and tag: papers, homonym risk and match types."""
    key = F.concat(F.col("tag_type"), F.lit("::"), X.slug("name"))
    return matches.groupBy(key.alias("candidate_id"), "name", "tag_type").agg(
        F.countDistinct("paper").alias("paper_count"), F.min("paper").alias("first_paper"),
        F.bool_or(~F.col("affiliation_match")).alias("homonym_risk"), F.array_join(F.array_sort(F.collect_set("match_type")), ",").alias("match_types"),
    )


def person_statistics(people: DataFrame, hits: DataFrame) -> DataFrame:
    """Counts of each group, empty groups included; rejected candidates do not count.

    ``people``: candidate_id, tag_type, status, source_link. ``hits``: candidate_id, paper.
    """
    groups = people.sparkSession.createDataFrame([(k, t, label) for k, (t, label) in enumerate(PERSON_GROUPS)], "group_ord int, tag_type string, label string")
    active = people.where("status <> 'rejected'")
    counts = active.groupBy("tag_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("source_link") != "").alias("source_ready")
    )
    papers = active.select("candidate_id", "tag_type").join(hits, "candidate_id").groupBy("tag_type").agg(F.countDistinct("paper").alias("papers"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return F.broadcast(groups).join(counts, "tag_type", "left").join(papers, "tag_type", "left").select("group_ord", "tag_type", *map(zero, ("n", "confirmed", "pending", "source_ready", "papers")))


def match_institutions(rows: DataFrame, registry: DataFrame, affiliation: str = "affiliation") -> DataFrame:
    """The first institution, in registry order, that a raw affiliation names.

    Compact names of at most four characters must stand alone in the raw text; longer ones
    may be part of its compact form. Only distinct affiliations meet the registry, in an equality
    join: on the first five characters of a longer name, the first word of a short one, or its
    first character where it has no Latin word.
    """
    names = registry.select("ord", F.col("name").alias("institution"), F.posexplode(F.concat(F.array("name"), "aliases")).alias("name_ord", "known"))
    small = X.norm_name("known")
    word = F.regexp_extract(F.lower("known"), "([a-z0-9]+)", 1)
    first = F.when(F.length(small) > 4, F.concat(F.lit("g"), F.substring(small, 1, 5))).when(word != "", F.concat(F.lit("w"), word)).otherwise(F.concat(F.lit("c"), F.substring(F.lower(F.trim("known")), 1, 1)))
    compact, lower = X.norm_name("raw"), F.lower("raw")
    grams = F.when(F.length(compact) >= 5, F.transform(F.sequence(F.lit(1), F.length(compact) - 4), lambda i: F.concat(F.lit("g"), F.substring(compact, i, F.lit(5))))).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.regexp_extract_all(lower, F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.concat(F.lit("w"), w))
    others = F.transform(F.regexp_extract_all(lower, F.lit("([^a-z0-9])"), F.lit(1)), lambda c: F.concat(F.lit("c"), c))
    raw = rows.select(F.col(affiliation).alias("raw")).distinct().select("raw", F.explode(F.array_distinct(F.concat(grams, words, others))).alias("key"))
    pairs = raw.join(names.select("*", first.alias("key")), "key").drop("key").distinct()
    alone = F.rlike(lower, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.lower(F.trim("known")), F.lit(r"\E($|[^a-z0-9])")))
    found = pairs.where((small != "") & F.when(F.length(small) <= 4, alone).otherwise(X.norm_name("raw").contains(small)))
    place = F.row_number().over(Window.partitionBy("raw").orderBy("ord", "name_ord"))
    first = found.withColumn("place", place).where("place = 1").select(F.col("raw").alias(affiliation), "institution", F.col("known").alias("matched_name"))
    return rows.join(first, affiliation, "left")


def merge_authors(own: DataFrame, foreign: DataFrame) -> DataFrame:
    """Author details of papers, own ones first, merged with foreign ones on the lower-case name.

    Institutions are united without regard to case, in order of appearance.
    """
    key = F.lower(F.trim("author"))
    rows = own.select("paper", key.alias("key"), "author", "institution", "ord", F.lit(0).alias("side")).unionByName(foreign.select("paper", key.alias("key"), "author", "institution", "ord", F.lit(1).alias("side")))
    first = F.min(F.struct("side", "ord", F.trim("author").alias("author"))).alias("f")
    names = rows.where("key <> ''").groupBy("paper", "key").agg(first)
    once = rows.where("key <> '' AND trim(institution) <> ''").groupBy("paper", "key", F.lower(F.trim("institution")).alias("low")).agg(F.min(F.struct("side", "ord", F.trim("institution").alias("institution"))).alias("i"))
    lists = once.groupBy("paper", "key").agg(F.array_sort(F.collect_list("i")).alias("items")).select("paper", "key", F.array_join(F.transform("items", lambda x: x["institution"]), "|").alias("institutions"))
    place = F.row_number().over(Window.partitionBy("paper").orderBy("f.side", "f.ord"))
    return names.join(lists, ["paper", "key"], "left").select("paper", place.alias("place"), "f.author", F.coalesce("institutions", F.lit("")).alias("institutions"))


def merge_registry(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by (tag_type, compact name): lists united in order, notes appended once.

    Both: tag_type, name, aliases, note. ``change`` tells what happened to each row.
    """
    key = [F.col("tag_type"), X.norm_name("name").alias("key")]
    a = existing.select(*key, F.col("name").alias("a_name"), F.col("aliases").alias("a_aliases"), F.col("note").alias("a_note"))
    b = incoming.select(*key, F.col("name").alias("b_name"), F.col("aliases").alias("b_aliases"), F.col("note").alias("b_note"))
    none = F.array().cast("array<string>")
    note = (
        F.when(F.coalesce("b_note", F.lit("")) == "", F.coalesce("a_note", F.lit("")))
        .when(F.coalesce("a_note", F.lit("")) == "", F.col("b_note"))
        .when(F.col("a_note").contains(F.col("b_note")), F.col("a_note"))
        .otherwise(F.concat("a_note", F.lit("；"), "b_note"))
    )
    change = F.when(F.col("a_name").isNull(), "added").when(F.col("b_name").isNull(), "kept").otherwise("updated")
    return a.join(b, ["tag_type", "key"], "full_outer").select(
        "tag_type", F.coalesce("a_name", "b_name").alias("name"), F.array_distinct(F.concat(F.coalesce("a_aliases", none), F.coalesce("b_aliases", none))).alias("aliases"), note.alias("note"), change.alias("change")
    )


def merge_candidates(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """Candidates of one id in one session become one: lists united in order, notes appended once.

    ``rows``: session, candidate_id, ord, paper, affiliation, source_link, note, status. ``prior``
    (session, candidate_id, status, review_note) holds what a reviewer has decided. Lists hold
    what a session's papers name.
    """
    key = ["session", "candidate_id"]

    def united(c: str) -> DataFrame:
        once = rows.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").groupBy(*key, c).agg(F.min("ord").alias("ord"))
        return once.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]).alias(f"{c}s"))

    # a note that repeats adds nothing, so of equal notes the first is enough
    notes = rows.where(F.coalesce("note", F.lit("")) != "").groupBy(*key, "note").agg(F.min("ord").alias("ord"))
    listed = notes.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "note"))), lambda x: x["note"]).alias("n"))
    joined = F.aggregate("n", F.lit(""), lambda a, n: F.when(a.contains(n), a).when(a == "", n).otherwise(F.concat(a, F.lit("；"), n)))
    found = rows.groupBy(*key).agg(F.count("*").alias("evidence_count"), F.min_by("status", "ord").alias("own_status"))
    for part in (united("paper"), united("affiliation"), united("source_link"), listed.select(*key, joined.alias("note"))):
        found = found.join(part, key, "left")
    decided = prior.select(*key, F.col("status").alias("prior_status"), "review_note")
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    return found.join(decided, key, "left").select(
        *key, "evidence_count", "papers", "affiliations", "source_links", F.coalesce("note", F.lit("")).alias("note"),
        F.coalesce(said("prior_status"), said("own_status"), F.lit("pending")).alias("status"), F.coalesce("review_note", F.lit("")).alias("review_note"),
    )
