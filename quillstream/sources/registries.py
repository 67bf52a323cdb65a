"""Registry sources: JSON, CSV, award tables, wiki tables and free-text lists of fellows.

Readers use explicit schemas; bad rows go, files that hold nothing give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Tag types that may be imported, and words that are no names.
SUPPORTED = "acm_fellow ieee_fellow cas_academician cae_academician top_school".split()
HEADINGS = "name award year region dl".split()
NO_NAME = r"(?iU)\b(visit|view|include|includes|recommended|elevated)\b"

_ITEM = "name string, tag_type string, tier string, category string, source string, aliases array<string>, matched_affiliations array<string>, source_links array<string>, note string, tags array<struct<type:string,label:string,source_links:array<string>,note:string>>"
ENTRY = ["name", "tag_type", "aliases", "source_links", "matched_affiliations", "note"]


def as_list(c: Column) -> Column:
    """Parts of a text list separated by ; or |."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;|]"), lambda x: F.trim(x)), lambda x: x != ""))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON files that hold a list or an object with ``items``, in order."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    listed = F.from_json("value", f"array<struct<{_ddl()}>>")
    wrapped = F.from_json("value", f"struct<items:array<struct<{_ddl()}>>>")
    items = F.when(F.ltrim("value").startswith("["), listed).otherwise(wrapped["items"])
    return text.select("file", F.posexplode(items).alias("ord", "item")).where(F.col("item").isNotNull()).select("file", "ord", "item.*")


def _ddl() -> str:
    import re

    return re.sub(r"(^|, )(\w+) ", r"\1\2:", _ITEM)


def entries(items: DataFrame) -> DataFrame:
    """Importable registry entries: trimmed names, supported tags, distinct lists."""
    none = F.array().cast("array<string>")
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, none), lambda x: F.trim(x)), lambda x: x != ""))
    rows = items.select(F.trim("name").alias("name"), F.trim("tag_type").alias("tag_type"), *(clean(F.col(c)).alias(c) for c in ("aliases", "source_links", "matched_affiliations")), F.trim(F.coalesce("note", F.lit(""))).alias("note"))
    return rows.where((F.col("name") != "") & F.col("tag_type").isin(SUPPORTED))


def expand_tags(items: DataFrame) -> DataFrame:
    """One row per person and tag; entries without tags use their flat fields."""
    flat = F.array(F.struct(F.col("tag_type").alias("type"), F.lit(None).cast("string").alias("label"), F.col("source_links").alias("source_links"), F.col("note").alias("note")))
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<struct<type:string,label:string,source_links:array<string>,note:string>>"))) > 0, F.col("tags")).otherwise(flat)
    return items.select("name", "aliases", "matched_affiliations", F.explode(tags).alias("tag")).where(F.trim(F.coalesce("tag.type", F.lit(""))) != "").select("name", "aliases", "matched_affiliations", F.col("tag.type").alias("tag_type"), F.col("tag.source_links").alias("source_links"), F.coalesce("tag.note", F.lit("")).alias("note"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of CSV files with a header; a byte order mark is dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = raw.toDF(*(c.lstrip("\ufeff").strip() for c in raw.columns))
    col = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    return entries(raw.select(col("name").alias("name"), col("tag_type").alias("tag_type"), *(as_list(col(c)).alias(c) for c in ("aliases", "source_links", "matched_affiliations")), col("note").alias("note")))


def first_by_name(rows: DataFrame) -> DataFrame:
    """The first row (file, ord) of each compact name."""
    place = F.row_number().over(Window.partitionBy(X.norm_name("name")).orderBy("file", "ord"))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-empty lines of text files: file, ord, line."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n")).alias("ord", "raw"))
    return text.select("file", "ord", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("line")).where("line <> ''")


def award_table(lines: DataFrame, award: str = "ACM Fellows", tag_type: str = "acm_fellow", label: str = "ACM Fellow", link: str = "") -> DataFrame:
    """Entries of a copied award table: tabbed cells or spaced text with a year."""
    cells = F.transform(F.split("line", "\t"), lambda x: F.trim(x))
    tabbed = F.col("line").contains("\t")
    year_cell = F.coalesce(F.try_element_at(cells, F.lit(3)), F.lit(""))
    spaced = rf"^(.+?)\s+{award}\s+(\d{{4}})(?:\s+.*)?$"
    fits = F.when(tabbed, (F.coalesce(F.try_element_at(cells, F.lit(2)), F.lit("")) == award) & year_cell.rlike(r"^\d{4}$")).otherwise(F.col("line").rlike(spaced))
    name = F.when(tabbed, F.element_at(cells, 1)).otherwise(F.regexp_extract("line", spaced, 1))
    year = F.when(tabbed, year_cell).otherwise(F.regexp_extract("line", spaced, 2))
    rows = lines.where(fits).select("file", "ord", name.alias("name"), year.alias("year")).where((F.col("name") != "") & ~X.norm_name("name").isin(HEADINGS))
    return first_by_name(rows).select("name", F.lit(tag_type).alias("tag_type"), F.concat(F.lit(f"{label}, elected "), "year").alias("note"), F.lit(link).alias("source_link"))


def wiki_table(lines: DataFrame, society: str = "Computer Society") -> DataFrame:
    """Entries of tabbed wiki rows: year, name cells, then the citation that starts with 'for '."""
    cells = F.filter(F.transform(F.split("line", "\t"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), lambda c: c != "")
    rows = lines.where(F.col("line").contains("\t")).select("file", "ord", cells.alias("cells")).where((F.size("cells") >= 2) & F.element_at("cells", 1).rlike(r"^\d{4}$"))
    rest = F.slice("cells", F.lit(2), F.size("cells"))
    starts = F.transform(rest, lambda c: F.lower(c).startswith("for "))
    at = F.array_position(starts, F.lit(True)).cast("int")
    names = F.when(at > 1, F.array_join(F.slice(rest, F.lit(1), at - 1), " ")).when(at == 0, F.element_at(rest, 1)).otherwise("")
    said = F.when(at > 0, F.array_join(F.slice(rest, F.greatest(at, F.lit(1)), F.size(rest)), " ")).otherwise(F.array_join(F.slice(rest, F.lit(2), F.size(rest)), " "))
    found = rows.select("file", "ord", F.trim(F.regexp_replace(F.regexp_replace(names, r"\[[^\]]+\]", ""), r"\s+", " ")).alias("name"), F.element_at("cells", 1).alias("year"), said.alias("citation")).where("name <> ''")
    return first_by_name(found).select("name", F.lit("ieee_fellow").alias("tag_type"), "year", "citation", F.lit(society).alias("society"))


def fellow_list(lines: DataFrame) -> DataFrame:
    """Entries of free text: a name, a dash or blank, and 'for ...'."""
    line = F.regexp_replace(F.regexp_replace("line", r"\s+", " "), r"^[*•]\s+", "")
    rows = lines.withColumn("line", line)
    plain, review = r"(?i)^(.+?)(?:\s+[–—-]\s+|\s+)(for\s+.+)$", r"(?i)^(.+?)\s+[–—-]\s+(\(?Fellow citation under review.+)$"
    pattern = lambda k: F.when(F.col("line").rlike(plain), F.regexp_extract("line", plain, k)).when(F.col("line").rlike(review), F.regexp_extract("line", review, k))
    found = rows.select("file", "ord", F.regexp_replace(pattern(1), r"^[ \-*•]+|[ \-*•]+$", "").alias("name"), F.trim(pattern(2)).alias("citation"))
    found = found.where(F.col("name").isNotNull() & (F.col("name") != "") & (F.length("name") <= 100) & ~F.col("name").rlike(NO_NAME))
    return first_by_name(found).select("name", F.lit("ieee_fellow").alias("tag_type"), "citation")


def text_entries(lines: DataFrame) -> dict[str, DataFrame]:
    """Text sources (file, ord, line) by what they hold: an award table, a wiki table or a list of fellows.

    A file is known by the words in it; one without any of them gives nothing.
    """
    has = lambda w: F.max(F.col("line").contains(w)).alias(w.split()[0].lower())
    marks = lines.groupBy("file").agg(has("ACM Fellows"), has("Year"), has("Fellow"), has("Citation"), has("IEEE Computer Society"))
    kind = F.when(F.col("acm"), "award_table").when(F.col("year") & F.col("fellow") & F.col("citation"), "wiki_table").when(F.col("ieee") & F.col("fellow"), "fellow_list")
    known = lines.join(marks.select("file", kind.alias("kind")).where("kind IS NOT NULL"), "file")
    of = lambda k: known.where(F.col("kind") == k).drop("kind")
    return {"award_table": award_table(of("award_table")), "wiki_table": wiki_table(of("wiki_table")), "fellow_list": fellow_list(of("fellow_list"))}


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of a source folder by the suffix of its files: name, tag_type, note.

    JSON and CSV files hold entries, text files one of the known tables. Hidden files and
    READMEs are passed over, and a kind of file of which there is none gives nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select(F.col("path").alias("file")).where(~F.lower(F.regexp_extract("file", "([^/]*)$", 1)).rlike(r"^(\.|readme\.md$)"))
    suffix = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    paths: dict[str, list[str]] = {}
    for r in files.select("file", suffix.alias("s")).orderBy("file").collect():  # names of the files of one folder
        paths.setdefault(r.s, []).append(r.file)
    parts = []
    if paths.get("json"):
        parts.append(entries(read_json(spark, paths["json"])).select("name", "tag_type", "note"))
    if paths.get("csv"):
        parts += [read_csv(spark, p).select("name", "tag_type", "note") for p in paths["csv"]]
    if texts := paths.get("txt", []) + paths.get("tsv", []):
        found = text_entries(read_lines(spark, texts))
        said = lambda df: df.select("name", "tag_type", F.col("citation").alias("note"))
        parts += [found["award_table"].select("name", "tag_type", "note"), said(found["wiki_table"]), said(found["fellow_list"])]
    rows = spark.createDataFrame([], "name string, tag_type string, note string")
    for p in parts:
        rows = rows.unionByName(p)
    return rows


def env_values(lines: DataFrame) -> DataFrame:
    """Settings of env files (file in reading order, ord, line): the last value of each key."""
    line = F.trim("line")
    rows = lines.where((line != "") & ~line.startswith("#") & line.contains("="))
    key, value = F.trim(F.substring_index(line, "=", 1)), F.trim(F.regexp_replace(line, "^[^=]*=", ""))
    bare = F.regexp_replace(F.regexp_replace(value, r'^"+|"+$', ""), "^'+|'+$", "")
    return rows.select("file", "ord", key.alias("key"), bare.alias("value")).where("key <> ''").groupBy("key").agg(F.max_by("value", F.struct("file", "ord")).alias("value"))
