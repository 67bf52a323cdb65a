"""Links and text nodes of HTML pages with Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Where pages name their PDF.
PDF_PATTERNS = (
    r"""(?i)<meta[^>]+name=["']citation_pdf_url["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+property=["']og:pdf["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+name=["']dc\.identifier["'][^>]+content=["']([^"']+\.pdf[^"']*)["']""",
    r"""(?i)href=["']([^"']+\.pdf(?:\?[^"']*)?)["']""",
)


def pdf_links(html: Column) -> Column:
    """Links to PDFs in the order of the patterns, each once."""
    found = F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in PDF_PATTERNS))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(F.replace(x, F.lit("&amp;"), F.lit("&")))), lambda x: x != ""))


def text_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Non-empty texts between tags, numbered; scripts and styles left out."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    parts = F.filter(F.transform(F.split(F.regexp_replace(bare, "<[^>]*>", "\u0001"), "\u0001"), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select(key, F.posexplode(parts).alias("at", "text")).select(key, (F.col("at") + 1).alias("seq"), "text")


def with_neighbours(nodes: DataFrame, key: str) -> DataFrame:
    """Each node with the texts before and after it."""
    order = Window.partitionBy(key).orderBy("seq")
    return nodes.withColumn("before", F.lag("text").over(order)).withColumn("after", F.lead("text").over(order))


def award_rows(nodes: DataFrame, key: str, award: str) -> DataFrame:
    """Rows of an award table: the name before the award's label, the year after it."""
    rows = with_neighbours(nodes, key).where((F.col("text") == award) & F.col("after").rlike(r"^\d{4}$"))
    return rows.select(key, F.col("before").alias("name"), F.col("after").cast("int").alias("year"))


# Entities of URLs and cells.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def unescaped(c: Column) -> Column:
    """``c`` with the entities of ``ENTITIES`` read."""
    for name, value in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def joined_url(base: Column, link: Column) -> Column:
    """``link`` as seen from the page ``base``: absolute, by host, by path, or relative with dot segments."""
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    own, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"([?#].*)$", 1)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    step = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.array_append(a, x))
    parts = F.aggregate(F.slice(F.split(whole, "/"), F.lit(2), F.size(F.split(whole, "/"))), F.array().cast("array<string>"), step)
    ends = F.when(F.element_at(F.split(whole, "/"), -1).isin(".", ".."), "/").otherwise("")
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(own == "", F.concat(root, path, rest)).otherwise(F.concat(root, F.lit("/"), F.array_join(parts, "/"), F.when(F.size(parts) > 0, ends).otherwise(""), rest))
    )


def pdf_urls(base: Column, html: Column) -> Column:
    """Absolute URLs of a page's PDFs in the order of the patterns, each once."""
    found = F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in PDF_PATTERNS))
    return F.array_distinct(F.filter(F.transform(found, lambda x: joined_url(base, F.trim(unescaped(x)))), lambda x: x != ""))


def table_lines(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of the pages' wikitables as tabbed lines: key, ord, line."""
    tables = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<table[^>]*class=["'][^"'>]*wikitable[^>]*>(.*?)</table>"""), F.lit(1))
    rows = F.flatten(F.transform(tables, lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1))
    text = lambda c: F.trim(F.regexp_replace(unescaped(F.regexp_replace(c, "<[^>]*>", " ")), r"(?U)\s+", " "))
    lines = F.transform(rows, lambda r: F.array_join(F.transform(cells(r), text), "\t"))
    return pages.select(F.col(key).cast("string").alias("file"), F.posexplode(lines).alias("ord", "line")).where("line <> ''")
