"""Prompts of the semantic analysis, its modes, and what is read from a chat response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Budgets in characters, modes, and the texts of prompts.
SPANS, WINDOW_CHARS, RAW_CHARS, PROMPT_CHARS, FULLTEXT_CHARS = 4, 1800, 1200, 9000, 90_000
MODES = {"": "single_model", "single_model": "single_model", "legacy_two_stage": "legacy_two_stage"}
WINDOW_HEAD = "局部上下文如下：\n"
HEAD = "目标论文标题：%s\n目标论文年份：%s\n目标论文别名/缩写：%s\n引用论文标题：%s\n"
SPANS_HEAD, SPANS_TAIL = "\n下面是从引用论文全文中筛出的候选段落：\n", "\n\n请根据这些段落判断是否真正引用了目标论文，并按指定格式输出自然语言分析。\n"
NO_ALIAS = "无"


def mode_of(value: Column) -> Column:
    """The analysis mode that a setting names; null for one that does not exist."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.try_element_at(F.create_map(*(F.lit(x) for p in MODES.items() for x in p)), v)


def numbered_pages(pages: DataFrame) -> DataFrame:
    """Pages with text (doc_id, ord from 1, page_text, text) and their number: their own if it is one, else their place."""
    own = F.when(F.trim("page_text").rlike(r"^[+-]?[0-9]{1,9}$"), F.trim("page_text").cast("int"))
    blank = r"(?U)^\s+|\s+$"
    return pages.select("doc_id", "ord", F.coalesce(own, F.col("ord")).alias("page"), F.regexp_replace(F.coalesce("text", F.lit("")), blank, "").alias("text")).where("text <> ''")


def _within(blocks: DataFrame, budget: int) -> DataFrame:
    """Blocks (doc_id, place, block) of each document, joined; what exceeds the budget is cut."""
    before = F.coalesce(F.sum(F.length("block")).over(Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fit = blocks.withColumn("before", before).where(F.col("before") < budget)
    cut = fit.select("doc_id", F.struct("place", F.expr(f"substring(block, 1, int({budget} - before))").alias("block")).alias("x"))
    parts = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["block"])  # bounded by the budget
    return cut.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("blocks"))


def span_blocks(spans: DataFrame) -> DataFrame:
    """The first spans of each document as text blocks under a line of their own."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    head = F.format_string("[Page %s | Span %s | score=%s | type=%s | evidence=%s | hits=%s]\n", *(F.col(c).cast("string") for c in ("page", "span_index", "score", "match_type")), listed(F.col("evidence")), listed(F.col("keyword_hits")))
    window = F.trim(F.coalesce("window_text", F.lit("")))
    body = F.when(window != "", F.concat(F.lit(WINDOW_HEAD), F.substring(window, 1, WINDOW_CHARS))).otherwise(F.substring("text", 1, RAW_CHARS))
    return spans.where(F.col("place") <= SPANS).select("doc_id", "place", F.concat(head, body).alias("block"))


def span_prompts(papers: DataFrame, spans: DataFrame, title: str, year: str, aliases: list[str]) -> DataFrame:
    """doc_id and prompt of each paper (doc_id, title) that has spans."""
    head = F.format_string(HEAD, F.lit(title), F.lit(year), F.lit(", ".join(aliases) or NO_ALIAS), F.coalesce("title", F.lit("")))
    rows = papers.join(_within(span_blocks(spans), PROMPT_CHARS), "doc_id")
    return rows.select("doc_id", F.concat(head, F.lit(SPANS_HEAD), "blocks", F.lit(SPANS_TAIL)).alias("prompt"))


def fulltext_blocks(pages: DataFrame, budget: int = FULLTEXT_CHARS) -> DataFrame:
    """doc_id and the pages of each document within the budget of the full-text scope."""
    block = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), "text", F.lit("\n"))
    return _within(numbered_pages(pages).select("doc_id", F.col("ord").alias("place"), block.alias("block")), budget)


def chat_output(response: Column, reasoning_counts: bool) -> dict[str, Column]:
    """Columns of a chat response's JSON: the text to read, where it came from, how it ended."""
    part = lambda path: F.trim(F.coalesce(F.get_json_object(response, f"$.choices[0].{path}"), F.lit("")))
    content, thought = part("message.content"), part("message.reasoning_content")
    source = (
        F.when(content != "", "content").when(thought == "", "blank")
        .otherwise(F.lit("reasoning_content" if reasoning_counts else "reasoning_content_ignored"))
    )
    text = F.when(content != "", content).when(F.lit(reasoning_counts), thought).otherwise("")
    return {"analysis_text": text, "output_source": source, "finish_reason": F.get_json_object(response, "$.choices[0].finish_reason"), "content_len": F.length(content), "reasoning_len": F.length(thought)}
