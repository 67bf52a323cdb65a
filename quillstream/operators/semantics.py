"""Semantic analysis of passages: cues, chat endpoints with a ladder, tolerant JSON, typed failures.

Nothing raises for a row: what fails is a value of the column error_type, and later stages
skip such rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import checkpointed, once, ship
from . import findings as M
from . import prompts as R

#: Cues of the offline analysis, by aspect, first match first.
CUES = {
    "extension": ("extend", "build on", "builds on"),
    "baseline": ("baseline", "compared", "outperform"),
    "application": ("apply", "applied", "use of"),
    "comparison": ("versus", "unlike", "in contrast"),
    "background": ("the",),
}
#: Tokens that an answer may have, by mode.
ANSWER_TOKENS = {"single_model": 4096, "local": 900, "structuring": 800}
#: Failures of each stage, by mode.
FAILURES = {
    "single_model": {"request": "single_model_request_failed", "parse": "single_model_json_parse_failed", "schema": "single_model_schema_invalid"},
    "local": {"request": "local_model_request_failed"},
    "structuring": {"request": "deepseek_request_failed", "parse": "deepseek_json_parse_failed", "schema": "deepseek_json_parse_failed"},
}
BLANK, NO_TEXT, NO_MODE = "blank_model_output", "fulltext_direct_empty_text", "invalid_analysis_mode"


def cue_findings(spans: DataFrame) -> DataFrame:
    """A finding for each passage (doc_id, page, span_index, text) by keyword cues; an offline stand-in for a model."""
    low = F.lower(F.coalesce("text", F.lit("")))
    has = lambda words: F.greatest(F.lit(False), F.lit(False), *(low.contains(w) for w in words))
    aspect = F.coalesce(*(F.when(has(words), name) for name, words in CUES.items()), F.lit("other"))
    marked = low.contains("[")
    return spans.select(
        "doc_id", "page", "span_index", (marked & (aspect != "other")).alias("keep"), aspect.alias("aspect"), F.when(low.contains("improve"), "positive").otherwise("neutral").alias("stance"),
        F.when(marked, 0.8).otherwise(0.35).alias("confidence"), F.when(marked, "explicit_citation").otherwise("weak_body_mention").alias("mention_type"), F.lit(None).cast("string").alias("error_type"),
    )


# Chat endpoints


def ladder(request: dict) -> list[dict]:
    """The request and its plainer forms, for an endpoint that refuses options: without a response format, then without the thinking switch as well."""
    forms = [request]
    for option in ("response_format", "chat_template_kwargs"):
        if option in forms[-1]:
            forms.append({k: v for k, v in forms[-1].items() if k != option})
    return forms


class Caller:
    """Calls one endpoint from several threads and remembers which options it refuses."""

    def __init__(self, endpoint: Callable[[dict], tuple[int, str]], tries: int = 1):
        self.endpoint, self.tries, self.level = endpoint, tries, 0

    def __call__(self, request: dict) -> tuple[str | None, str | None, int]:
        """Body, error and number of calls. Busy endpoints and exceptions are tried again ``tries`` times in all."""
        forms, calls, error = ladder(request), 0, None
        level, tried = min(self.level, len(forms) - 1), 0
        while True:
            calls += 1
            try:
                status, body = self.endpoint(forms[level])
            except Exception as e:  # a client may raise anything; the row says so
                status, body = None, str(e) or type(e).__name__
            if status == 200:
                self.level = max(self.level, level)
                return body, None, calls
            error = body if status is None else f"status code {status}: {body}"
            if status == 400 and level + 1 < len(forms):
                level += 1
                continue
            tried += 1
            if status not in (None, 429, 503) or tried >= self.tries:
                return None, error, calls


def ask(requests: DataFrame, endpoint: Callable[[dict], tuple[int, str]], model: str = "", max_tokens: int = 1200, json_only: bool = True, no_thinking: bool = False, in_flight: int = 8, tries: int = 1) -> DataFrame:
    """doc_id, response (the body), error and calls for each request (doc_id, system, prompt).

    Each task has ``in_flight`` calls open at once; a lost task repeats its own calls only.
    """
    ship(requests.sparkSession)
    kind = requests.schema["doc_id"].dataType.simpleString()
    options = ({"response_format": {"type": "json_object"}} if json_only else {}) | ({"chat_template_kwargs": {"enable_thinking": False}} if no_thinking else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = Caller(endpoint, tries)
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                asked = [
                    {"model": model, "messages": [{"role": "system", "content": s}, {"role": "user", "content": p}], "temperature": 0, "max_tokens": max_tokens} | options
                    for s, p in zip(batch.column("system").to_pylist(), batch.column("prompt").to_pylist(), strict=True)
                ]
                got = list(pool.map(call, asked))
                columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "response", "error", "calls"])

    return requests.select("doc_id", "system", "prompt").mapInArrow(run, f"doc_id {kind}, response string, error string, calls int")


# Tolerant JSON


def _embedded(text: str | None) -> list[str]:
    """The parts of a text that are JSON objects or arrays, wherever they begin; values inside others as well."""
    decoder, found = json.JSONDecoder(), []
    at = -1
    while text and (at := min((p for p in (text.find("{", at + 1), text.find("[", at + 1)) if p >= 0), default=-1)) >= 0:
        try:
            found.append(text[at : decoder.raw_decode(text, at)[1]])
        except (ValueError, RecursionError):
            continue
    return found


def embedded_values(text: Column) -> Column:
    """The JSON objects and arrays in a text, in order; nothing is looked for in null texts."""

    @F.pandas_udf("array<string>")
    def embedded(texts: pd.Series) -> pd.Series:
        return texts.map(_embedded)

    return embedded(text)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing after it, other than null.

    The parser stops after a first value, so the text must also stand as the one element of an
    array and as the one member of an object: what ends one of these early breaks the other.
    """
    listed, named = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = named.isNotNull() & listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce(one & (_kind(F.try_parse_json(text)) != "VOID"), F.lit(False))


def _chosen(values: Column) -> Column:
    """Of JSON texts the last object with a list of findings, else the last object, else the last value."""
    is_object = lambda t: _kind(F.try_parse_json(t)).startswith("OBJECT")
    rich = lambda t: is_object(t) & _kind(F.try_variant_get(F.try_parse_json(t), "$.findings", "variant")).startswith("ARRAY")
    last = lambda found: F.try_element_at(found, F.lit(-1))
    return X.let(F.filter(values, _is_json), lambda good: F.coalesce(last(F.filter(good, rich)), last(F.filter(good, is_object)), last(good)))


def recovered_json(answers: DataFrame, answer: str, out: str = "json") -> DataFrame:
    """``answers`` with ``out``: the JSON text that an answer holds, null where there is none.

    The whole answer counts if it is JSON; else, without what it thought, its last good fenced
    block; else a value inside the text. Objects with findings go first. Only answers that
    need it are searched for values inside.
    """
    blank = r"(?U)^\s+|\s+$"
    rows = once(answers, _text=F.regexp_replace(F.coalesce(answer, F.lit("")), blank, ""))
    spoken = F.regexp_replace(F.regexp_replace("_text", "(?is)<think>.*?</think>", ""), "(?is)<think>.*$", "")
    rows = once(once(rows, _whole=F.when(_is_json(F.col("_text")), F.col("_text"))), _spoken=F.when(F.col("_whole").isNull(), spoken))
    blocks = F.filter(F.transform(F.regexp_extract_all("_spoken", F.lit(r"(?is)```(?:json)?\s*(.*?)```"), F.lit(1)), lambda b: F.regexp_replace(b, blank, "")), lambda b: b != "")
    rows = once(rows, _fenced=_chosen(blocks))
    rows = rows.withColumn("_inside", embedded_values(F.when(F.col("_whole").isNull() & F.col("_fenced").isNull(), F.col("_spoken"))))
    found = F.coalesce("_whole", "_fenced", F.when(F.col("_inside").isNotNull(), _chosen(F.col("_inside"))))
    return once(rows, **{out: F.to_json(F.try_parse_json(found))}).drop("_text", "_whole", "_spoken", "_fenced", "_inside")


# Findings of an answer


def _whole_number(value: Column) -> Column:
    """The value as a whole number, if it is one or reads like one; truth values are none."""
    text, kind = F.try_variant_get(value, "$", "string"), _kind(value)
    number = F.when(text.try_cast("double").between(-1e15, 1e15), text.try_cast("double").cast("long"))
    return F.when(kind == "STRING", F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("long"))).when(kind.isin("BOOLEAN", "VOID"), None).otherwise(number)


def stated_findings(rows: DataFrame, json_text: str = "json") -> DataFrame:
    """``rows`` with valid (whether the JSON has the form of an answer) and stated, its findings as text fields."""
    rows = once(rows, _value=F.try_parse_json(json_text))
    rows = once(rows, _listed=F.try_variant_get("_value", "$.findings", "variant"))
    none = F.array().cast("array<variant>")
    items = F.when(_kind(F.col("_listed")) == "VOID", none).otherwise(F.try_variant_get("_listed", "$", "array<variant>"))
    rows = once(rows, _items=F.when(_kind(F.col("_value")).startswith("OBJECT"), items))
    part = lambda f, name: F.try_variant_get(f, f"$.{name}", "variant")
    text = lambda f, name: F.try_variant_get(f, f"$.{name}", "string")
    whole = lambda f, name: _whole_number(part(f, name))
    fits = lambda f: _kind(f).startswith("OBJECT") & whole(f, "page").isNotNull() & whole(f, "span_index").isNotNull()
    # numbers are no answer to whether to keep
    keep = lambda f: F.when(_kind(part(f, "keep")).isin("BOOLEAN", "STRING"), text(f, "keep"))
    fields = lambda f, i: F.struct(
        i.cast("int").alias("ord"), whole(f, "page").cast("int").alias("page"), whole(f, "span_index").cast("int").alias("span_index"), keep(f).alias("keep_text"), text(f, "aspect").alias("aspect"),
        text(f, "stance").alias("stance"), text(f, "confidence").alias("confidence_text"), text(f, "mention_type").alias("mention_type"), text(f, "citation_text").alias("citation_text"),
    )
    rows = once(rows, valid=F.coalesce(F.forall("_items", fits), F.lit(False)))
    return once(rows, stated=F.when(F.col("valid"), F.transform("_items", fields))).drop("_value", "_listed", "_items")


def _concluded(answers: DataFrame, mode: str, thoughts_count: bool) -> DataFrame:
    """doc_id, error_type, error_detail, stated of each answered row, from the body of its answer."""
    names = FAILURES[mode]
    said = R.chat_output(F.col("response"), thoughts_count)["analysis_text"]
    rows = recovered_json(once(answers, said=F.coalesce(said, F.lit(""))), "said")
    rows = stated_findings(rows)
    failure = (
        F.when(F.col("error").isNotNull(), names["request"]).when(F.col("said") == "", BLANK)
        .when(F.col("json").isNull(), names["parse"]).when(~F.col("valid"), names["schema"])
    )
    return rows.select("doc_id", failure.alias("error_type"), F.when(F.col("error").isNotNull(), M.request_failure(F.col("error"))).alias("error_detail"), F.when(failure.isNull(), F.col("stated")).alias("stated"))


def single_model(payloads: DataFrame, endpoint, system: str = "", **how) -> DataFrame:
    """doc_id, error_type, error_detail, stated for each payload (doc_id, scope, prompt; null where there is nothing to analyse).

    Without spans the answer is an empty list; without full text it is a failure; neither calls
    the endpoint.
    """
    ready = payloads.where("prompt IS NOT NULL").withColumn("system", F.lit(system))
    answers = checkpointed(ask(ready, endpoint, max_tokens=ANSWER_TOKENS["single_model"], no_thinking=True, **how))  # calls are made once
    empty = F.coalesce(F.col("scope") == "fulltext_direct", F.lit(False))
    rest = payloads.where("prompt IS NULL").select("doc_id", F.when(empty, NO_TEXT).alias("error_type"), F.lit(None).cast("string").alias("error_detail"))
    found = _concluded(answers, "single_model", False)
    kind = found.schema["stated"].dataType
    return found.unionByName(rest.withColumn("stated", F.when(F.col("error_type").isNull(), F.array().cast(kind))))


def two_stage(payloads: DataFrame, writer, structurer, system: str = "", **how) -> DataFrame:
    """The same by two endpoints: one writes an analysis, the other turns it into JSON. What either refuses is a failure of its own."""
    ready = payloads.where("prompt IS NOT NULL").withColumn("system", F.lit(system))
    drafts = checkpointed(ask(ready, writer, max_tokens=ANSWER_TOKENS["local"], json_only=False, **how))
    said = R.chat_output(F.col("response"), True)["analysis_text"]
    tasks = max(drafts.rdd.getNumPartitions(), drafts.sparkSession.sparkContext.defaultParallelism)
    drafts = once(drafts, draft=F.coalesce(said, F.lit("")))
    failed = F.when(F.col("error").isNotNull(), FAILURES["local"]["request"]).when(F.col("draft") == "", BLANK)
    drafts = drafts.withColumn("error_type", failed)
    second = drafts.where("error_type IS NULL").join(ready.select("doc_id", "system", F.col("prompt").alias("first")), "doc_id").select("doc_id", "system", F.concat_ws("\n\n", "first", "draft").alias("prompt"))
    # one form of the request only: a refusal is a failure; short rows would be joined into few tasks, but each is a call
    answers = checkpointed(ask(second.repartition(tasks, "doc_id"), structurer, max_tokens=ANSWER_TOKENS["structuring"], json_only=False, **how))
    found = _concluded(answers, "structuring", False)
    kind = found.schema["stated"].dataType
    first = drafts.where("error_type IS NOT NULL").select("doc_id", "error_type", F.when(F.col("error").isNotNull(), M.request_failure(F.col("error"))).alias("error_detail"), F.lit(None).cast(kind).alias("stated"))
    nothing = payloads.where("prompt IS NULL").select("doc_id", F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_detail"), F.array().cast(kind).alias("stated"))
    return found.unionByName(first).unionByName(nothing)


def by_mode(payloads: DataFrame, endpoint, writer, structurer, **how) -> DataFrame:
    """Each payload by the analysis that its mode names; a mode that does not exist is a failure."""
    rows = payloads.withColumn("_mode", R.mode_of(F.col("mode")))
    one = single_model(rows.where("_mode = 'single_model'"), endpoint, **how)
    two = two_stage(rows.where("_mode = 'legacy_two_stage'"), writer, structurer, **how)
    odd = rows.where("_mode IS NULL").select("doc_id", F.lit(NO_MODE).alias("error_type"), F.lit(None).cast("string").alias("error_detail"), F.lit(None).cast(one.schema["stated"].dataType).alias("stated"))
    return one.unionByName(two).unionByName(odd)


def typed_findings(results: DataFrame) -> DataFrame:
    """Findings of results that did not fail, in the form of ``findings.normalise_findings``."""
    return M.normalise_findings(results.where("error_type IS NULL").select("doc_id", F.inline("stated")))


def asked_findings(results: DataFrame) -> DataFrame:
    """Findings and failures in the form of ``cue_findings``: a failed row has error_type and nothing else."""
    cols = ["doc_id", "page", "span_index", "keep", "aspect", "stance", "confidence", "mention_type"]
    results = checkpointed(results)  # answers are read once
    good = typed_findings(results).select(*cols, F.lit(None).cast("string").alias("error_type"))
    return good.unionByName(results.where("error_type IS NOT NULL").select("doc_id", "error_type"), allowMissingColumns=True)
