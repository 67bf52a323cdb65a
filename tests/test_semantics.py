"""Tolerant JSON against a plain version, endpoints that refuse options, typed failures."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.operators import semantics as S
from quillstream.plans import stubs


def choose(values):
    rich = [v for v in values if isinstance(v, dict) and isinstance(v.get("findings"), list)]
    objects = [v for v in values if isinstance(v, dict)]
    return (rich or objects or values or [None])[-1]


def plain(answer):
    """The JSON value of an answer, as one would look for it by hand."""
    text = (answer or "").strip()
    try:
        return json.loads(text)
    except ValueError:
        pass
    spoken = re.sub(r"(?is)<think>.*$", "", re.sub(r"(?is)<think>.*?</think>", "", text)).strip()

    def good(parts):
        out = []
        for p in parts:
            try:
                out.append(json.loads(p))
            except ValueError:
                continue
        return [v for v in out if v is not None]

    if fenced := good(re.findall(r"(?is)```(?:json)?\s*(.*?)```", spoken)):
        return choose(fenced)
    found = []
    for m in re.finditer(r"[{\[]", spoken):
        try:
            found.append(json.JSONDecoder().raw_decode(spoken, m.start())[0])
        except ValueError:
            continue
    return choose(found)


def recovered(spark, answers):
    rows = spark.createDataFrame(list(enumerate(answers)), "n int, answer string")
    got = {r.n: r.json for r in S.recovered_json(rows, "answer").collect()}
    return [None if got[n] is None else json.loads(got[n]) for n in range(len(answers))]


def test_recovery(spark):
    rng = random.Random(3)
    pieces = ["{", "}", "[", "]", '"', "a", "1", ",", ":", " ", "```json\n", "```", "<think>", "</think>", '{"findings": []}', '{"a": {"b": 2}}', "[1, 2]", '"x { y"', "\\", "null", "\n", '{"findings": 3}', "<THINK>"]
    answers = [None, "", " ", "42", "null", '"text"', "true", " {} ", '{"a": "}"}', *["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(400)]]
    assert recovered(spark, answers) == [plain(a) for a in answers]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"findings": []}', {"findings": []}), ('<think>{"x": 1}</think> so ```json\n{"findings": [1]}\n```', {"findings": [1]}),
        ('first {"a": 1} then {"findings": []} and {"b": 2}', {"findings": []}), ("nothing", None), ("[1, 2] {broken", [1, 2]),
        ('Here it is: {"findings": [{"page": 1}]}', {"findings": [{"page": 1}]}), ('<think>{"findings": [1]}', None), ("{" * 5000, None),
    ],
)
def test_forms_of_answers(spark, answer, want):
    assert recovered(spark, [answer]) == [want]


def call(endpoint, tries=1, **options):
    return S.Caller(endpoint, tries)({"messages": []} | options)


def test_response_format_goes_first():
    seen = []

    def endpoint(request):
        seen.append(sorted(set(request) & {"response_format", "chat_template_kwargs"}))
        return (400, "no") if "response_format" in request else (200, "yes")

    assert call(endpoint, response_format={}, chat_template_kwargs={}) == ("yes", None, 2)
    assert seen == [["chat_template_kwargs", "response_format"], ["chat_template_kwargs"]]


def test_thinking_switch_goes_next_and_is_remembered():
    seen = []

    def endpoint(request):
        seen.append(len(set(request) & {"response_format", "chat_template_kwargs"}))
        return (400, "no") if seen[-1] else (200, "yes")

    caller = S.Caller(endpoint)
    options = {"messages": [], "response_format": {}, "chat_template_kwargs": {}}
    assert caller(options) == ("yes", None, 3) and seen == [2, 1, 0]
    assert caller(options) == ("yes", None, 1) and seen == [2, 1, 0, 0]
    assert call(lambda r: (400, "no") if "chat_template_kwargs" in r else (200, "yes"), chat_template_kwargs={}) == ("yes", None, 2)


def test_refusals_and_retries():
    assert call(lambda r: (400, "bad"), response_format={}) == (None, "status code 400: bad", 2)
    assert call(lambda r: (500, "boom"), tries=3) == (None, "status code 500: boom", 1)
    assert call(lambda r: (429, "slow"), tries=3) == (None, "status code 429: slow", 3)

    def broken(request):
        raise ConnectionError("Connection refused")

    assert call(broken, tries=2) == (None, "Connection refused", 2)
    answers = iter([(503, "busy"), (200, "yes")])
    assert call(lambda r: next(answers), tries=2) == ("yes", None, 2)


def test_calls_run_side_by_side(spark):
    import time

    def slow(request):
        time.sleep(0.2)
        return 200, stubs.body("{}")

    rows = spark.range(40).repartition(1).select(F.col("id").alias("doc_id"), F.lit("").alias("system"), F.lit("p").alias("prompt"))
    begun = time.time()
    assert S.ask(rows, slow, in_flight=20).count() == 40
    S.ask(rows, slow, in_flight=20).collect()
    assert time.time() - begun < 12  # one after another, the calls alone would take 16


def test_empty_payloads_make_no_calls(spark):
    def never(request):
        raise AssertionError

    rows = spark.createDataFrame([(1, "candidate_spans", None), (2, "fulltext_direct", None)], "doc_id long, scope string, prompt string")
    got = {r.doc_id: (r.error_type, r.stated) for r in S.single_model(rows, never).collect()}
    assert got == {1: (None, []), 2: ("fulltext_direct_empty_text", None)}
    assert {r.doc_id: r.error_type for r in S.two_stage(rows, never, never).collect()} == {1: None, 2: None}


@pytest.mark.parametrize(
    ("stated", "valid"),
    [
        ('{"findings": null}', True), ("{}", True), ('{"findings": [1]}', False), ("[]", False), ('{"findings": [{"page": 1}]}', False), ('{"findings": [{"page": "2", "span_index": 3.0}]}', True),
        ('{"findings": [{"page": true, "span_index": 1}]}', False), ('{"findings": [{"page": "x", "span_index": 1}]}', False), ('{"findings": {}}', False), ("3", False),
    ],
)
def test_schema(spark, stated, valid):
    assert S.stated_findings(spark.createDataFrame([(stated,)], "json string")).first().valid is valid


def test_an_answer_is_parsed_a_few_times_only(spark):
    """Values that are used several times are worked out once; before, they were parsed anew for each use (38 times in the plan, now 20)."""
    rows = spark.range(3).select(F.concat(F.lit(stubs.content_of(10)), F.col("id").cast("string")).alias("answer"))
    found = S.stated_findings(S.recovered_json(rows, "answer"))
    assert all(r.valid and len(r.stated) == 2 for r in found.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("(?i)parse_?json", plan)) < 25


def test_second_calls_are_dealt_over_tasks(spark):
    """What the second endpoint is asked keeps as many tasks as the first has, however short the rows."""
    rows = spark.range(0, 80, 1, 4).select(F.col("id").alias("doc_id"), F.lit("candidate_spans").alias("scope"), F.concat(F.lit("paper "), F.col("id").cast("string")).alias("prompt"))
    seen, asked, size = [], S.ask, "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(size, "-1")
    S.ask = lambda requests, *a, **k: seen.append(requests.rdd.getNumPartitions()) or asked(requests, *a, **k)
    try:
        S.two_stage(rows, stubs.writing, stubs.answering)
    finally:
        S.ask = asked
        spark.conf.unset(size)
    assert seen == [4, 4]
