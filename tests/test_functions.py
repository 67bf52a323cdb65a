import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators import papers as P
from quillstream.operators import passages as S
from quillstream.operators import people as E
from quillstream.operators import selection as N


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


REGISTRY = [(1, 0, "ICML", "Top", "ICML"), (2, 0, "ICSME", "CCF-B", "International Conference on Software Maintenance and Evolution"), (3, 0, "ISSTA", "CCF-A", "International Symposium on Software Testing and Analysis"), (4, 0, "NeurIPS", "Top", "NeurIPS")]


@pytest.mark.parametrize(
    ("venue", "tier", "score"),
    [
        ("ICML", "Top", 504), ("IEEE International Conference on Software Maintenance and Evolution", "CCF-B", None), ("NeurIPS", "Top", None), ("Workshop on Tiny Datasets", "Unmatched", 0),
        ("Proceedings of the 31st ACM SIGSOFT International Symposium on Software Testing and Analysis", "CCF-A", 406), ("", "Unmatched", 0),
    ],
)
def test_venues(spark, venue, tier, score):
    registry = spark.createDataFrame(REGISTRY, "ord int, alias_ord int, name string, tier string, alias string")
    papers = spark.createDataFrame([(1, "t", 2020, venue)], "ord long, title string, year int, venue string")
    r = P.match_venues(papers, registry).first()
    assert r.tier == tier and (score is None or r.match_score == score)


@pytest.mark.parametrize(
    ("title", "explicit", "want"),
    [
        ("Training-Free Group Relative Policy Optimization", [], ["tfgrpo", "tf-grpo"]), ("LoRA: Low-Rank Adaptation of Large Language Models", [], ["LoRA", "llrallm"]),
        ("A very long head that is no name of it: rest", [], ["vlhtnnir"]), ("One", ["One", " X-1 ", "x-1", "?"], ["One", "X-1"]), ("", [], []), (None, [], []),
        ("The Art of Widgets", [" Widgets "], ["Widgets", "aw"]),
    ],
)
def test_aliases(spark, title, explicit, want):
    got = value(spark, X.target_aliases(F.lit(title).cast("string"), F.lit(explicit).cast("array<string>")))
    assert got == want


def test_alias_hits(spark):
    def hits(text, title, explicit=()):
        row = spark.range(1).select(X.signs_of(spark, title, "", list(explicit)).alias("s"))
        return row.select(X.alias_hits(F.lit(text), F.col("s.names")).alias("v")).first()[0]

    free = "Training-Free Group Relative Policy Optimization"
    assert hits("tfgrpo [14] simply mimics", free) == ["tfgrpo"]  # the form with a hyphen is the same in compact form
    assert hits("xtfgrpo", free) == [] and hits("", free) == []
    assert hits("the Group-Relative way", "Quantum gadgets", ["Group Relative"]) == ["Group Relative"]
    assert hits("relative group", "Quantum gadgets", ["Group Relative"]) == []


def test_targets_as_rows(spark):
    rows = spark.createDataFrame([("LoRA: Low-Rank Adaptation", "we use lora here"), ("Widgets of glass", "we use lora here")], "title string, text string")
    got = rows.withColumn("s", X.target_signs("title")).select("title", X.sign_score("text", F.col("s"), 8).alias("score")).collect()
    assert {r.title: r.score for r in got} == {"LoRA: Low-Rank Adaptation": 5, "Widgets of glass": 0}  # a keyword and a name


@pytest.mark.parametrize("text", ["", "abc", "a, b and a", "aa aaa a", "xax a-a (a)", "é a ﬁ a", "aXa.*a"])
def test_places(spark, text):
    import re

    at = lambda w, bounded: value(spark, X.places_of(F.lit(text), F.lit(w), bounded))
    for w in ("a", "aa", ".*"):
        assert at(w, False) == [m.start() for m in re.finditer(re.escape(w), text)]
        assert at(w, True) == [m.start() for m in re.finditer(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", text)]


def plain_index(text, words, names):
    """The pick, written as loops over match positions."""
    import re

    marks = [("bracket", r"\[\s*(\d+)\s*\]"), ("leading_number", r"(?m)^\s*(\d+)[.)]\s+")]
    found = sorted((m.start(), m.group(1), style) for style, p in marks for m in re.finditer(p, text, re.ASCII))
    low = text.lower()
    at = sorted({m.start() for w in words for m in re.finditer(re.escape(w), low)} | {m.start() for a in names for m in re.finditer(rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])", low)})
    if not found:
        return (None, None, None, False)
    if not at:
        return (found[0][1], found[0][2], None, False)
    pos, number, style = min(found, key=lambda f: min(abs(f[0] - s) for s in at))
    sign = min(at, key=lambda s: abs(pos - s))
    before = 5 <= pos - sign <= 260 and int(number) > 1
    return (str(int(number) - 1) if before else number, style, abs(pos - sign), before)


def test_index_nearest_to_a_sign(spark):
    import random

    rng = random.Random(2)
    pieces = ["[3]", "[ 12 ]", "4. ", "\n7) ", "\n 08. ", "glass widget", "widgets", "10.1/x", "gw", "gwx", " plain words ", "\n", "x" * 300, "[99999999999999999999]", "[0]", "[1]"]
    texts = ["", "[5] nothing", *["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(120)]]
    signs = X.signs_of(spark, "Glass Widgets", "10.1/X")
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("s", signs)
    got = {r.n: tuple(r.p) for r in frame.select("n", S.picked_index(F.col("text"), F.col("s")).alias("p")).collect()}
    assert got == {n: plain_index(t, ["glass", "widgets", "10.1/x"], ["gw"]) for n, t in enumerate(texts)}


@pytest.mark.parametrize(("a", "b"), [("Dean, Jeffrey A", "Jeffrey Dean"), ("Katz, Randy H.", "Randy H. Katz"), ("Andrew Chi-Chih Yao", "Andrew Yao")])
def test_name_variants_meet(spark, a, b):
    assert set(value(spark, X.name_variants(F.lit(a)))) & set(value(spark, X.name_variants(F.lit(b))))


def test_institutions(spark):
    known = spark.createDataFrame([(1, "Massachusetts Institute of Technology", ["MIT"])], "ord int, name string, aliases array<string>")
    rows = spark.createDataFrame([("Smith College",), ("MIT Computer Science and Artificial Intelligence Laboratory",)], "affiliation string")
    assert {r.affiliation: r.institution for r in E.match_institutions(rows, known).collect()} == {"Smith College": None, "MIT Computer Science and Artificial Intelligence Laboratory": "Massachusetts Institute of Technology"}


def test_neighbours_follow_the_first_visitor(spark):
    rows = [(1, k, {3: "citation_index_exact", 4: "citation_index_grouped"}.get(k), False) for k in range(1, 7)]
    got = S.neighbour_spans(spark.createDataFrame(rows, "doc_id long, seq int, kind string, reference_like boolean"))
    assert {r.seq: r.score for r in got.collect()} == {2: 60, 3: 100, 4: 60, 5: 60}


@pytest.mark.parametrize(("text", "kind"), [("see [7]", "citation_index_exact"), ("see [3, 7]", "citation_index_grouped"), ("as (5-9)", "citation_index_grouped"), ("in [17]", None), ("", None)])
def test_citation_hit(spark, text, kind):
    assert value(spark, X.citation_hit(F.lit(text), 7)) == kind


@pytest.mark.parametrize(("raw", "n"), [("3", 3), ("十", 10), ("十二", 12), ("二十", 20), ("三十五", 35), ("两", 2)])
def test_ordinals(spark, raw, n):
    assert value(spark, N.message_ids(F.lit(f"第{raw}篇"))) == [f"P{n:03d}"]


@pytest.mark.parametrize(("doi", "want"), [("https://doi.org/10.1/X", "10.1/x"), ("doi:10.1/x", "10.1/x"), (" 10.1/x ", "10.1/x"), (None, "")])
def test_doi(spark, doi, want):
    assert value(spark, X.norm_doi(F.lit(doi).cast("string"))) == want


@pytest.mark.parametrize(("query", "want"), [("arXiv:2401.01234v2", "2401.01234"), ("2401.01234", "2401.01234"), ("10.48550/arXiv.2401.01234", "2401.01234"), ("hello", None)])
def test_arxiv(spark, query, want):
    assert value(spark, X.arxiv_strict(F.lit(query))) == want


def test_fetch_size():
    assert P.fetch_size(500) == 2500 and P.fetch_size(5001) == 10_000 and P.fetch_size(3) == 100


def test_sentence_packing(spark):
    text = " ".join(f"Sentence number {k} goes on for a while." for k in range(40))
    parts = value(spark, S.packed_sentences(F.lit(text)))
    assert " ".join(parts) == text and all(len(p) >= 350 for p in parts[:-1])


def test_index_before_the_sign(spark):
    rows = spark.createDataFrame([(1, 9, 1, "12. Other, title. onthen target paper here 13. Next one 2001"), (2, 9, 1, "[4] The onthen paper")], "doc_id long, page int, span_index int, text string")
    got = {r.doc_id: (r.citation_index, r.inferred) for r in S.best_reference(rows, X.signs_of(spark, "Onthen")).collect()}
    assert got == {1: ("12", False), 2: ("4", False)}


def test_contexts_are_normalised_once(spark):
    """A filter on the score must not bring the normaliser back for each of its parts."""
    from quillstream.operators import contexts as C

    rows = spark.createDataFrame([(1, "On the Widget Engines of 2001"), (2, "nothing\t–  here"), (3, None)], "id long, said string")
    kept = C.score_contexts(rows, "said", "Widget Engines at Work", year=2001).where(C.usable())
    assert [(r.id, r.keyword_hits, r.phrase_hits, r.score) for r in kept.collect()] == [(1, 2, 1, 5)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("coalesce(said") == 1


def test_spelled_out_classes(spark):
    said = "Ünder-Score_9  — a\tb\x0b[Z] 中文\n-q"
    assert value(spark, X.norm_ctx(F.lit(said))) == "nder-score 9 a b z -q"
    assert value(spark, X.title_key(F.lit(said))) == "nder score 9 a b z q"
    assert value(spark, X.norm_ref(F.lit(said))) == "nder score 9 a b z 中文 q"


def test_signs_read_a_text_once(spark):
    """Words and names are sought in one normalised text: once for the score, twice for the look of an entry."""
    rows = spark.createDataFrame([(1, 1, "The onthen engine [3]"), (1, 2, "nothing")], "doc_id long, seq int, text string")
    kept = S.keyword_fallback(rows, X.signs_of(spark, "Onthen: the erthly engine", "10.1/x"))
    assert [(r.seq, r.score) for r in kept.collect()] == [(1, 8)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("translate(lower(replace(coalesce(text") <= 3


def test_places_in_a_long_text(spark):
    text = "design, " * 4000 + "Design[7]designs design"
    lower = text.lower()
    want = [k for k in range(len(lower)) if lower.startswith("design", k)]
    assert value(spark, X.places_of(F.lit(lower), F.lit("design"))) == want
    assert value(spark, X.places_of(F.lit(lower), F.lit("design"), bounded=True)) == [k for k in want if not lower[k + 6 : k + 7].isalnum() and not lower[k - 1 : k].isalnum()]
