"""Papers named in messages, against a plain comparison of every message with every paper."""

import random
import re

import pytest

from quillstream.operators import selection as N


def norm(t):
    return re.sub("[^a-z0-9一-鿿]+", " ", (t or "").lower()).strip()


def brute(messages, papers):
    out = []
    for m, text in messages:
        said = norm(text)
        words = set(said.split())
        for p, title in papers:
            if not (title or "").strip():
                continue
            n = norm(title)
            head = next((x.strip() for x in re.split(r"[:：\-|/]", title) if x.strip()), "")
            keys = [w for w in n.split() if (len(w) >= 3 or w.isdigit()) and w not in N.STOP]
            keys = list(dict.fromkeys(keys))[:8]
            names = list(dict.fromkeys([n, norm(head)]))
            base = max([120 if len(n) >= 6 and n in said else 0, *(80 + min(len(a), 30) for a in names if len(a) >= 5 and a in said)], default=0)
            found = [k for k in keys if k in words or (len(k) >= 5 and k in said)]
            score = base + (16 * len(found) + min(max(map(len, found)), 20) + (20 if len(found) >= 2 else 0) if found else 0)
            if score >= 24:
                out.append((m, p, score, tuple(found)))
    return sorted(out)


def made():
    rng = random.Random(6)
    words = ["graph", "net", "transformers", "of", "the", "ab", "42", "deep", "learning", "widgets", "é", "图", "quantum", "gadget", "x1"]
    title = lambda: rng.choice(["", "Head: ", "A/B - "]) + " ".join(rng.choices(words, k=rng.randint(1, 7))).title()
    papers = [(k, title()) for k in range(60)] + [(60, None), (61, "  "), (62, "::"), (63, "Deep Learning"), (64, "Deep Learning")]
    messages = [(k, " ".join(rng.choices(words + [papers[3][1], papers[7][1], "gadgets", "superquantumx"], k=rng.randint(0, 12)))) for k in range(80)]
    return [*messages, (80, None), (81, ""), (82, "?"), (83, messages[5][1]), (84, "deep learning " * 3000)], papers


@pytest.mark.parametrize("automaton_patterns", [200_000, 0])
def test_scores(spark, automaton_patterns):
    messages, papers = made()
    m = spark.createDataFrame([(k, t, 1) for k, t in messages], "message long, text string, key int")
    p = spark.createDataFrame([(f"P{k:03d}", t, "x") for k, t in papers], "id string, title string, pattern string")
    got = sorted((r.message, int(r.id[1:]), r.score, tuple(r.found)) for r in N.score_messages(m, p, automaton_patterns).collect())
    assert got == brute(messages, papers)


def test_no_patterns(spark):
    m = spark.createDataFrame([(1, "deep learning")], "message long, text string")
    none = spark.createDataFrame([], "id string, title string")
    assert N.score_messages(m, none).collect() == [] and N.score_messages(m.limit(0), none, 0).collect() == []


def test_resolution(spark):
    papers = spark.createDataFrame([(1, "P001", "Deep graph networks"), (2, "P002", "Quantum gadget design"), (3, "P003", "Gadget repair")], "ord int, id string, title string")
    rows = [
        (1, "show these", ["P003", "P001", "P9"], 0), (2, "the first two", [], 2), (3, "all", None, 99), (4, "tell me of deep graph networks", [], None),
        (5, "quantum gadget design 和 deep graph networks", [], 0), (6, "nothing known", [], 0), (7, "repair", [], 0), (8, "none", ["P8"], 0),
    ]
    m = spark.createDataFrame(rows, "message long, text string, ids array<string>, top_n int")
    got = {r.message: (r.status, r.ids, r.matches) for r in N.resolve(m, papers).collect()}
    assert got[1] == ("ok", ["P003", "P001"], []) and got[2] == ("ok", ["P001", "P002"], []) and got[3] == ("ok", ["P001", "P002", "P003"], [])
    assert got[4][:2] == ("ok", ["P001"]) and got[6] == ("no_match", [], []) and got[7][:2] == ("ok", ["P003"]) and got[8] == ("no_match", [], [])
    assert got[5][0] == "ok" and set(got[5][1]) == {"P001", "P002"}


def test_works_of_one_doi_meet_as_one(spark):
    """Papers and works that share a DOI or a title are not paired one by one."""
    from quillstream.operators import papers as P

    papers = spark.createDataFrame([(k, "10.1/x" if k % 2 else "", "One title of some length here") for k in range(40)], "ord long, doi string, title string")
    works = spark.createDataFrame([(k, "doi:10.1/X" if k % 3 == 1 else "", "One Title of some length here") for k in range(5, 45)], "work long, doi string, title string")
    found = P.same_work(papers, works)
    assert {(r.ord, r.work, r.how) for r in found.collect()} == {(k, 7, 1) if k % 2 else (k, 5, 2) for k in range(40)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("min(work") >= 3
