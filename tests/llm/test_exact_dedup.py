import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm.exact_dedup import exact_duplicates, golomb_decode, golomb_encode
from quillstream.llm.rows import with_group


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1), min_size=1, max_size=200))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    assert (golomb_decode(len(v), *golomb_encode(v, 40)) == v).all()


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, d in members]
    return sorted(out)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n\t"), (7, "é x"), (8, "éx"), (9, "z" * 50_000), (10, "z" * 50_000), (11, "unique")] + [(100 + i, "hot text") for i in range(300)]


@pytest.mark.parametrize("broadcast_ids", [0, 10_000])
def test_against_brute_force(spark, broadcast_ids):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in ROWS], "doc_id long, text string, uid string").repartition(5)
    got = sorted(tuple(r) for r in exact_duplicates(docs, broadcast_ids, owner_rows=20).collect())
    assert got == brute(ROWS)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "doc_id long, text string")
    got = exact_duplicates(docs).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in got) == [(1, 2, False), (1, 2, True), (2, 1, True)]
    assert exact_duplicates(docs.limit(0)).collect() == []


def test_null_ids_come_last(spark):
    """Of equal rows the one with an id stays, as in the SQL; null ids alone give a null keeper."""
    docs = spark.createDataFrame([(5, "x"), (5, "x"), (6, "x"), (None, "x"), (None, "y"), (None, "y"), (7, "longer y y"), (None, "longer  y y")], "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in exact_duplicates(docs).collect()), key=repr)
    # of the last two, the null row has more code points
    assert got == sorted([(5, 5, 4, True), (5, 5, 4, False), (6, 5, 4, False), (None, 5, 4, False), (None, None, 2, True), (None, None, 2, False), (7, None, 2, False), (None, None, 2, True)], key=repr)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(d, t, 1, "s", "p", 3, 4) for d, t in ROWS], "doc_id long, text string, group_size int, sha string, print string, keep_id int, row_key int")
    assert sorted(map(tuple, exact_duplicates(docs).collect())) == brute(ROWS)


@pytest.mark.parametrize("hot_groups", [1, 4096])
def test_groups_join_whether_hot_or_not(spark, hot_groups):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)], "g int, v int")
    groups = rows.groupBy("g").count().withColumnRenamed("count", "n")
    got = with_group(rows, groups, ["g"], "n", 300, hot_groups).collect()
    assert sorted((r.g, r.v) for r in got) == sorted((r.g, r.v) for r in rows.collect())
    assert all(r.n == sum(x.g == r.g for x in got) for r in got)
