"""Streams against batches: task states with timers, views by deltas, snapshots, caches and cursors that survive failures."""

import os

import pytest
from pyspark.sql import functions as F

from quillstream.plans import stubs
from quillstream.sources import cache, cursors, snapshots
from quillstream.streaming import tasks, views


def requests(spark, rows):
    return spark.createDataFrame(rows, "session string, kind string, n long, ord long").select("session", "kind", F.timestamp_seconds("n").alias("at"), "ord")


ROWS = [("a", "start", 1, 0), ("a", "start", 2, 1), ("a", "succeed", 3, 2), ("a", "fail", 4, 3), ("b", "fail", 1, 4), ("b", "start", 2, 5), ("b", "fail", 3, 6), ("b", "start", 4, 7)]
# ends and starts of one time, in the order of ord
TIES = [("c", "succeed", 9, 9), ("c", "start", 9, 8), ("c", "start", 9, 10), ("c", "fail", 9, 11), ("d", "start", 5, 1), ("d", "succeed", 5, 0)]


@pytest.mark.parametrize("slices", [1, 4])
def test_states_in_micro_batches(spark, tmp_path, slices):
    frame = requests(spark, ROWS + TIES)
    got = {(r.session, r.ord, r.state, r.accepted) for r in tasks.replayed(frame, str(tmp_path / "x"), slices).collect()}
    assert got == {(r.session, r.ord, r.state, r.accepted) for r in tasks.task_states(frame).collect()} and len(got) == len(ROWS + TIES)


def run(spark, folder, stuck_after):
    source = spark.readStream.schema("session string, kind string, at timestamp, ord long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = tasks.single_flight(source, stuck_after).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return sorted((r.session, r.at.timestamp(), -1 if r.ord is None else r.ord, r.state, r.accepted, r.reason) for r in spark.read.parquet(f"{folder}/out").collect())


def test_a_stuck_task_fails_and_frees_its_session(spark, tmp_path):
    """The limit is ten seconds: 'a' runs out before its next start, 'b' ends in time, 'c' runs out by the timer alone."""
    parts = [[("a", "start", 100, 0), ("b", "start", 101, 1), ("c", "start", 102, 2)], [("b", "succeed", 105, 3)], [("a", "start", 130, 4)], [("x", "start", 131, 5)]]
    for part in parts:
        requests(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, str(tmp_path), "10 seconds")
    utc = lambda rows: sorted(rows)
    assert ("a", 110.0, -1, "failed", True, "timed out") in got and ("c", 112.0, -1, "failed", True, "timed out") in got
    assert ("a", 130.0, 4, "running", True, "") in got and not any(r[0] == "b" and r[5] for r in got)
    assert len(utc(got)) == 8


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    requests(spark, ROWS[:3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(spark, str(tmp_path), None)
    requests(spark, ROWS[3:]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, str(tmp_path), None)
    assert {(r[0], r[2], r[3], r[4]) for r in got} == {(r.session, r.ord, r.state, r.accepted) for r in tasks.task_states(requests(spark, ROWS)).collect()}


def test_task_starts(spark):
    rows = [("s", "analyze", 1, ["P1"], None, "full-text", None, None), ("s", "analyze", 2, None, 3, None, None, None), ("s", "extend", 3, ["x"], None, None, 5, 9), ("s", "extend", 4, None, None, None, 50, 9), ("s", "odd", 5, None, None, None, None, None), ("s", "refresh", 6, ["P2"], 4, None, None, None)]
    frame = spark.createDataFrame(rows, "session string, command string, ord long, ids array<string>, top_k int, scope string, wanted long, held long").withColumn("at", F.timestamp_seconds("ord"))
    got = {r.ord: r for r in tasks.task_starts(frame).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    assert (got[1].top_k_spans, got[1].analysis_scope, got[1].requested_ids) == (8, "fulltext_direct", ["P1"]) and (got[2].top_k_spans, got[2].analysis_scope, got[2].requested_ids) == (3, "candidate_spans", [])
    assert (got[3].task_type, got[3].limit, got[3].requested_ids) == ("discover", 9, []) and got[4].limit == 50 and "50" in got[4].message
    assert got[6].top_k_spans is None


# views


def papers(spark, rows):
    return spark.createDataFrame([(k, t, y, c, None, d, None, g) for k, t, y, c, d, g in rows], "ord long, title string, year int, confidence string, corpus_id string, doi string, arxiv_id string, venue string")


BATCHES = [
    [(1, "A", 2001, "high", "d1", "v"), (2, "B", None, "low", "d2", "v"), (3, "C", 1999, "medium", None, "w")],
    [(4, "A again", 2010, "high", "d1", "v"), (5, "D", 2005, None, "d5", "w"), (6, None, 2000, "high", None, "w")],
    [], [(7, "E", 1990, "high", "d7", "v"), (8, "E", 2030, "high", "d7", None), (9, "F", 2002, "high", "d9", None)],
]


def whole(spark):
    """The view of all papers at once, by hand."""
    seen, groups = set(), {}
    for batch in BATCHES:
        for k, t, y, c, d, g in sorted(batch):
            key = d or (t or "").lower() or None
            if key and key not in seen:
                seen.add(key)
                groups.setdefault(g, []).append((y, c))
    out = set()
    for g, rows in groups.items():
        years = [y for y, _ in rows if y is not None]
        n, high, confident = len(rows), sum(c == "high" for _, c in rows), sum(c in ("high", "medium") for _, c in rows)
        out.add((g, n, high, confident, min(years), max(years), "high" if n >= 10 or high >= 2 or confident >= 4 else "medium" if n >= 5 or confident >= 2 else "low"))
    return out


def state(followed):
    return {tuple(r) for r in followed.state().select("venue", "n", "high", "confident", "year_min", "year_max", "impact_level").collect()}


def test_views_after_batches_are_those_of_all_papers(spark, tmp_path):
    followed = views.FollowedPapers(spark, str(tmp_path / "f"), "venue")
    for number, batch in enumerate(BATCHES):
        followed(papers(spark, batch), number)
        followed(papers(spark, batch), number)  # a batch that comes again changes nothing
    assert state(followed) == whole(spark)


def test_a_batch_lost_halfway_is_finished(spark, tmp_path, monkeypatch):
    followed = views.FollowedPapers(spark, str(tmp_path / "f"), "venue")
    followed(papers(spark, BATCHES[0]), 0)
    lost = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    monkeypatch.setattr(views, "merged", lost)
    with pytest.raises(RuntimeError):
        followed(papers(spark, BATCHES[1]), 1)  # the papers are stored, the view is not
    monkeypatch.undo()
    again = views.FollowedPapers(spark, str(tmp_path / "f"), "venue")
    for number in (1, 2, 3):
        again(papers(spark, BATCHES[number]), number)
    assert state(again) == whole(spark)


def test_views_in_a_stream(spark, tmp_path):
    for batch in BATCHES:
        papers(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    followed = views.FollowedPapers(spark, str(tmp_path / "f"), "venue")
    source = spark.readStream.schema(papers(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = source.writeStream.foreachBatch(followed).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None and state(followed) == whole(spark)


# snapshots


def test_readers_see_one_version_while_writers_publish(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    assert store.read() is None and store.versions() == []
    rows = lambda lo, hi, v: spark.range(lo, hi).select(F.col("id").alias("session_id"), F.lit(v).alias("v"))
    assert store.publish(rows(0, 100, "old"))
    reader = store.read()
    assert store.update(lambda old: snapshots.replaced(old, rows(50, 120, "new"), "session_id"))
    assert reader.groupBy("v").count().collect() == [("old", 100)]  # the version it settled on
    assert {r.v: r["count"] for r in store.read().groupBy("v").count().collect()} == {"old": 50, "new": 70}
    spark.range(3).write.parquet(store.folder(2))  # a writer that was lost before it published
    assert store.versions() == [0, 1] and store.read().count() == 120
    assert store.publish(rows(0, 1, "next")) and store.read().count() == 1
    assert not store.publish(rows(0, 9, "other"), 2) and store.read().count() == 1  # another writer came first
    store.publish(rows(0, 2, "last"))
    store.vacuum(2)
    assert store.versions() == [2, 3] and not os.path.exists(store.folder(0))
    with pytest.raises(ValueError):
        store.read(0)


def test_defaults_of_sessions(spark):
    bare = snapshots.with_defaults(spark.createDataFrame([(1,)], "session_id long")).first().asDict()
    assert bare == {"session_id": 1, "query": "", "session_kind": "academic_impact_analysis", "analysis_scope": "candidate_spans", "task_status": "idle", "task_active": False, "paper_count": 0, "warnings": []}
    full = snapshots.with_defaults(spark.createDataFrame([(1, "q", None, True, 7, "more")], "session_id long, query string, task_status string, task_active boolean, paper_count int, extra string")).first()
    assert (full.query, full.task_status, full.task_active, full.paper_count, full.extra) == ("q", "idle", True, 7, "more")


# the cache


def test_a_second_run_fetches_what_failed_alone(spark, tmp_path):
    urls = [f"https://x.org/{k}" for k in range(40)]
    wanted = spark.createDataFrame([(u,) for u in [*urls, urls[0], None]], "url string")
    path, log = str(tmp_path / "cache"), str(tmp_path / "calls")

    def logged(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        return stubs.fetching(url)

    def calls():
        with open(log) as f:
            return f.read().split()

    def plain(url):
        try:
            return stubs.fetching(url)[0]
        except TimeoutError:
            return None

    good = {u for u in urls if plain(u) == 200}
    first = {r.url: r for r in cache.read_through(wanted, path, logged, waits=(0.0,), pause=0).collect()}
    assert set(first) == set(urls) and all((first[u].text == f"page of {u}") == (u in good) and not first[u].cached for u in urls)
    assert sorted(calls()) == sorted(urls)  # each once, whatever reads the result
    assert {r.url for r in spark.read.parquet(path).collect()} == good
    os.remove(log)
    again = {r.url: r for r in cache.read_through(wanted, path, logged, waits=(0.0,), pause=0).collect()}
    assert sorted(calls()) == sorted(set(urls) - good) and all(again[u].cached == (u in good) for u in urls)
    assert cache.read_through(wanted.where(F.col("url").isin(list(good))), path, None, waits=(0.0,)).count() == len(good)


def test_busy_services_are_tried_again(spark, tmp_path):
    count = str(tmp_path / "n")

    def busy(url):
        with open(count, "a") as f:
            f.write("x")
        return (200, "late") if os.path.getsize(count) >= 3 else (429, "")

    got = cache.read_through(spark.createDataFrame([("u",)], "url string"), str(tmp_path / "c"), busy, waits=(0.0,) * 5).collect()
    assert [(r.text, r.error) for r in got] == [("late", None)] and os.path.getsize(count) == 3


# cursors


def pages_of(n, size):
    return (lambda c: [(k, f"row {k}") for k in range(int(c.strip("*c") or 0), min(n, int(c.strip("*c") or 0) + size))]), (lambda c: f"c{int(c.strip('*c') or 0) + size}" if int(c.strip("*c") or 0) + size < n else None)


@pytest.mark.parametrize("n", [0, 5, 10, 47])
def test_cursor_batch(spark, n):
    fetch, following = pages_of(n, 5)
    got = cursors.cursor_rows(spark, f"cursor_batch_{n}", "n long, t string", fetch, following, pages_a_batch=3)
    assert sorted(map(tuple, got.collect())) == [(k, f"row {k}") for k in range(n)]


def test_cursor_stream_goes_on_after_a_failure(spark, tmp_path):
    """A page that cannot be read stops the stream; when it can, each row has come once."""
    flag = str(tmp_path / "broken")
    open(flag, "w").close()
    fetch, following = pages_of(60, 5)

    def shaky(cursor):
        if cursor == "c30" and os.path.exists(flag):
            raise RuntimeError("unreachable")
        with open(str(tmp_path / "fetched"), "a") as f:
            f.write(cursor + "\n")
        return fetch(cursor)

    def start(name):
        rows = cursors.cursor_rows(spark, name, "n long, t string", shaky, following, streaming=True, pages_a_batch=2)
        return rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()

    q = start("cursor_stream_a")
    with pytest.raises(Exception):
        q.processAllAvailable()
    q.stop()
    done = spark.read.parquet(str(tmp_path / "out")).count()
    assert done == 30
    os.remove(flag)
    os.remove(str(tmp_path / "fetched"))
    q = start("cursor_stream_a")
    q.processAllAvailable()
    q.stop()
    got = sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == list(range(60))
    with open(str(tmp_path / "fetched")) as f:
        assert set(f.read().split()) == {f"c{k}" for k in range(30, 60, 5)}  # pages before are not fetched again


def test_a_slice_of_time_is_one_batch(spark, tmp_path):
    """All files of a slice are read together, so a session is visited once a slice (before, once a file of it)."""
    rows = [(f"s{k % 5}", "start" if k % 2 else "succeed", 1_700_000_000 + 60 * k, k) for k in range(60)]
    frame = spark.createDataFrame(rows, "session string, kind string, t long, ord long").withColumn("at", F.timestamp_seconds("t")).drop("t")
    got = {(r.session, r.ord, r.at, r.state, r.accepted) for r in tasks.replayed(frame, str(tmp_path / "x"), 3, 2).collect()}
    assert got == {(r.session, r.ord, r.at, r.state, r.accepted) for r in tasks.task_states(frame).collect()}
    assert len([f for f in os.listdir(tmp_path / "x" / "checkpoint" / "commits") if f.isdigit()]) == 3
