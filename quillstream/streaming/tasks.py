"""Task states and incremental arrival as Structured Streaming jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import papers as P
from ..operators.views import analysis_scope

_STORE = "spark.sql.streaming.stateStore.providerClass"
_DEFAULT_STORE, _KEYED_STORE = (f"org.apache.spark.sql.execution.streaming.state.{x}StateStoreProvider" for x in ("HDFSBacked", "RocksDB"))
#: What a task that ran too long fails with.
TIMED_OUT = "timed out"
_STATES_SCHEMA = "session string, at timestamp, ord long, state string, accepted boolean, reason string"
_IDLE, _State = ("idle", None), Row("session", "us", "ord", "state", "accepted", "reason")


def task_states(requests: DataFrame) -> DataFrame:
    """States after each request of a batch (session, kind, at, ord): what ``single_flight`` does in a stream.

    After a start, taken or refused, a session runs; after an end it does not. So the request
    before tells whether it is busy, and the last accepted one its state.
    """
    order = Window.partitionBy("session").orderBy("at", "ord")
    busy = F.coalesce(F.lag("kind").over(order) == "start", F.lit(False))
    reached = F.when(F.col("kind") == "start", "running").when(F.col("kind") == "succeed", "succeeded").otherwise("failed")
    rows = requests.withColumn("accepted", busy != (F.col("kind") == "start"))
    state = F.last(F.when(F.col("accepted"), reached), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("state", F.coalesce(state, F.lit("idle")))


def task_status(requests: DataFrame) -> DataFrame:
    """What polling a session shows: its last state, and how many requests it had and refused."""
    return task_states(requests).groupBy("session").agg(F.count("*").alias("requests"), F.count_if(~F.col("accepted")).alias("refused"), F.max_by("state", F.struct("at", "ord")).alias("state"))


class _Flight(StatefulProcessor):
    """One task a session: refuses a start while one runs, and fails a task that runs too long."""

    def __init__(self, stuck_ms: int | None):
        self.stuck_ms = stuck_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "state string, ends long")

    def handleInputRows(self, key, rows, timerValues):
        state, ends = self.task.get() or _IDLE
        out = []
        for r in sorted(rows, key=lambda r: (r.us is None, r.us, r.ord is None, r.ord)):
            now = None if r.us is None else r.us // 1000
            if ends is not None and now is not None and now >= ends:  # the time ran out before this request
                out.append(_State(key[0], ends * 1000, None, "failed", True, TIMED_OUT))
                state, ends = "failed", self._stop(ends)
            accepted = (state == "running") != (r.kind == "start")
            if accepted:
                ends = self._stop(ends)
                state = {"start": "running", "succeed": "succeeded", "fail": "failed"}[r.kind]
                if state == "running" and self.stuck_ms is not None and now is not None:
                    ends = now + self.stuck_ms
                    self.handle.registerTimer(ends)
            out.append(_State(key[0], r.us, r.ord, state, accepted, ""))
        self.task.update((state, ends))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, ends = self.task.get() or _IDLE
        if state == "running" and ends is not None and expiredTimerInfo.getExpiryTimeInMs() >= ends:
            self.task.update(("failed", None))
            yield _State(key[0], ends * 1000, None, "failed", True, TIMED_OUT)

    def _stop(self, ends):
        if ends is not None:
            self.handle.deleteTimer(ends)
        return None

    def close(self) -> None:
        """Nothing is open between batches."""


def single_flight(requests: DataFrame, stuck_after: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """States of tasks in a stream: a request is refused while its session is busy.

    ``requests``: session string, kind string ('start', 'succeed' or 'fail'), at timestamp, and
    ord long if there is one; requests of one time count in the order of ord. Emits a row per request (ord, state,
    accepted) and, with ``stuck_after`` (an interval such as '2 hours'), one without ord for each
    task that ran so long in the time of the requests: it failed, and the session is free again.
    ``delay`` is how late requests may come in then. Keyed state with timers needs the RocksDB
    state store, to which the session's setting goes where it has its default; a query that was
    started before keeps the one that its checkpoint names.
    """
    spark = requests.sparkSession
    if spark.conf.get(_STORE) == _DEFAULT_STORE:
        spark.conf.set(_STORE, _KEYED_STORE)
    if "ord" not in requests.columns:
        requests = requests.withColumn("ord", F.lit(0))
    ms = None if stuck_after is None else int(pd.Timedelta(stuck_after).total_seconds() * 1000)
    rows = requests.select("session", "kind", F.col("at").cast("timestamp").alias("at"), F.col("ord").cast("long").alias("ord"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    rows = rows if ms is None else rows.withWatermark("at", delay)
    mode = "None" if ms is None else "EventTime"
    # times are numbers in tasks, so that no time zone counts; plain rows, as a session has few in a batch
    states = rows.groupBy("session").transformWithState(_Flight(ms), _STATES_SCHEMA.replace("at timestamp", "us long"), "Append", mode)
    return states.select("session", F.timestamp_micros("us").alias("at"), "ord", "state", "accepted", "reason")


def replayed(requests: DataFrame, path: str, slices: int = 3, files: int | None = None, stuck_after: str | None = None) -> DataFrame:
    """The states of a table of requests, run through the stream in micro-batches; ``path`` is a new shared folder.

    Requests are written as slices of time, one after another; a session's requests of a slice
    lie in one file, and files are read in the order in which they were written, those of a slice
    (``files``, by default one for each core) together. A batch orders each session's requests.
    """
    spark = requests.sparkSession
    files = files or spark.sparkContext.defaultParallelism
    requests = requests.select("session", "kind", F.col("at").cast("timestamp").alias("at"), "ord")
    low, high = requests.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    part = F.least(F.floor((F.unix_micros("at") - F.lit(low or 0)) * slices / F.lit(max(1, (high or 0) - (low or 0)))), F.lit(slices - 1))
    for k in range(slices):
        requests.where(part == k).repartition(files, "session").write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    run = single_flight(source, stuck_after).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(_STATES_SCHEMA).parquet(f"{path}/out")


# What tasks of each type say while they run and when they succeed.
RUNNING = {"discover": "正在发现引用论文…", "extend": "正在继续发现引用论文到 %s 篇…", "refresh": "正在刷新下载探测状态…", "download": "正在下载所选论文…", "analyze": "正在进行全文分析…"}
DONE = {"discover": "Discover 完成", "extend": "继续 Discover 完成", "refresh": "Refresh 完成", "download": "Download 完成", "analyze": "Analyze 完成"}
TOP_SPANS = 8


def task_starts(commands: DataFrame) -> DataFrame:
    """Start requests of commands, for ``task_states`` and ``single_flight``: what each task is called, asks for and says.

    ``commands``: session, command (discover, extend, refresh, download or analyze), at, ord, ids
    (array), top_k, scope, wanted and held (papers that an extension wants, and that are there).
    An extension is a discover task and never shrinks; others than these are passed over.
    """
    said = lambda texts: F.try_element_at(F.create_map(*(F.lit(x) for p in texts.items() for x in p)), F.col("command"))
    extend, analyze = F.col("command") == "extend", F.col("command") == "analyze"
    limit = F.when(extend, F.greatest(F.coalesce("wanted", "held", F.lit(0)), F.coalesce("held", F.lit(0))))
    running = F.when(extend, F.format_string(RUNNING["extend"], limit.cast("string"))).otherwise(said(RUNNING))
    return commands.where(F.col("command").isin(list(RUNNING))).select(
        "session", F.lit("start").alias("kind"), "at", "ord", F.when(extend, "discover").otherwise(F.col("command")).alias("task_type"), running.alias("message"), said(DONE).alias("success_message"),
        F.coalesce(F.when(F.col("command").isin("refresh", "download", "analyze"), F.col("ids")), F.array().cast("array<string>")).alias("requested_ids"), limit.alias("limit"),
        F.when(analyze, F.coalesce("top_k", F.lit(TOP_SPANS))).alias("top_k_spans"), F.when(analyze, analysis_scope(F.col("scope"))).otherwise("candidate_spans").alias("analysis_scope"),
    )


def arrivals(papers: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of citing papers (with arrived timestamp), each identity once within the watermark."""
    keyed = papers.withColumn("key", P.identity_key()).where(F.col("key").isNotNull())
    return keyed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["key"])


def upsert_papers(spark: SparkSession, path: str):
    """A foreachBatch function: new papers join those under ``path``, earlier rows win."""

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/batch={number}"
        done = spark.read.parquet(path) if _exists(spark, path) else None
        new = P.dedupe(batch)
        if done is not None:
            done = done.where(F.col("batch") < number).select("key")
            new = new.join(done, "key", "left_anti")
        new.write.mode("overwrite").parquet(target)  # a repeated batch replaces itself

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
