"""A read-through cache of fetched pages: what is missing is fetched, kept if it succeeded, and read back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship
from .fulltext import missing_urls, with_retries

_FETCHED = "key string, url string, status int, text string, error string"


def fetch_all(missing: DataFrame, fetch: Callable[[str], tuple[int, str]]) -> DataFrame:
    """key, url, status, text and error of each missing URL (url, key)."""
    ship(missing.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url in zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), strict=True):
                try:
                    status, text = fetch(url)
                    rows.append((key, url, status, text if status == 200 else None, None if status == 200 else f"status {status}"))
                except Exception as e:  # a client may raise anything; the row says so
                    rows.append((key, url, None, None, str(e) or type(e).__name__))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in _FETCHED.split(", ")])

    return missing.select("key", "url").mapInArrow(run, _FETCHED)


def read_through(wanted: DataFrame, path: str, fetch: Callable[[str], tuple[int, str]], waits: tuple[float, ...] | None = None, pause: float = 3) -> DataFrame:
    """url, text, error and cached (whether it was there before) of each distinct URL that is wanted.

    ``path`` is a table in a shared folder. Only answers of status 200 are kept, under the hash
    of their URL; each key is read once even if two writers kept it. Calls are made once: the
    answers are written before anything reads them, and a second run fetches what failed alone.
    """
    spark = wanted.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    kind = "key string, url string, status int, text string"
    known = spark.read.schema(kind).parquet(path) if there else spark.createDataFrame([], kind)
    urls = wanted.where("url IS NOT NULL").select("url").distinct()
    held = checkpointed(urls.withColumn("key", F.sha1("url")).join(known.select("key", "text").dropDuplicates(["key"]), "key"))
    tries = {} if waits is None else {"waits": waits}
    fetched = checkpointed(fetch_all(missing_urls(urls, known), _retried(fetch, pause=pause, **tries)))
    fetched.where("status = 200").select("key", "url", "status", "text").write.mode("append").parquet(path)
    none = F.lit(None).cast("string")
    return held.select("url", "text", none.alias("error"), F.lit(True).alias("cached")).unionByName(fetched.select("url", "text", "error", F.lit(False).alias("cached")))


def _retried(fetch: Callable[[str], tuple[int, str]], **how) -> Callable[[str], tuple[int, str]]:
    """``fetch`` with the waits of ``with_retries``."""

    def whole(url: str) -> tuple[int, str, bytes]:
        status, text = fetch(url)
        return status, "", (text or "").encode()

    tried = with_retries(whole, **how)

    def back(url: str) -> tuple[int, str]:
        status, _, content = tried(url)
        return status, content.decode()

    return back
