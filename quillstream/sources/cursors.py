"""Sources that page by cursor, as batch reads and as streams whose offset is the cursor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: The cursor of the first page; pages that one micro-batch takes at most.
FIRST, PAGES_A_BATCH = "*", 8


class _Span(InputPartition):
    def __init__(self, cursors: list[str]):
        super().__init__(cursors)


def _source(name: str, following: Callable[[str], str | None], pages_a_batch: int) -> type[DataSource]:
    """A DataSource of the cursors alone: one row a page."""

    class Reader(DataSourceReader):
        """All cursors from the first to the last."""

        def partitions(self) -> list[InputPartition]:
            found, at = [], FIRST
            while at:
                found.append(at)
                at = following(at) or ""
            return [_Span(found[k : k + pages_a_batch]) for k in range(0, len(found), pages_a_batch)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from ((c,) for c in partition.value)

    class Stream(SimpleDataSourceStreamReader):
        """Offsets are cursors of pages that come next; an empty one is the end."""

        def initialOffset(self) -> dict:
            return {"cursor": FIRST}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            found, at = [], start["cursor"]
            while at and len(found) < pages_a_batch:
                found.append((at,))
                at = following(at) or ""
            return iter(found), {"cursor": at}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            at = start["cursor"]
            while at and at != end["cursor"]:
                yield (at,)
                at = following(at) or ""

    class Cursors(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "cursor string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Stream()

    return Cursors


def cursor_rows(spark: SparkSession, name: str, schema: str, fetch: Callable[[str], list[tuple]], following: Callable[[str], str | None], streaming: bool = False, pages_a_batch: int = PAGES_A_BATCH) -> DataFrame:
    """The rows of an interface that pages by cursor, in a batch or as a stream.

    ``following`` gives the cursor of the page after a page, None after the last one; ``fetch``
    gives the rows of a page. Only cursors pass the driver; executors fetch the pages, and a lost
    task fetches its own again. In a stream a restarted query goes on at the cursor where
    its checkpoint ends, and a batch that failed is read again from the same cursors.
    """
    ship(spark)
    spark.dataSource.register(_source(name, following, pages_a_batch))
    cursors = (spark.readStream if streaming else spark.read).format(name).load()
    cursors = cursors.repartition(pages_a_batch) if streaming else cursors
    struct = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cursor in batch.column("cursor").to_pylist():
                rows = fetch(cursor)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], arrow.names)

    return cursors.mapInArrow(run, struct)
