"""Views that follow their table by deltas: each batch of papers adds its part to stored counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import papers as P
from ..session import checkpointed
from ..sources.snapshots import Snapshots

#: Columns of the stored view besides its group: sums, then extremes.
SUMS, LEAST, MOST = ("n", "high", "confident"), ("year_min",), ("year_max",)


def partial(papers: DataFrame, group: str) -> DataFrame:
    """What a batch of papers (year, confidence) adds to the view of each group."""
    trust = F.coalesce("confidence", F.lit(""))
    return papers.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(trust == "high").alias("high"), F.count_if(trust.isin("high", "medium")).alias("confident"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"),
    )


def merged(view: DataFrame | None, delta: DataFrame, group: str) -> DataFrame:
    """The view with a delta: sums add up, extremes compare; the papers themselves are not read."""
    both = delta if view is None else view.unionByName(delta)
    return both.groupBy(group).agg(*(F.sum(c).alias(c) for c in SUMS), *(F.min(c).alias(c) for c in LEAST), *(F.max(c).alias(c) for c in MOST))


def derived(view: DataFrame) -> DataFrame:
    """With impact_level, worked out from the counts alone."""
    level = F.when((F.col("n") >= 10) | (F.col("high") >= 2) | (F.col("confident") >= 4), "high").when((F.col("n") >= 5) | (F.col("confident") >= 2), "medium").otherwise("low")
    return view.withColumn("impact_level", level)


class FollowedPapers:
    """Papers with a view that is kept up to date: the foreachBatch function of a stream, and the reads.

    New identities join the papers (of equal ones the first batch wins), and only they go into
    the view. Both tables are versioned by the number of the batch: a batch that comes again
    finds its versions and changes nothing, and one that was lost between the two is
    finished from the papers that it had stored.
    """

    def __init__(self, spark: SparkSession, path: str, group: str):
        self.spark, self.group = spark, group
        self.added, self.view = Snapshots(spark, f"{path}/papers"), Snapshots(spark, f"{path}/view")

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number not in self.added.versions():
            new = P.dedupe(batch)
            if (before := self.papers(number)) is not None:
                new = new.join(before.select("key"), "key", "left_anti")
            self.added.publish(new, number)
        if number not in self.view.versions():
            earlier = [v for v in self.view.versions() if v < number]
            old = self.view.read(earlier[-1]) if earlier else None
            self.view.publish(merged(old, partial(self.added.read(number), self.group), self.group), number)

    def papers(self, before: int | None = None) -> DataFrame | None:
        """The papers of all batches (before a number): one version holds the new ones of a batch."""
        folders = [self.added.folder(v) for v in self.added.versions() if before is None or v < before]
        return self.spark.read.parquet(*folders) if folders else None

    def state(self) -> DataFrame | None:
        """The view with its derivatives, as of the last batch that is whole."""
        view = self.view.read()
        return None if view is None else derived(view)


def follow(batches: list[DataFrame], path: str, group: str) -> DataFrame:
    """The state after these batches, one after another; ``path`` is a new shared folder."""
    followed = FollowedPapers(batches[0].sparkSession, path, group)
    for number, batch in enumerate(batches):
        followed(batch, number)
    return checkpointed(followed.state())
